"""Sessions, durable memory and context budgets as folds over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions import text as T

#: Context limits and what is always recalled.
WINDOW, SOFT, HARD, RESERVE, PROMPT = 32_768, 24_576, 28_672, 8_192, 3_500
ALWAYS = ("preference", "constraint", "long_term_goal")
LEAST_IMPORTANCE = 0.55
DURABLE = ("以后", "始终", "一直", "默认", "每次", "都用", "记住", "长期", "不要再", "从现在", "always", "never", "default")
AUDIT_MARK = "========== 上下文审查 =========="


def message_tokens(content: Column) -> Column:
    return T.token_estimate(content) + 4


def normalised(content: Column) -> Column:
    return F.lower(T.squeeze(content))


def memory(updates: DataFrame, cap: int = 300) -> DataFrame:
    """The memories of each scope after all updates (user_id, session_id, seq, kind, content, importance, ts): important and not
    blank; one for each kind and normalised content, with the first's text and id, the greatest importance and the latest time;
    the `cap` most important, later ones first."""
    good = updates.where((F.col("importance") >= LEAST_IMPORTANCE) & (T.strip(F.col("content")) != "")).withColumn("norm", normalised(F.col("content")))
    folded = good.groupBy("user_id", "session_id", "kind", "norm").agg(F.min_by(T.strip(F.col("content")), "seq").alias("content"), F.max("importance").alias("importance"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    ident = F.concat(F.lit("mem_"), F.left(F.sha2(F.concat_ws(":", "user_id", "session_id", "kind", "norm"), 256), F.lit(20)))
    best = Window.partitionBy("user_id", "session_id").orderBy(F.desc("importance"), F.desc("updated_at"), "norm")
    return folded.withColumn("place", F.row_number().over(best)).where(F.col("place") <= cap).withColumn("memory_id", ident)


def recall(memories: DataFrame, queries: DataFrame, limit: int = 12) -> DataFrame:
    """Of each query's scope (queries: query_id, user_id, session_id, query): memories that share a token or are of a kind that is
    always recalled; by overlap, importance, time."""
    pairs = queries.join(memories, ["user_id", "session_id"])
    overlap = F.size(F.array_intersect(T.lexical_tokens(F.col("query")), T.lexical_tokens(F.col("content"))))
    found = pairs.withColumn("overlap", overlap).where((F.col("overlap") > 0) | F.col("kind").isin(*ALWAYS))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("importance"), F.desc("updated_at"), "memory_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def merge_unique(arrays: list[Column], limit: int) -> Column:
    """In order, each once, without blanks; the last `limit`."""
    return T.suffix(F.array_distinct(F.filter(F.concat(*arrays), lambda x: x.isNotNull() & (x != ""))), limit)


def some_of_each(rows: DataFrame, key: str, n: int, item: Column, *order: str, newest: bool = False) -> DataFrame:
    """key, items: of each key's rows the first n in order (newest: the last n, newest first). A window cuts before the shuffle, so that
    no more than n rows of a key and task are moved, and n are collected."""
    by = [F.desc(c) if newest else F.asc(c) for c in order]
    few = rows.withColumn("__item", item).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("__n") <= n)
    return few.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__item"))), lambda s: s["__item"]).alias("items"))


def last_unique(rows: DataFrame, key: str, item: str, limit: int, *order: str) -> DataFrame:
    """key, items: of each key's items in order, each at its first place, without blanks, the last `limit`. Repeats fold before the shuffle and a
    window cuts before it too, so that no history is collected. Keys without an item have an empty list."""
    first = rows.where(F.col(item).isNotNull() & (F.col(item) != "")).groupBy(key, item).agg(F.min(F.struct(*order)).alias("__at"))
    back = Window.partitionBy(key).orderBy(F.desc("__at"), F.desc(item))
    last = first.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= limit)
    lists = last.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", item))), lambda s: s[item]).alias("items"))
    return rows.select(key).distinct().join(lists, key, "left").select(key, F.coalesce("items", F.array().cast("array<string>")).alias("items"))


#: The kinds of memory that each list of a snapshot holds, and how many entries.
SNAPSHOT = {
    "long_term": (("user_profile", "long_term_goal", "decision", "learned_fact"), 16),
    "preferences": (("preference",), 12),
    "constraints": (("constraint",), 12),
    "open_questions": (("unfinished_task",), 10),
}


def snapshot(memories: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """user_id, session_id and the lists of SNAPSHOT: what is active (the same columns, arrays), then the memories of each scope, most important first;
    each entry once, the last ones where a list is full."""
    by = ["user_id", "session_id"]
    own = {n: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("place", "content")))), lambda s: s["content"]).alias(f"__{n}") for n, (kinds, _) in SNAPSHOT.items()}
    got = memories.groupBy(*by).agg(*own.values())
    none = F.array().cast("array<string>")
    both = got.withColumns({n: none for n in SNAPSHOT}) if active is None else active.join(got, by, "full")
    return both.select(*by, *[merge_unique([F.coalesce(n, none), F.coalesce(f"__{n}", none)], cap).alias(n) for n, (_, cap) in SNAPSHOT.items()])


def durable(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for m in DURABLE:
        out = out | low.contains(m)
    return out


def without_audit(role: Column, content: Column) -> Column:
    cut = F.regexp_replace(F.split_part(content, F.lit(AUDIT_MARK), F.lit(1)), r"\s+$", "")
    return F.when((role == "assistant") & content.contains(AUDIT_MARK), cut).otherwise(content)


def window_state(used: Column) -> Column:
    return F.when(used > WINDOW, "overflow").when(used >= HARD, "hard_limit").when(used >= min(SOFT, WINDOW - RESERVE), "soft_limit").otherwise("normal")


def evict(messages: DataFrame, hard: int, base: int = PROMPT, key: str = "session_id") -> DataFrame:
    """Messages (key, seq, role, tokens) that stay: the oldest that isn't the system's goes until all fits or one is left. Those that go are the
    first of their kind, so sums over what came before say which."""
    whole = Window.partitionBy(key)
    before = whole.orderBy("seq", "role", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    other = F.col("role") != "system"
    gone = lambda what: F.coalesce(F.sum(F.when(other, what)).over(before), F.lit(0))
    used, left = base + F.sum("tokens").over(whole) - gone(F.col("tokens")), F.count("*").over(whole) - gone(F.lit(1))
    return messages.withColumn("__goes", other & (used > hard) & (left > 1)).where("NOT __goes").drop("__goes")


def compaction(messages: DataFrame, safe: int, summary_tokens: int = 200, base: int = PROMPT, key: str = "session_id") -> DataFrame:
    """The context fold of each session: before a user's turn, and once when it is committed, everything so far becomes a
    checkpoint of summary_tokens if the context wouldn't fit. Returns for each message: key, seq, context_tokens, checkpoint
    (messages in it), compacted (before, at commit or none)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "role", "tokens"])
        rows, state = [], (0, 0, 0)
        for seq, role, tokens in zip(pdf["seq"], pdf["role"], pdf["tokens"], strict=True):
            state, did = context_step(state, role, int(tokens), safe, summary_tokens, base)
            rows.append((pdf[key].iloc[0], seq, base + state[0], state[1], did))
        return pd.DataFrame(rows, columns=[key, "seq", "context_tokens", "checkpoint", "compacted"])

    kinds = dict(messages.dtypes)
    return messages.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, seq {kinds['seq']}, context_tokens long, checkpoint long, compacted string")


def context_step(state: tuple[int, int, int], role: str, tokens: int, safe: int, summary_tokens: int, base: int) -> tuple[tuple[int, int, int], str]:
    """(tokens held, messages in the checkpoint, messages) after one more message, and whether everything became a checkpoint: before, at commit or none."""
    held, checkpoint, n = state
    if role == "user" and n > checkpoint and base + held + tokens > safe:
        return (summary_tokens + tokens, n, n + 1), "before"
    held, n = held + tokens, n + 1
    return ((summary_tokens, n, n), "commit") if role == "assistant" and base + held > safe else ((held, checkpoint, n), "none")


def auto_title(content: Column, limit: int = 24) -> Column:
    flat = T.squeeze(content)
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)


def unmatched(optimistic: DataFrame, stored: DataFrame, seconds: int = 60) -> DataFrame:
    """Optimistic messages (session_id, role, content, ts) without a stored one of the same role and content less than `seconds` away.

    An equi-join on session, role and content; only times within such a group are compared."""
    far = stored.select("session_id", "role", "content", F.col("ts").alias("stored_ts"))
    near = F.abs(F.unix_micros(F.col("ts")) - F.unix_micros(F.col("stored_ts"))) < seconds * 1_000_000
    o, s = optimistic.alias("o"), far.alias("s")
    on = (F.col("o.session_id") == F.col("s.session_id")) & (F.col("o.role") == F.col("s.role")) & (F.col("o.content") == F.col("s.content")) & near
    return o.join(s, on, "left_anti")
