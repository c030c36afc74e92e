"""Queries: sessions, memory, context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinlake.functions import text as T
from skeinlake.operators import sessions as O

from . import sqltext as S
from .registry import Registry, said, said_sql, table

register = Registry()

#: Conversations as messages: session, order, time (a minute a turn).
MSG_SQL = "msg AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content, TIMESTAMP '2024-01-01' + to_minutes((conv_id * 10 + turn)::INT) AS ts FROM conversations)"


def messages(spark, sf_dir, rows=None):
    start = F.lit("2024-01-01").cast("timestamp")
    rows = table(spark, sf_dir, "conversations") if rows is None else rows
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), (start + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("conv_id") * 10 + F.col("turn")).cast("int"))).alias("ts"))


def _ntz(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@register(f"WITH {MSG_SQL} SELECT session_id, count(*) AS messages, min(ts) AS created_at, max(ts) AS updated_at FROM msg GROUP BY session_id")
def session_list(spark, sf_dir):
    got = messages(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("messages"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    return got.select("session_id", "messages", _ntz("created_at"), _ntz("updated_at"))


@register(f"WITH {MSG_SQL} SELECT session_id, count(*) FILTER (role = 'assistant') AS message_count, count(*) AS messages FROM msg GROUP BY session_id")
def session_message_count(spark, sf_dir):
    """Messages of each session there is, and the answers among them; one without any counts as 0."""
    return messages(spark, sf_dir).groupBy("session_id").agg(F.count_if(F.col("role") == "assistant").alias("message_count"), F.count("*").alias("messages"))


@register(f"WITH {MSG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, role, content) AS back FROM msg) SELECT session_id, seq, role, content, back FROM r WHERE back <= 12")
def conversation_history(spark, sf_dir):
    """The last twelve messages of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"), "role", "content")
    return messages(spark, sf_dir).withColumn("back", F.row_number().over(w).cast("long")).where("back <= 12").select("session_id", "seq", "role", "content", "back")


@register(f"WITH {MSG_SQL}, a AS (SELECT session_id, seq, CASE WHEN length(content) % 3 = 0 THEN '' ELSE sha256(content) END AS snapshot FROM msg WHERE role = 'assistant'), l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, snapshot) AS r FROM a) SELECT session_id, seq, snapshot FROM l WHERE r = 1 AND snapshot <> ''")
def latest_snapshot_asof(spark, sf_dir):
    """The newest snapshot of each session, if it isn't blank: a blank newest one hides those before it."""
    own = messages(spark, sf_dir).where("role = 'assistant'").select("session_id", "seq", F.when(F.length("content") % 3 == 0, "").otherwise(F.sha2("content", 256)).alias("snapshot"))
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"), "snapshot")
    return own.withColumn("r", F.row_number().over(w)).where("r = 1 AND snapshot <> ''").drop("r")


@register(f"WITH {MSG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, content) AS r FROM msg WHERE role = 'user') SELECT session_id, CASE WHEN length({S.squeeze('content')}) > 24 THEN left({S.squeeze('content')}, 24) || '…' ELSE {S.squeeze('content')} END AS title FROM r WHERE r = 1")
def auto_title(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("seq", "content")
    first = messages(spark, sf_dir).where("role = 'user'").withColumn("r", F.row_number().over(w)).where("r = 1")
    return first.select("session_id", O.auto_title(F.col("content")).alias("title"))


@register(f"WITH {MSG_SQL}, opt AS (SELECT session_id, role, content, ts + to_seconds((session_id * 7 % 100)::INT) AS ts FROM msg WHERE role = 'user') SELECT session_id, role, sha256(content) AS digest, ts FROM opt WHERE NOT EXISTS (SELECT 1 FROM msg s WHERE s.session_id = opt.session_id AND s.role = opt.role AND s.content = opt.content AND abs(epoch_us(s.ts) - epoch_us(opt.ts)) < 60000000)")
def optimistic_anti_join(spark, sf_dir):
    own = messages(spark, sf_dir)
    late = own.where("role = 'user'").select("session_id", "role", "content", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("session_id") * 7 % 100).cast("int"))).alias("ts"))
    return O.unmatched(late, own).select("session_id", "role", F.sha2("content", 256).alias("digest"), _ntz("ts"))


_TOKENS = S.token_estimate("content")


@register(f"WITH {MSG_SQL}, t AS (SELECT session_id, sum(40 * ({_TOKENS} + 4)) + 3500 AS used FROM msg GROUP BY session_id) SELECT session_id, used::BIGINT AS used, greatest(0, 32768 - used)::BIGINT AS remaining, round(used / 32768e0, 4) AS usage_ratio, greatest(0, 24576 - used)::BIGINT AS safe_remaining, CASE WHEN used > 32768 THEN 'overflow' WHEN used >= 28672 THEN 'hard_limit' WHEN used >= 24576 THEN 'soft_limit' ELSE 'normal' END AS state FROM t")
def window_status(spark, sf_dir):
    """Token use of each session, each message counted forty times so that all states occur."""
    used = messages(spark, sf_dir).groupBy("session_id").agg((F.sum(40 * O.message_tokens(F.col("content"))) + O.PROMPT).alias("used"))
    u = F.col("used")
    return used.select("session_id", "used", F.greatest(F.lit(0), O.WINDOW - u).alias("remaining"), F.round(u / O.WINDOW, 4).alias("usage_ratio"), F.greatest(F.lit(0), min(O.SOFT, O.WINDOW - O.RESERVE) - u).alias("safe_remaining"), O.window_state(u).alias("state"))


@register(f"WITH {MSG_SQL}, m AS (SELECT session_id, seq, role, content, {_TOKENS} + 4 AS tokens FROM msg), w AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id) AS total, count(*) OVER (PARTITION BY session_id) AS n, coalesce(sum(CASE WHEN role <> 'system' THEN tokens END) OVER p, 0) AS gone, coalesce(sum(CASE WHEN role <> 'system' THEN 1 END) OVER p, 0) AS went FROM m WINDOW p AS (PARTITION BY session_id ORDER BY seq, role, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT session_id, seq, role, tokens FROM w WHERE role = 'system' OR 3500 + total - gone <= 3900 OR n - went <= 1")
def hard_limit_evict(spark, sf_dir):
    own = messages(spark, sf_dir).select("session_id", "seq", "role", O.message_tokens(F.col("content")).alias("tokens"))
    return O.evict(own, hard=3_900)


COMPACTION_SQL = f"""WITH RECURSIVE {MSG_SQL}, m AS (SELECT session_id, seq, role, {_TOKENS} + 4 AS tokens FROM msg), o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, role, tokens) AS i FROM m),
c AS (SELECT session_id, 0::BIGINT AS i, 0::BIGINT AS seq, 0::BIGINT AS held, 0::BIGINT AS checkpoint, 'none' AS did FROM o GROUP BY session_id UNION ALL
SELECT session_id, i, seq, CASE did WHEN 'commit' THEN 200 ELSE h END, CASE did WHEN 'commit' THEN i WHEN 'before' THEN i - 1 ELSE checkpoint END, did FROM (SELECT *, CASE WHEN early THEN 'before' WHEN role = 'assistant' AND 3500 + h > 3900 THEN 'commit' ELSE 'none' END AS did
FROM (SELECT *, CASE WHEN early THEN 200 ELSE held END + tokens AS h FROM (SELECT c.session_id, o.i, o.seq, o.role, o.tokens, held, checkpoint, o.role = 'user' AND o.i - 1 > checkpoint AND 3500 + held + o.tokens > 3900 AS early FROM c JOIN o ON o.session_id = c.session_id AND o.i = c.i + 1))))
SELECT session_id, seq, 3500 + held AS context_tokens, checkpoint, did AS compacted FROM c WHERE i > 0"""


@register(COMPACTION_SQL)
def context_compaction(spark, sf_dir):
    own = messages(spark, sf_dir).select("session_id", "seq", "role", O.message_tokens(F.col("content")).alias("tokens"))
    return O.compaction(own, safe=3_900)


@register(f"WITH {MSG_SQL} SELECT session_id, seq, {_TOKENS} AS tokens FROM msg")
def token_estimate(spark, sf_dir):
    return messages(spark, sf_dir).select("session_id", "seq", T.token_estimate(F.col("content")).alias("tokens"))


_KINDS = "['preference', 'learned_fact', 'constraint', 'unfinished_task', 'long_term_goal', 'decision', 'user_profile']"
#: Messages as memory updates: a user for ten sessions; kind and importance by number.
UPD_SQL = f"upd AS (SELECT session_id % 10 AS user_id, session_id, seq, ({_KINDS})[1 + (session_id + seq) % 7] AS kind, ' ' || content || ' ' AS content, ((session_id * 3 + seq * 7) % 10) / 10e0 AS importance, ts FROM msg)"
MEM_SQL = f"good AS (SELECT *, lower({S.squeeze('content')}) AS norm, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS c FROM upd WHERE importance >= 55e-2 AND regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> ''), fold AS (SELECT user_id, session_id, kind, norm, arg_min(c, seq) AS content, max(importance) AS importance, min(ts) AS created_at, max(ts) AS updated_at FROM good GROUP BY ALL), mem AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY importance DESC, updated_at DESC, norm) AS place, 'mem_' || left(sha256(concat_ws(':', user_id, session_id, kind, norm)), 20) AS memory_id FROM fold)"


def updates(spark, sf_dir, rows=None):
    own = messages(spark, sf_dir, rows)
    kinds = F.array(*[F.lit(k) for k in ("preference", "learned_fact", "constraint", "unfinished_task", "long_term_goal", "decision", "user_profile")])
    return own.select((F.col("session_id") % 10).alias("user_id"), "session_id", "seq", F.get(kinds, ((F.col("session_id") + F.col("seq")) % 7).cast("int")).alias("kind"), F.concat(F.lit(" "), "content", F.lit(" ")).alias("content"), (((F.col("session_id") * 3 + F.col("seq") * 7) % 10) / 10.0).alias("importance"), "ts")


@register(f"WITH {MSG_SQL}, {UPD_SQL}, {MEM_SQL} SELECT memory_id, user_id, session_id, kind, content, importance, created_at, updated_at FROM mem")
def memory_upsert(spark, sf_dir):
    return O.memory(updates(spark, sf_dir)).select("memory_id", "user_id", "session_id", "kind", "content", "importance", _ntz("created_at"), _ntz("updated_at"))


@register(f"WITH {MSG_SQL}, {UPD_SQL}, {MEM_SQL} SELECT memory_id, session_id, place FROM mem WHERE place <= 2")
def memory_retention_cap(spark, sf_dir):
    return O.memory(updates(spark, sf_dir), cap=2).select("memory_id", "session_id", F.col("place").cast("long").alias("place"))


@register(f"""WITH {MSG_SQL}, {UPD_SQL}, {MEM_SQL}, q AS (SELECT session_id AS query_id, session_id % 10 AS user_id, session_id, arg_max(content, seq) AS query FROM msg WHERE role = 'user' GROUP BY session_id),
p AS (SELECT query_id, memory_id, importance, updated_at, kind, len(list_intersect({S.lexical_tokens('q.query')}, {S.lexical_tokens('mem.content')})) AS overlap FROM q JOIN mem USING (user_id, session_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, importance DESC, updated_at DESC, memory_id) AS rank FROM p WHERE overlap > 0 OR kind IN ('preference', 'constraint', 'long_term_goal')) SELECT query_id, memory_id, overlap, rank FROM r WHERE rank <= 12""")
def memory_recall_topk(spark, sf_dir):
    last = messages(spark, sf_dir).where("role = 'user'").groupBy("session_id").agg(F.max_by("content", "seq").alias("query"))
    queries = last.select(F.col("session_id").alias("query_id"), (F.col("session_id") % 10).alias("user_id"), "session_id", "query")
    return O.recall(O.memory(updates(spark, sf_dir)), queries).select("query_id", "memory_id", F.col("overlap").cast("long").alias("overlap"), F.col("rank").cast("long").alias("rank"))


def _listed(name: str) -> str:
    kinds, cap = O.SNAPSHOT[name]
    own = f"list(content ORDER BY place) FILTER (kind IN ({', '.join(repr(k) for k in kinds)}))"
    once = f"list_filter({own}, lambda x, i: list_position({own}, x) = i)"
    return f"coalesce(array_to_string(list_slice({once}, greatest(len({once}) - {cap - 1}, 1), len({once})), '|'), '') AS {name}"


@register(f"WITH {MSG_SQL}, {UPD_SQL}, {MEM_SQL} SELECT user_id, session_id, {', '.join(map(_listed, O.SNAPSHOT))} FROM mem GROUP BY ALL")
def memory_snapshot_merge(spark, sf_dir):
    """Memories as the snapshot's four lists have them."""
    got = O.snapshot(O.memory(updates(spark, sf_dir)))
    return got.select("user_id", "session_id", *[F.array_join(n, "|").alias(n) for n in O.SNAPSHOT])


@register(f"WITH {MSG_SQL}, w AS (SELECT session_id, list_concat(list(content ORDER BY seq, content), list(reverse(content) ORDER BY seq, content)) AS l FROM msg GROUP BY session_id), u AS (SELECT session_id, list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i) AS u FROM w) SELECT session_id, array_to_string(list_slice(u, greatest(len(u) - 3, 1), len(u)), '|') AS merged FROM u")
def unique_merge_last_n(spark, sf_dir):
    """A session's messages, and them read backwards: in order, each once, the last four."""
    own = messages(spark, sf_dir).select("session_id", "seq", "content")
    both = own.select("session_id", F.lit(0).alias("side"), "seq", "content", F.col("content").alias("item"))
    both = both.unionByName(own.select("session_id", F.lit(1).alias("side"), "seq", "content", F.reverse("content").alias("item")))
    got = O.last_unique(both, "session_id", "item", 4, "side", "seq", "content")
    return got.select("session_id", F.array_join("items", "|").alias("merged"))


_ASKED = ["以后都用 Python", "这次快一点", "Always explain", "Remember the default"]


@register(f"WITH t AS ({said_sql(_ASKED)}) SELECT conv_id, turn, " + " OR ".join(f"contains(lower(s), '{m}')" for m in O.DURABLE) + " AS durable FROM t")
def durable_constraints(spark, sf_dir):
    return said(spark, sf_dir, _ASKED).select("conv_id", "turn", O.durable(F.col("s")).alias("durable"))


@register(rf"""WITH m AS (SELECT conv_id, turn, role, text || CASE WHEN turn % 2 = 1 THEN ' ' || chr(10) || '{O.AUDIT_MARK} x' ELSE '' END AS c, text FROM conversations) SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN regexp_replace(text, '\s+$', '') ELSE c END AS content FROM m""")
def audit_stripping(spark, sf_dir):
    """Messages with an audit behind every second one: answers lose it."""
    content = F.concat("text", F.when(F.col("turn") % 2 == 1, f" \n{O.AUDIT_MARK} x").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", O.without_audit(F.col("role"), content).alias("content"))
