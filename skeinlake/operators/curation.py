"""Catalogues and selection: tiers, quotas, latest wins, gates, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions import text as T

LEAST_LIKES, LEAST_VIEWS = 100, 10_000


def engaged(likes: Column, views: Column) -> Column:
    """100 likes and 10,000 views; nulls count as none."""
    return (F.coalesce(likes, F.lit(0)) >= LEAST_LIKES) & (F.coalesce(views, F.lit(0)) >= LEAST_VIEWS)


def choose_post(cards: DataFrame, group: str, tier: Column, *ties: Column) -> DataFrame:
    """One card of each group (likes, views): of engaged ones the preferred author's (tier 0), else official (1), else any (2); else
    the best measurable one, pending; groups without measurable cards have status pending_metrics and no card."""
    measurable = F.col("likes").isNotNull() & F.col("views").isNotNull()
    rank = F.when(~measurable, 9).when(~engaged(F.col("likes"), F.col("views")), 8).otherwise(tier)
    order = Window.partitionBy(group).orderBy("tier", F.desc("likes"), F.desc("views"), *ties)
    first = cards.withColumn("tier", rank).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return first.withColumn("status", F.when(F.col("tier") == 9, "pending_metrics").when(F.col("tier") == 8, "pending_quality_threshold").otherwise("selected"))


def first_n(rows: DataFrame, n: int, by: str | list[str], *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def quota_fill(sources: list[DataFrame], key: str, quota: int) -> DataFrame:
    """Up to quota keys, first from the first source, then the next (each: key, position), each key once, with its source as reason."""
    pool = None
    for i, s in enumerate(sources):
        some = s.select(key, "position", F.lit(i).alias("source"))
        pool = some if pool is None else pool.unionByName(some)
    best = pool.groupBy(key).agg(F.min(F.struct("source", "position")).alias("b")).select(key, F.col("b.source").alias("source"), F.col("b.position").alias("position"))
    return best.orderBy("source", "position", key).limit(quota)


def latest(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """Upsert: of each key the last row in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def replace_by_key(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: key, side."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").select(key, F.lit(side).alias("side"))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (letters), hash (of the normalised text)."""
    return docs.select(key, F.length(text).alias("n"), T.fingerprint_sha256(F.col(text)).alias("hash"))


def copied(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """hash, members, canonical (the longest text's key, the greatest of equals) and its n, of each hash that rows of several keys have."""
    best = rows.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.count("*").alias("members"), F.min(key).alias("__least"), F.max(key).alias("__most"), F.max(F.struct("n", key)).alias("b"))
    return best.where(F.col("__least") != F.col("__most")).select("hash", "members", F.col(f"b.{key}").alias("canonical"), "b.n")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that repeat another's normalised text: duplicate, canonical (the longest text's key, the greatest of equals), hash.

    Texts are read and hashed once. Groups keep one struct each (map-side combined); members meet their group's struct by the hash."""
    from skeinlake.sources.tables import staged

    rows = staged(hashed(docs, key, text), "hashes")
    best = copied(rows, key).select("hash", "canonical")
    return rows.join(best, "hash").where(F.col(key) != F.col("canonical")).select(F.col(key).alias("duplicate"), "canonical", "hash")


def resolve_aliases(aliases: DataFrame, rounds: int = 20) -> DataFrame:
    """Each alias (src, dst) with the end of its chain; a chain that returns to itself stops where it would repeat. Chains are
    doubled each round, so 20 rounds follow a million steps."""
    from skeinlake.sources.tables import discard, staged

    stored, step = None, aliases.select("src", "dst")
    again = F.col("beyond").isNotNull() & (F.col("beyond") != F.col("src"))
    for _ in range(rounds):
        far = step.select(F.col("src").alias("dst"), F.col("dst").alias("beyond"))
        moved = step.join(far, "dst", "left").select("src", F.when(again, F.col("beyond")).otherwise(F.col("dst")).alias("dst"), again.alias("moved"))
        moved = staged(moved, "aliases")  # else each round would repeat all before it, twice
        discard(stored)
        stored, step = moved, moved.select("src", "dst")
        if moved.where("moved").isEmpty():
            break
    return step


def verdict(errors: DataFrame, *by: str) -> DataFrame:
    """passed if there is no error; the sorted error codes. errors: by..., error (null: none)."""
    codes = F.array_sort(F.collect_set("error"))
    return errors.groupBy(*by).agg(codes.alias("codes")).select(*by, (F.size("codes") == 0).alias("passed"), F.array_join("codes", ",").alias("codes"))


def merge_evidence(target: DataFrame, incoming: DataFrame, prefix: str) -> DataFrame:
    """Evidence (pos, evidence_id, collection, source_url, title) of target and then of incoming, first wins on (collection, URL, title),
    nulls equal; new rows are numbered on from the target's rows of that prefix. What is the same is one row (the least by pos, then id) before it is
    shuffled, by a digest in place of whole titles, so that no group of copies meets in a task."""
    from skeinlake.sources.tables import running_total

    same = F.sha2(F.to_json(F.struct("collection", "source_url", "title")), 256).alias("__same")  # leaves nulls out
    first = incoming.groupBy(same).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in incoming.columns]), F.struct("pos", "evidence_id")).alias("__row"))
    new = first.join(target.select(same).distinct(), "__same", "left_anti").select("__row.*")
    start = target.agg(F.count_if(F.col("evidence_id").startswith(prefix)).alias("start"))
    numbered = running_total(new, "__number", F.col("pos"))
    named = numbered.crossJoin(F.broadcast(start)).withColumn("evidence_id", F.concat(F.lit(prefix), F.col("__number") + F.col("start"))).drop("__number", "start")  # one row
    return target.withColumn("side", F.lit(0)).unionByName(named.withColumn("side", F.lit(1)))


def plan_fingerprint(rows: DataFrame, by: str, key: str, sha: str) -> DataFrame:
    """by, fingerprint: the hash of a group's buckets' hashes, in order; a bucket's hash is of its key:sha lines, in order. There are 65,536 buckets, by
    the first digits of the key's hash, so that neither they nor their lines are ever a group's whole."""
    line = F.concat_ws(":", F.col(key).cast("string"), F.col(sha))
    bucket = F.left(F.sha2(F.col(key).cast("string"), 256), F.lit(4))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l")))), lambda s: s["l"])
    inner = rows.groupBy(by, bucket.alias("bucket")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("h"))
    hashes = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda s: s["h"])
    return inner.groupBy(by).agg(F.sha2(F.array_join(hashes, "\n"), 256).alias("fingerprint"))


def running_budget(rows: DataFrame, by: str, budget: int, text: str, *order: Column) -> DataFrame:
    """Rows in order while the texts before leave room; the last one is cut to what is left; numbered anew. A text takes a letter at
    least, so no group's rows beyond the first `budget` matter: they go before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = rows.where(F.length(text) > 0).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= budget).drop("__r")
    used = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("__left", F.lit(budget) - used).where((F.col("__left") > 0) & (F.length(text) > 0))
    return kept.withColumn(text, F.left(text, F.col("__left").cast("int"))).withColumn("number", F.row_number().over(w)).drop("__left")


def number_runs(lines: DataFrame, doc: str, least: int = 5) -> DataFrame:
    """lines (doc, pos, line, in_code) without runs of line numbers: a run is digits-only lines outside code, blank lines between
    allowed; it goes, blanks and all, if it has `least` numbers and each is one more than the last."""
    strip = T.strip(F.col("line"))
    digit, blank = strip.rlike("^[0-9]+$") & ~F.col("in_code"), (strip == "") & ~F.col("in_code")
    w = Window.partitionBy(doc).orderBy("pos")
    rows = lines.withColumn("__d", digit).withColumn("__other", (~digit & ~blank).cast("int")).withColumn("__zone", F.sum("__other").over(w))
    inside = rows.where("__other = 0")
    zone = Window.partitionBy(doc, "__zone").orderBy("pos")
    # A run starts at its first number: blanks before it stay.
    inside = inside.withColumn("__begun", F.sum(F.col("__d").cast("int")).over(zone)).withColumn("__value", F.when(F.col("__d"), F.try_to_number(strip, F.lit("9" * 18)).cast("long")))
    numbers = inside.where("__d").withColumn("__gap", F.col("__value") - F.lag("__value").over(zone))
    good = numbers.groupBy(doc, "__zone").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("__gap"), F.lit(1)) != 1).alias("bad")).where(f"n >= {least} AND bad = 0").select(doc, "__zone")
    gone = inside.where("__begun > 0").join(good, [doc, "__zone"]).select(doc, "pos")
    return lines.join(gone, [doc, "pos"], "left_anti")
