"""Keyed state on streams against batch plans over the same rows, cut into batches in several ways."""

import random

import pytest
from pyspark.sql import functions as F

from skeinlake.operators import sessions as O
from skeinlake.streaming import keyed as K
from skeinlake.streaming import stateful as St

SPLITS = ["whole", "in order", "mixed"]


def cut(rows, how, path):
    """A stream of the rows, a file a batch."""
    n = {"whole": 1, "in order": 3, "mixed": 4}[how]
    parts = [[] for _ in range(n)]
    rng = random.Random(n)
    data = rows.collect()
    for i, r in enumerate(data):
        parts[i * n // len(data) if how != "mixed" else rng.randrange(n)].append(r)
    for part in parts:
        rows.sparkSession.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(got, want):
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how", SPLITS)
def test_memories_begin_anew(spark, tmp_path, how):
    rng = random.Random(1)
    rows = [(rng.randrange(2), 7, i, rng.choice(["preference", "decision"]), rng.choice([" A  b", "a b", "c", " ", None, "d e"]), rng.choice([0.5, 0.6, 0.9, None]), i in (10, 25), i) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, session_id long, seq long, kind string, content string, importance double, reset boolean, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000)).drop("at")
    stream = cut(df, how, f"{tmp_path}/in")
    end = spark.createDataFrame([(9, 9, 0, "decision", "x", 1.0, None, 9_999)], "user_id long, session_id long, seq long, kind string, content string, importance double, reset boolean, at long")
    end.withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000)).drop("at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = K.run(K.memories(stream, cap=3, late="0 seconds" if how != "mixed" else "1 hour"), "t").where("user_id < 9").cache()
    last = got.groupBy("user_id", "session_id").agg(F.max("step").alias("step"))
    since = df.groupBy("user_id").agg(F.max(F.when(F.col("reset"), F.col("seq"))).alias("since"))
    left = df.join(since, "user_id").where("since is null or seq >= since")
    columns = ["user_id", "memory_id", "kind", "content", "importance", "created_at", "updated_at", "place"]
    want = O.memory(left, cap=3).withColumn("place", F.col("place").cast("long")).select(*columns)
    same(got.join(last, ["user_id", "session_id", "step"]).where("place > 0").select(*columns), want)
    if how == "in order":  # after each batch, what the rows until then make
        for step, n in ((1, 20), (2, 40)):
            some = df.where(f"seq < {n}")
            since = some.groupBy("user_id").agg(F.max(F.when(F.col("reset"), F.col("seq"))).alias("since"))
            want = O.memory(some.join(since, "user_id").where("since is null or seq >= since"), cap=3)
            same(got.where(f"step = {step} and place > 0").select("memory_id", "content", "importance"), want.select("memory_id", "content", "importance"))


@pytest.mark.parametrize("how", SPLITS)
def test_expiry_is_that_of_the_watermark(spark, tmp_path, how):
    rng = random.Random(2)
    rows = [(rng.randrange(12), i * 60, i) for i in range(90)] + [(50, 0, 900), (50, 0, 901)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "user_id long, at long, seq long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000)).drop("at")
    late = "2 hours" if how == "mixed" else "0 seconds"
    changes = K.run(K.expiring(cut(df, how, f"{tmp_path}/in"), "user_id", 900, late), "t").cache()
    watermark = F.timestamp_seconds(F.lit(1_000_000 + 89 * 60 - (7200 if how == "mixed" else 0)))
    same(K.still_set(changes).select(F.col("key").alias("user_id"), "seq"), St.alive(df, "user_id", 900, watermark).select("user_id", "seq"))
    assert changes.where("what = 'removed'").count() == changes.where("what = 'removed'").select("key", "seq").distinct().count()
    if how != "mixed":
        assert changes.where("what = 'removed'").count() > 0


@pytest.mark.parametrize("how", SPLITS)
def test_contexts_wait_for_the_watermark(spark, tmp_path, how):
    rng = random.Random(3)
    rows = [(i % 3, i, i, rng.choice(["user", "assistant", "system"]), rng.randrange(5, 200)) for i in range(80)]
    df = spark.createDataFrame(rows, "session_id long, at long, seq long, role string, tokens long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000)).drop("at")
    end = spark.createDataFrame([(99, 10_000, 0, "user", 1)], "session_id long, at long, seq long, role string, tokens long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000)).drop("at")
    stream = cut(df, how, f"{tmp_path}/in")
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # moves the watermark beyond all others
    got = K.run(K.contexts(stream, safe=3_900, late="0 seconds" if how != "mixed" else "1 hour"), "t").where("session_id < 99")
    same(got, O.compaction(df, safe=3_900))


@pytest.mark.parametrize("how", SPLITS)
def test_each_stream_ends_once(spark, tmp_path, how):
    rng = random.Random(4)
    starts = [(rng.randrange(4), i, i) for i in range(60)]
    cancels = [(k, at + 30, s) for k, at, s in starts if s % 3 == 0] + [(1, 5, 777)]
    made = lambda rows, name: cut(spark.createDataFrame(rows, "key long, at long, stream long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000)).drop("at"), how, f"{tmp_path}/{name}")
    got = K.run(K.ended_streams(made(starts * 2, "s"), made(cancels[::-1] + cancels, "c")), "t").collect()
    newest = {k: s for k, _, s in starts}
    assert sorted(tuple(r) for r in got) == sorted((k, s) for k, _, s in starts if s % 3 == 0 or newest[k] != s)


@pytest.mark.parametrize("how", SPLITS)
def test_keys_touched_last(spark, tmp_path, how):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.randrange(40), i // 2, i) for i in range(120)], "k long, ts long, seq long")
    path, seen = f"file://{tmp_path}/table", []
    stream = cut(df, how, f"{tmp_path}/in")
    got = K.recent_keys(stream, "k", 9, path, f"file://{tmp_path}/check", "ts", "seq", after=seen.append)
    same(got.select("k", "ts", "seq"), St.most_recent(df, "k", 9, "ts", "seq").select("k", "last.*"))
    if how == "in order":
        for n in seen:  # after each batch, and once more with a checkpoint that knows nothing of what is committed
            at = K.Table(spark, path).snapshot(n)
            same(K.Table(spark, path).read(at=at).select("k", "ts", "seq"), St.most_recent(df.where(f"seq < {40 * (n + 1)}"), "k", 9, "ts", "seq").select("k", "last.*"))
        again = K.recent_keys(stream, "k", 9, path, f"file://{tmp_path}/other", "ts", "seq")
        same(again.select("k", "ts", "seq"), got.select("k", "ts", "seq"))
        assert K.Table(spark, path).snapshot().version == len(seen) - 1
