"""Streaming twins against their batch plans, run in more than one batch."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from skeinlake.operators import learner as L
from skeinlake.operators.documents import common_length, gestalt, near_edges, replay
from skeinlake.operators.graph import connected_components
from skeinlake.streaming import stateful as St

SCHEMA = "session_id long, ts timestamp, seq long, action string, generation long"


@pytest.fixture
def events(spark, tmp_path):
    rows = spark.range(0, 60).select((F.col("id") % 3).alias("session_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"), F.when(F.col("id") % 9 < 3, "start").when(F.col("id") % 9 == 8, "complete").otherwise("update").alias("action"), F.when(F.col("id") % 5 == 0, F.lit(-1)).cast("long").alias("generation"))
    for i in range(3):
        rows.where(f"seq >= {20 * i} AND seq < {20 * i + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_progress(spark, events):
    batch = St.progress(spark.read.schema(SCHEMA).parquet(events)).where("accepted").select("session_id", F.col("current").alias("generation"), "sequence", "action", "seq")
    stream = St.finished(St.stream_progress(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(events)), "t")
    # Sorting within a batch can't mend order across batches: files come in order here.
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_mastery(spark, tmp_path):
    rows = spark.createDataFrame([(1, "c", i, ["correct", "incorrect", "hinted"][i % 3]) for i in range(9)], "user_id long, concept string, seq long, outcome string").withColumn("ts", F.timestamp_seconds("seq"))
    rows.coalesce(1).write.parquet(str(tmp_path / "o"))
    stream = St.finished(St.stream_mastery(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "o"))), "m").first()
    want = L.fold_mastery(rows, "user_id", "concept").first()
    assert stream["mastery"] == pytest.approx(want["mastery"], abs=1e-12) and stream["n"] == want["n"]


def test_incremental_index_counts_each_key_once(spark, tmp_path):
    for _ in range(2):
        spark.range(5).selectExpr("id AS k").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))
    assert St.incremental_index(stream, "k", lambda d: d.select("k"), "i").count() == 5


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_gestalt_is_difflib():
    rng = random.Random(1)
    for n in (0, 5, 90, 700):
        for letters in ("ab", "abcdefghijklmnop", "é東x"):
            a = "".join(rng.choice(letters) for _ in range(n))
            b = list(a)
            for _ in range(n // 20):
                b[rng.randrange(len(b))] = rng.choice(letters) * rng.randrange(3)
            b = "".join(b)
            want = difflib.SequenceMatcher(None, a, b, autojunk=False)
            assert gestalt(a, b) == want.ratio()
            assert 2 * common_length(a, b) >= want.ratio() * (len(a) + len(b)) - 1e-9


def test_near_edges_and_replay(spark):
    base = "abcdefghij klmnopq rstuvw xyz 0123456789 " * 8
    docs = spark.createDataFrame([(1, base), (2, base[:-3] + "!!!"), (3, base.upper()), (4, "other text entirely"), (5, None), (6, "")], "doc_id long, text string")
    got = [(r["left"], r["right"]) for r in near_edges(docs).collect()]
    assert got == [(1, 2)]
    import pandas as pd

    edges = pd.DataFrame([(1, 2, 0.99), (1, 3, 0.99), (2, 3, 0.99)], columns=["left", "right", "similarity"])
    assert replay(edges, {1: 10, 2: 12, 3: 11}) == {1: 2, 3: 2} or replay(edges, {1: 10, 2: 12, 3: 11}) == {1: 3, 3: 2}
