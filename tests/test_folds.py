"""Table functions in SQL: batches and mastery against plain loops, odd rows, clashing names."""

import random

import pytest
from pyspark.errors import AnalysisException

from skeinlake.functions import markdown as M
from skeinlake.operators import folds


def test_batches_in_sql(spark):
    folds.register(spark)
    rng = random.Random(3)
    rows = [(rng.choice(("a", "b", None)), i, rng.choice((0, 1, 30, 70, 500, None)), "extra") for i in range(300)] + [("a", 7, 5, "tie")]
    spark.createDataFrame(rows, "k string, pos int, tokens long, other string").createOrReplaceTempView("sized")
    got = spark.sql("SELECT * FROM token_batches(TABLE(SELECT * FROM sized) PARTITION BY k ORDER BY (pos, other), 4, 100)")
    assert got.columns == ["k", "pos", "tokens", "other", "batch"]
    found = {(r["k"], r["pos"], r["other"]): r["batch"] for r in got.collect()}
    for k in ("a", "b", None):
        own = sorted(((p, o, n or 0) for kk, p, n, o in rows if kk == k))
        assert [found[k, p, o] for p, o, _ in own] == M.batches([n for *_, n in own], 4, 100)
    assert len(found) == len(rows)
    assert spark.sql("SELECT * FROM token_batches(TABLE(SELECT * FROM sized WHERE false) PARTITION BY k ORDER BY (pos), 4, 100)").count() == 0
    for bad in ("SELECT k, pos FROM sized", "SELECT k, pos, tokens, 1 AS batch FROM sized"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM token_batches(TABLE({bad}) PARTITION BY k ORDER BY (pos), 4, 100)").collect()


def test_mastery_in_sql(spark):
    folds.register(spark)
    spark.createDataFrame([("u", 1, 1.0), ("u", 2, None), ("u", 3, 0.0), ("u", 4, 1.0), (None, 1, 0.35)], "k string, pos int, score double").createOrReplaceTempView("seen")
    got = {(r["k"], r["pos"]): r["mastery"] for r in spark.sql("SELECT * FROM mastery_path(TABLE(SELECT * FROM seen) PARTITION BY k ORDER BY pos)").collect()}
    assert got["u", 1] == got["u", 2] == pytest.approx(0.652, abs=1e-9)
    assert got["u", 4] == pytest.approx(0.6983115142768787, abs=1e-12)
    assert got[None, 1] == pytest.approx(0.33532, abs=1e-6)
