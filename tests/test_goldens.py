"""Figures worked out by hand from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import text as T
from skeinlake.operators import curation as C
from skeinlake.operators import evaluation as E
from skeinlake.operators import learner as L
from skeinlake.operators import retrieval as R
from skeinlake.operators import sessions as S


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_tokens(spark):
    got = one(spark, T.ranking_tokens(F.lit("动态规划 dp 树 C++ two-sum")), T.token_estimate(F.lit("算法")), T.token_estimate(F.lit("abcdefgh")), S.message_tokens(F.lit("算法")), T.token_estimate(F.lit("")), T.token_estimate(F.lit("a算")))
    assert list(got) == [["dp", "c++", "two-sum", "动态规划", "动态", "态规", "规划", "树"], 2, 2, 6, 1, 2]


def test_identifier_scores(spark):
    chunks = spark.createDataFrame([("c167", "two-sum-ii", "Two Sum II", 167), ("c1", "two-sum", "Two Sum", 1), ("c15", "3sum", "3Sum", 15)], "chunk_id string, document_id string, title string, problem_id long")
    meta = F.concat(F.lit('{"problem_id": '), F.col("problem_id").cast("string"), F.lit("}"))
    own = R.records(chunks, "chunk_id", F.col("title"), F.lit(""), meta, F.col("problem_id"), F.col("document_id"))
    query = spark.range(1).select(F.lit(1).alias("query_id"), T.ranking_tokens(F.lit("leetcode two sum lc-id-1 lc-id-1 lc-id-1")).alias("tokens"))
    got = {r["chunk_id"]: r["score"] for r in R.bm25(own, query).collect()}
    assert set(got) == {"c1", "c167"}
    assert got["c1"] == pytest.approx(7.761390, abs=1e-5) and got["c167"] == pytest.approx(1.510052, abs=1e-5)


def test_fused_ranks(spark):
    rows = lambda rs: spark.createDataFrame([(1, d, d, r, s) for d, r, s in rs], "query_id int, document_id string, chunk_id string, rank int, score double")
    fused = R.fuse(rows([("a", 1, 0.9), ("b", 2, 0.8)]), rows([("b", 1, 12.0), ("c", 2, 10.0)])).orderBy("rank").collect()
    assert [(r["document_id"], r["rrf_score"]) for r in fused] == [("b", round(1 / 62 + 1 / 61, 8)), ("a", round(1 / 61, 8)), ("c", round(1 / 62, 8))]


def test_knowledge_tracing(spark):
    got = one(spark, *[L.bkt(F.lit(0.25), F.lit(s)) for s in (1.0, 0.0, 0.35, 0.2)])
    assert list(got) == pytest.approx([0.652, 0.1648, 0.33532, 0.26224], abs=1e-6)
    rows = spark.createDataFrame([(1, "2024-01-01", i, o) for i, o in enumerate(("correct", "incorrect", "correct"))], "u int, ts string, seq int, outcome string")
    assert L.fold_mastery(rows.withColumn("ts", F.to_timestamp("ts")), "u").first()["mastery"] == 0.6983115142768787


def test_item_response(spark):
    got = one(spark, *[L.irt(F.lit(0.0), F.lit(b)) for b in (-1.0, 0.0, 1.1)], *[L.ability(F.lit(0.0), F.lit(b), F.lit(1.0), F.lit(0.95)) for b in (-1.0, 0.0, 1.1)])
    assert list(got) == pytest.approx([0.768525, 0.5, 0.210818, 0.092359, 0.1995, 0.314884], abs=1e-6)


def test_schedule(spark):
    first = [L.schedule(*lit(0.0, 5.0, r, 0.0)) for r in (1, 2, 3)]
    later = [L.schedule(*lit(2.5, 5.0, r, 3.0)) for r in (3, 1)]
    got = [tuple(x) for x in one(spark, *first, *later)]
    assert got[:3] == [(0.4, 5.6, 1), (1.0, 5.3, 1), (2.5, 5.0, 2)]
    assert got[3] == (pytest.approx(3.5050395373), 5.0, 4) and got[4] == (pytest.approx(0.9554625723), 5.6, 1)


def test_signals(spark):
    said = ["我刚刚独立做对了一道中等难度的二分查找题，没有看提示。", "打家劫舍没做出来", "滑动窗口题我不会，请先只给我提示。", "解释一下二分查找为什么是 O(log n)。"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(L.detect_outcome(F.col("s")).alias("o"), L.detect_concepts(F.col("s")).alias("c")).collect()
    assert [r["o"] for r in got] == ["correct", "incorrect", "hinted", None]
    assert [r["c"] for r in got] == [["二分查找"], ["动态规划"], ["滑动窗口"], ["二分查找"]]


def test_fusion_order(spark):
    row = "query_id int, document_id string, chunk_id string, rank int, score double"
    dense = spark.createDataFrame([(1, "a", "a", 1, 0.9), (1, "b", "b", 2, 0.8)], row)
    sparse = spark.createDataFrame([(1, "b", "b", 1, 12.0), (1, "c", "c", 2, 10.0)], row)
    got = R.fuse(dense, sparse).orderBy("rank").collect()
    assert [(r["document_id"], r["rrf_score"]) for r in got] == [("b", 0.03252247), ("a", 0.01639344), ("c", 0.01612903)]
    assert (got[0]["dense_rank"], got[0]["bm25_rank"]) == (2, 1)
    assert R.fuse(dense, dense.limit(0)).count() == 2
    doubled = spark.createDataFrame([(1, "a", "a1", 1, 0.9), (1, "a", "a2", 2, 0.8)], row)
    assert R.fuse(doubled, doubled).count() == 1


def test_case_metrics(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id int")
    ranking = spark.createDataFrame([(1, "wrong-a", 1), (1, "expected", 2), (1, "wrong-b", 3)], "case_id int, document_id string, rank int")
    rel = spark.createDataFrame([(1, "expected", 3)], "case_id int, document_id string, grade int")
    got = {r["case_id"]: r for r in E.case_metrics(cases, ranking, rel, [3]).collect()}
    m = got[1]
    assert (m["hit"], m["precision"], m["recall"], m["reciprocal_rank"], m["average_precision"]) == (1, pytest.approx(1 / 3), 1, 0.5, 0.5)
    assert m["ndcg"] == pytest.approx(1 / math.log2(3)) and got[2]["relevant"] == 0 and got[2]["ndcg"] == 0


def test_filtered_rerank(spark):
    rows = spark.createDataFrame([(1, "late", 8, 1), (1, "early-b", 3, 2), (1, "early-a", 1, 3)], "case_id int, document_id string, vector_rank int, rank int")
    assert [r["document_id"] for r in E.filtered(rows, 5).orderBy("rank").collect()] == ["early-b", "early-a"]


def test_memory_is_kept_apart(spark):
    rows = spark.createDataFrame([(1, s, 1, "goal", "Learn  DP", i, "2024-01-01") for s, i in ((1, 0.9), (2, 0.9), (2, 0.5), (1, 0.95))], "user_id int, session_id int, seq int, kind string, content string, importance double, ts string")
    got = S.memory(rows.withColumn("ts", F.to_timestamp("ts"))).orderBy("session_id").collect()
    assert [(r["session_id"], r["importance"]) for r in got] == [(1, 0.95), (2, 0.9)] and got[0]["memory_id"] != got[1]["memory_id"]


def test_aliases_with_a_cycle(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7)], "src int, dst int")
    got = {r["src"]: r["dst"] for r in C.resolve_aliases(rows).collect()}
    assert got[1] == got[2] == got[3] == 4 and got[7] == 8 and got[8] == 7


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "chunk_id int, document_id string, tokens array<string>, len int")
    ask = spark.createDataFrame([(1, ["a"])], "query_id int, tokens array<string>")
    assert R.bm25(none, ask).count() == 0
    vectors = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0])], "vec_id int, embedding array<double>")
    probe = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in R.dense_topk(vectors, probe, 5).collect()] == [(3, 1.0)]
