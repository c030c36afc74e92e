"""Queries: evaluation of rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlake.operators import evaluation as E
from skeinlake.operators import retrieval as R
from skeinlake.sources.tables import staged

from .registry import Registry, table, texts
from .retrieval import ASKED_SQL, BM25_SQL, asked, stored, tokens_of

register = Registry()
KS = [1, 3, 5, 10]


def judged(spark, sf_dir):
    """Documents that hold a benchmark text, at grade 3."""
    patterns = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    return E.holders(table(spark, sf_dir, "documents"), patterns).select(F.col("pattern_id").alias("case_id"), F.col("doc_id").alias("document_id"), F.lit(3).alias("grade"))


def ranking(spark, sf_dir, keep=10):
    best = R.bm25_ranking(stored(spark, sf_dir), tokens_of(asked(spark, sf_dir)), keep=keep)
    return best.select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("document_id"), "rank", "score")


JUDGED_SQL = "rel AS (SELECT item_id AS case_id, doc_id AS document_id, 3 AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
RANKING_SQL = "rk AS (SELECT query_id AS case_id, chunk_id AS document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"
GRID_SQL = """ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
seen AS (SELECT rk.case_id, rank, coalesce(grade, 0) AS grade, CASE WHEN grade IS NULL THEN 0 ELSE 1 END AS hit FROM rk LEFT JOIN rel USING (case_id, document_id) WHERE rank <= 10),
run AS (SELECT *, sum(hit) OVER (PARTITION BY case_id ORDER BY rank) AS so_far FROM seen),
got AS (SELECT case_id, k, sum(hit) AS hits, min(rank) FILTER (hit = 1) AS first, sum(CASE WHEN hit = 1 THEN so_far::DOUBLE / rank ELSE 0e0 END) AS precisions, sum((pow(2e0, grade) - 1e0) / log2(rank + 1e0)) AS dcg FROM run, ks WHERE rank <= k GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, document_id) AS place FROM rel),
ideal AS (SELECT case_id, k, count(*) AS relevant, sum(CASE WHEN place <= k THEN (pow(2e0, grade) - 1e0) / log2(place + 1e0) ELSE 0e0 END) AS idcg FROM best, ks GROUP BY ALL),
m AS (SELECT c.item_id AS case_id, ks.k, coalesce(relevant, 0) AS relevant, coalesce(hits, 0) AS hits, first, coalesce(precisions, 0e0) AS precisions, coalesce(dcg, 0e0) AS dcg, coalesce(idcg, 0e0) AS idcg FROM benchmark c CROSS JOIN ks LEFT JOIN ideal ON ideal.case_id = c.item_id AND ideal.k = ks.k LEFT JOIN got ON got.case_id = c.item_id AND got.k = ks.k),
pc AS (SELECT case_id, k, relevant, CASE WHEN hits > 0 THEN 1e0 ELSE 0e0 END AS hit, hits::DOUBLE / k AS precision, CASE WHEN relevant > 0 THEN hits::DOUBLE / relevant ELSE 0e0 END AS recall, coalesce(1e0 / first, 0e0) AS reciprocal_rank, CASE WHEN relevant > 0 THEN precisions / least(relevant, k) ELSE 0e0 END AS average_precision, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0e0 END AS ndcg FROM m),
full_ AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM pc)"""


@register(f"WITH {BM25_SQL}, {JUDGED_SQL}, {RANKING_SQL}, {GRID_SQL} SELECT k, count(*) AS queries, " + ", ".join(f"round(avg({m}), 8) AS {m}" for m in E.METRICS) + " FROM full_ WHERE relevant > 0 GROUP BY k")
def eval_metrics_by_k(spark, sf_dir):
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"))
    return E.macro(E.case_metrics(cases, ranking(spark, sf_dir), judged(spark, sf_dir), KS), "k")


@register(f"WITH {BM25_SQL}, {JUDGED_SQL}, {RANKING_SQL}, {GRID_SQL} SELECT case_id, k, relevant, " + ", ".join(f"round({m}, 8) AS {m}" for m in E.METRICS) + " FROM full_")
def eval_metrics_per_case(spark, sf_dir):
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"))
    return E.case_metrics(cases, ranking(spark, sf_dir), judged(spark, sf_dir), KS).select("case_id", "k", F.col("relevant").cast("long").alias("relevant"), *[F.round(m, 8).alias(m) for m in E.METRICS])


_RERANKED_SQL = "rr AS (SELECT case_id, document_id, rank AS vector_rank, row_number() OVER (PARTITION BY case_id ORDER BY (document_id * 7919 % 1000) DESC, document_id) AS rank FROM rk WHERE rank <= 20)"


def _reranked(spark, sf_dir):
    """A stand-in reranker over the first twenty."""
    own = ranking(spark, sf_dir, keep=20).withColumnRenamed("rank", "vector_rank").drop("score")
    return R.ranked(own, "case_id", (F.col("document_id") * 7919 % 1000).desc(), F.col("document_id"))


@register(f"WITH {BM25_SQL}, {RANKING_SQL}, {_RERANKED_SQL}, f AS (SELECT case_id, document_id, vector_rank, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS rank FROM rr WHERE vector_rank <= 5) SELECT * FROM f")
def eval_filtered_rerank(spark, sf_dir):
    return E.filtered(_reranked(spark, sf_dir), 5).select("case_id", "document_id", F.col("vector_rank").cast("long").alias("vector_rank"), F.col("rank").cast("long").alias("rank"))


@register(f"""WITH {BM25_SQL}, {JUDGED_SQL}, {RANKING_SQL}, {_RERANKED_SQL}, grid AS (SELECT * FROM (VALUES (5, 1), (5, 3), (5, 5), (20, 3)) AS t(candidate_k, final_k)),
f AS (SELECT candidate_k, final_k, case_id, document_id, row_number() OVER (PARTITION BY candidate_k, final_k, case_id ORDER BY rank) AS rank FROM rr, grid WHERE vector_rank <= candidate_k),
c AS (SELECT DISTINCT case_id FROM rel), h AS (SELECT candidate_k, final_k, f.case_id, min(rank) AS first FROM f JOIN rel USING (case_id, document_id) WHERE rank <= final_k GROUP BY ALL)
SELECT g.candidate_k, g.final_k, count(*) AS queries, round(avg(CASE WHEN first IS NULL THEN 0e0 ELSE 1e0 END), 8) AS hit, round(avg(coalesce(1e0 / first, 0e0)), 8) AS mrr FROM grid g CROSS JOIN c LEFT JOIN h ON h.case_id = c.case_id AND h.candidate_k = g.candidate_k AND h.final_k = g.final_k GROUP BY ALL""")
def eval_candidate_final_grid(spark, sf_dir):
    """Hit and MRR for each (candidates, final) pair, from one reranking."""
    grid = spark.createDataFrame([(5, 1), (5, 3), (5, 5), (20, 3)], "candidate_k int, final_k int")
    rel = staged(judged(spark, sf_dir), "judged")  # read twice: texts are searched once
    kept = _reranked(spark, sf_dir).join(F.broadcast(grid), F.col("vector_rank") <= F.col("candidate_k"))  # four rows
    placed = R.ranked(kept.drop("rank").withColumn("order", F.col("document_id") * 7919 % 1000), ["candidate_k", "final_k", "case_id"], F.col("order").desc(), F.col("document_id"))
    first = placed.where("rank <= final_k").join(rel, ["case_id", "document_id"]).groupBy("candidate_k", "final_k", "case_id").agg(F.min("rank").alias("first"))
    cases = rel.select("case_id").distinct().crossJoin(F.broadcast(grid))
    out = cases.join(first, ["candidate_k", "final_k", "case_id"], "left").groupBy("candidate_k", "final_k")
    return out.agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("first").isNull(), 0.0).otherwise(1.0)), 8).alias("hit"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 8).alias("mrr"))


@register(f"""WITH {BM25_SQL}, {JUDGED_SQL}, {RANKING_SQL}, top AS (SELECT rk.*, d.lang, d.source FROM rk JOIN documents d ON d.doc_id = rk.document_id WHERE rank <= 10 AND score >= 25),
c AS (SELECT item_id AS case_id, item_id IN (SELECT case_id FROM rel) AS positive FROM benchmark),
per AS (SELECT c.case_id, positive, count(document_id) AS n, count(DISTINCT source) AS sources, count(*) FILTER (lang <> 'en') AS wrong FROM c LEFT JOIN top USING (case_id) GROUP BY ALL)
SELECT round(avg(CASE WHEN n = 0 THEN 1e0 ELSE 0e0 END), 8) AS empty_rate, round(sum(wrong)::DOUBLE / sum(n), 8) AS wrong_collection_rate, round(avg(CASE WHEN n = 0 THEN 0e0 ELSE 1e0 - sources::DOUBLE / n END), 8) AS raw_duplicate_rate, round(avg(CASE WHEN NOT positive THEN CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END END), 8) AS negative_return_rate FROM per""")
def eval_operational_rates(spark, sf_dir):
    """Of rankings cut at score 25: none returned; another collection than en; repeated sources; negatives that return something."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source")
    top = ranking(spark, sf_dir).where("score >= 25").join(docs, "document_id")
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id")).join(judged(spark, sf_dir).select("case_id", F.lit(True).alias("positive")).distinct(), "case_id", "left")
    per = cases.join(top, "case_id", "left").groupBy("case_id", "positive").agg(F.count("document_id").alias("n"), F.countDistinct("source").alias("sources"), F.count_if(F.col("lang") != "en").alias("wrong"))
    some = F.when(F.col("n") > 0, 1.0).otherwise(0.0)
    return per.agg(F.round(F.avg(1.0 - some), 8).alias("empty_rate"), F.round(F.sum("wrong") / F.sum("n"), 8).alias("wrong_collection_rate"), F.round(F.avg(F.when(F.col("n") == 0, 0.0).otherwise(1.0 - F.col("sources") / F.col("n"))), 8).alias("raw_duplicate_rate"), F.round(F.avg(F.when(F.col("positive").isNull(), some)), 8).alias("negative_return_rate"))


@register("""WITH p AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS calls, min(value) AS min, median(value) AS median, max(value) FILTER (i = greatest(1, round_even(n * 0.95, 0)::BIGINT)) AS p95, max(value) AS max FROM p GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return E.latency(table(spark, sf_dir, "events"), "value", "event_type")


@register("WITH p AS (SELECT min(doc_id) AS pattern_id, pattern FROM (SELECT doc_id, substr(text, 1, 20 + doc_id % 90) AS pattern FROM documents WHERE text <> '') GROUP BY pattern) SELECT pattern_id, count(*) AS documents, min(doc_id) AS first FROM p JOIN documents d ON contains(d.text, p.pattern) GROUP BY pattern_id")
def opening_holders(spark, sf_dir):
    """Which documents hold the first 20 to 109 letters of each, copies' openings once: how many, and the first of them. There are about as many strings
    as documents, and near copies hold one another's, so they are counted where the texts are."""
    docs = texts(spark, sf_dir)
    begin = F.substr("text", F.lit(1), (20 + F.col("doc_id") % 90).cast("int"))
    openings = table(spark, sf_dir, "documents").groupBy(begin.alias("pattern")).agg(F.min("doc_id").alias("pattern_id"))
    return E.counted_holders(docs, openings)
