"""Queries: retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions import text as T
from skeinlake.operators import retrieval as R
from skeinlake.operators.answers import Answers
from skeinlake.operators.postings import Postings, StaleIndex, signature
from skeinlake.sources.tables import fresh_path, staged

from . import sqltext as S
from .registry import Registry, said, said_sql, table, texts

register = Registry()


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: title := source, metadata := the language as JSON."""
    return _records(texts(spark, sf_dir))


def _records(docs: DataFrame) -> DataFrame:
    meta = F.concat(F.lit('{"lang": "'), F.col("lang"), F.lit('"}'))
    return R.records(docs, "doc_id", F.col("source"), F.col("text"), meta, F.lit(None).cast("long"), F.col("doc_id").cast("string"))


#: Where this application has put the index of a folder's documents.
_PLACES: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> R.Index:
    """The documents' index: made once, opened by the queries, made anew once the documents' files are others."""
    at = (spark.sparkContext.applicationId, sf_dir)
    own = Postings(spark, _PLACES.setdefault(at, fresh_path(spark, "postings")))
    source = signature(spark, f"{sf_dir}/documents.parquet")
    try:
        return own.open(source)
    except StaleIndex:
        return own.build(index(spark, sf_dir), source)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text is a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def tokens_of(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", T.ranking_tokens(T.expand_query(F.col("query"))).alias("tokens"))


_RECORD = "list_concat(" + S.ranking_tokens("concat_ws(' ', source, source, source, '{\"lang\": \"' || lang || '\"}', text)") + ", list_transform(range(4), lambda i: 'doc-id-' || doc_id))"
INDEX_SQL = f"idx AS (SELECT doc_id AS chunk_id, doc_id::VARCHAR AS document_id, {_RECORD} AS tokens FROM documents)"
ASKED_SQL = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
#: Benchmark queries name no problem numbers at their start; the pattern stays for those that do.
_NUMBERS = "list_concat(regexp_extract_all(query, '(?i)(?:leetcode|力扣|lc|题号)\\s*[#第]?\\s*([0-9]{1,6})', 1), regexp_extract_all(query, '(?i)^\\s*#?([0-9]{1,6})(?:\\s|[.、：:])', 1))"
_EXPANDED = f"concat_ws(' ', {S.expand_aliases('query')}, nullif(array_to_string(flatten(list_transform({_NUMBERS}, lambda n: list_transform(range(8), lambda i: 'lc-id-' || n))), ' '), ''))"
BM25_SQL = f"""
{INDEX_SQL}, {ASKED_SQL},
st AS (SELECT count(*) AS n, avg(len(tokens)) AS al FROM idx),
tf AS (SELECT term, chunk_id, document_id, l, count(*) AS tf FROM (SELECT chunk_id, document_id, len(tokens) AS l, unnest(tokens) AS term FROM idx) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({S.ranking_tokens(_EXPANDED)}) AS term FROM asked) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, document_id, round(sum(qtf * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (1e0 - 75e-2 + 75e-2 * l / al))), 6) AS score
           FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL HAVING score > 0)"""


@register(f"WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) SELECT query_id, document_id, score, rank FROM r WHERE rank <= 5")
def bm25_top5(spark, sf_dir):
    best = R.bm25_ranking(stored(spark, sf_dir), tokens_of(asked(spark, sf_dir)), fetch=60, keep=5)
    return best.select("query_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


_LEFT_SQL = BM25_SQL.replace("FROM documents", "FROM (SELECT doc_id, source, lang, CASE WHEN doc_id % 7 = 0 THEN 'amended ' || text ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)")


@register(f"WITH {_LEFT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) SELECT query_id, document_id, score, rank FROM r WHERE rank <= 5")
def bm25_after_changes(spark, sf_dir):
    """An index of all documents, some of which are then amended and some deleted; opened again, it answers as one of what is left."""
    own = Postings(spark, fresh_path(spark, "changing"))
    own.build(index(spark, sf_dir), "all")
    some = texts(spark, sf_dir).where("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("amended "), "text"))
    own.add(_records(some), "amended")
    own.delete(table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").alias("chunk_id")), "left")
    best = R.bm25_ranking(Postings(spark, own.table.path).open("left"), tokens_of(asked(spark, sf_dir)), fetch=60, keep=5)
    return best.select("query_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


@register(f"WITH {BM25_SQL} SELECT query_id, document_id, score FROM scored")
def bm25_score_all(spark, sf_dir):
    return R.bm25(stored(spark, sf_dir), tokens_of(asked(spark, sf_dir))).select("query_id", "document_id", "score")


@register(f"WITH {INDEX_SQL}, t AS (SELECT unnest(tokens) AS term FROM idx) SELECT (SELECT count(*) FROM idx) AS n_docs, round((SELECT avg(len(tokens)) FROM idx), 6) AS avg_len, (SELECT count(DISTINCT term) FROM t) AS n_terms, (SELECT count(*) FROM t) AS n_tokens")
def bm25_corpus_stats(spark, sf_dir):
    own = index(spark, sf_dir)
    words = own.select(F.explode("tokens").alias("term")).agg(F.countDistinct("term").alias("n_terms"), F.count("*").alias("n_tokens"))
    return R.corpus_stats(own).select("n_docs", F.round("avg_len", 6).alias("avg_len")).crossJoin(words)  # one row each


@register(f"WITH {INDEX_SQL}, df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM idx) GROUP BY term), n AS (SELECT count(*) AS n FROM idx) SELECT term, df, round(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)), 8) AS idf FROM df, n ORDER BY df DESC, term LIMIT 50")
def idf_top_terms(spark, sf_dir):
    """The 50 terms that most documents have."""
    own = index(spark, sf_dir)
    return R.document_frequency(own).crossJoin(F.broadcast(own.agg(F.count("*").alias("n")))).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 8).alias("idf")).orderBy(F.desc("df"), "term").limit(50)


#: Documents as problems by their number, and a question for each fiftieth of them.
_BOOSTED = "list_concat(" + S.ranking_tokens("concat_ws(' ', source, source, source, '{\"problem_id\": ' || doc_id || '}', text)") + ", list_concat(list_transform(range(8), lambda i: 'lc-id-' || doc_id), list_transform(range(4), lambda i: 'doc-id-' || doc_id)))"
_NUMBERED_SQL = BM25_SQL.replace(_RECORD, _BOOSTED).replace(ASKED_SQL, "asked AS (SELECT doc_id AS query_id, 'leetcode ' || doc_id AS query FROM documents WHERE doc_id % 50 = 0)")


@register(f"WITH {_NUMBERED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) SELECT query_id, document_id, score, rank, l AS len FROM r JOIN (SELECT DISTINCT chunk_id, l FROM tf) USING (chunk_id) WHERE rank <= 3")
def bm25_identifier_boost(spark, sf_dir):
    """Questions that name a problem by its number find it first, by the identifiers that record and question repeat."""
    docs = texts(spark, sf_dir)
    meta = F.concat(F.lit('{"problem_id": '), F.col("doc_id").cast("string"), F.lit("}"))
    own = R.records(docs, "doc_id", F.col("source"), F.col("text"), meta, F.col("doc_id"), F.col("doc_id").cast("string"))
    queries = table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("leetcode "), F.col("doc_id").cast("string")).alias("query"))
    best = R.bm25_ranking(own, tokens_of(queries), fetch=60, keep=3)
    return best.join(own.select("chunk_id", F.col("len").cast("long").alias("len")), "chunk_id").select("query_id", "document_id", "score", F.col("rank").cast("long").alias("rank"), "len")


#: Tokens of queries (lt) and documents (dt), and the score of pairs of q and c.
_LEX_TOKENS = f"qs AS (SELECT query_id, {S.expand_aliases('query')} AS q FROM asked), lt AS (SELECT query_id, q, {S.squeeze('lower(q)')} AS compact, {S.lexical_tokens('q')} AS tokens FROM qs), dt AS (SELECT doc_id, lower(concat_ws(' ', source, text)) AS c, {S.lexical_tokens("lower(concat_ws(' ', source, text))")} AS words FROM documents)"
_LEX_SCORE = """CASE WHEN compact <> '' AND contains(c, compact) THEN 12e0 ELSE 0e0 END
  + CASE WHEN len(list_intersect(tokens, words)) > 0 THEN list_sum(list_transform(list_intersect(tokens, words), lambda t: CASE WHEN length(t) > 2 THEN 2e0 ELSE 1e0 END)) + 4e0 * len(list_intersect(tokens, words)) / len(tokens) ELSE 0e0 END"""


def searched(spark, sf_dir):
    """Documents as the fallback's index has them: title and whole text."""
    return texts(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.concat_ws(" ", "source", "text").alias("search_text"), F.col("doc_id").alias("input_pos"))


@register(f"""WITH {ASKED_SQL}, {_LEX_TOKENS}, s AS (SELECT query_id, doc_id, round({_LEX_SCORE}, 6) AS score FROM lt, dt), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id AS document_id, score, rank FROM r WHERE rank <= 5""")
def lexical_fallback_topk(spark, sf_dir):
    """All benchmark queries against whole documents."""
    best = R.lexical_ranking(searched(spark, sf_dir), asked(spark, sf_dir), 5)
    return best.select("query_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


_ZH = ["动态规划 dp 树 C++ two-sum", "链表 和 二叉树 Array", "plain text", "二分查找两数之和", ""]


@register(f"WITH t AS ({said_sql(_ZH)}) SELECT conv_id, turn, {S.expand_aliases('s')} AS expanded FROM t")
def alias_expand(spark, sf_dir):
    return said(spark, sf_dir, _ZH).select("conv_id", "turn", T.expand_aliases(F.col("s")).alias("expanded"))


@register(f"WITH t AS ({said_sql(_ZH)}) SELECT conv_id, turn, array_to_string({S.ranking_tokens('s')}, ' ') AS ranking, array_to_string(list_sort({S.lexical_tokens('s')}), ' ') AS lexical FROM t")
def cjk_bigrams(spark, sf_dir):
    s = F.col("s")
    return said(spark, sf_dir, _ZH).select("conv_id", "turn", F.array_join(T.ranking_tokens(s), " ").alias("ranking"), F.array_join(F.array_sort(T.lexical_tokens(s)), " ").alias("lexical"))


_NUMBERED = ["LeetCode 15 three sum", "力扣第 3 题", "42. trapping rain water", "no number", "lc #7"]


@register(f"WITH t AS (SELECT conv_id, turn, s AS query FROM ({said_sql(_NUMBERED)})) SELECT conv_id, turn, {_EXPANDED} AS expanded FROM t")
def query_identifier_expand(spark, sf_dir):
    return said(spark, sf_dir, _NUMBERED).select("conv_id", "turn", T.expand_query(F.col("s")).alias("expanded"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _probes(spark, sf_dir):
    """The stated query set: every vector whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@register(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10")
def dense_topk_cosine(spark, sf_dir):
    best = R.dense_topk(table(spark, sf_dir, "embeddings"), _probes(spark, sf_dir), 10)
    return best.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@register(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS library, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, library, vec_id, score, rank FROM r WHERE rank <= 5")
def dense_topk_per_library(spark, sf_dir):
    """Each probe searches its own library (label)."""
    best = R.dense_topk(table(spark, sf_dir, "embeddings"), _probes(spark, sf_dir), 5, by="label")
    return best.select("query_id", F.col("label").alias("library"), "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@register(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), k AS (SELECT query_id, 1e0 - count(DISTINCT label) / count(*) AS rate FROM r WHERE rank <= 30 GROUP BY query_id) SELECT query_id, round(rate, 8) AS duplicate_rate FROM k")
def dense_raw_duplicate_rate(spark, sf_dir):
    """Documents := labels: the share of repeats among the first 30 chunks of each probe."""
    vectors = table(spark, sf_dir, "embeddings")
    best = R.dense_topk(vectors, _probes(spark, sf_dir), 30).join(vectors.select("vec_id", "label"), "vec_id")
    return best.groupBy("query_id").agg(F.round(1.0 - F.countDistinct("label") / F.count("*"), 8).alias("duplicate_rate"))


@register("SELECT label AS library, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS right_size, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0) AS finite, count(*) FILTER (list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0) AS positive, min(len(embedding)) = max(len(embedding)) AS one_dimension FROM embeddings GROUP BY label")
def vector_integrity(spark, sf_dir):
    e = F.col("embedding")
    norm = F.aggregate(F.transform(e.cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    finite = ~F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("library")).agg(F.count("*").alias("n"), F.count_if(F.size(e) == 64).alias("right_size"), F.count_if(finite).alias("finite"), F.count_if(norm > 0).alias("positive"), (F.min(F.size(e)) == F.max(F.size(e))).alias("one_dimension"))


#: Dense ranking of benchmark item i: the vectors nearest to vector i stand for the documents of those ids.
DENSE_SQL = f"dense AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id::VARCHAR AS document_id, b.vec_id AS chunk_id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN benchmark q ON a.vec_id = q.item_id, embeddings b) WHERE rank <= 20)"
SPARSE_SQL = "sparse AS (SELECT * FROM (SELECT query_id, document_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 20)"
FUSED_SQL = """both_ AS (SELECT *, 0 AS source FROM dense UNION ALL SELECT *, 1 AS source FROM sparse),
fused AS (SELECT query_id, document_id, round(sum(1e0 / (60 + rank)), 8) AS rrf_score, min(rank) AS best_rank, max(rank) FILTER (source = 0) AS dense_rank, max(score) FILTER (source = 0) AS dense_score, max(rank) FILTER (source = 1) AS bm25_rank, max(score) FILTER (source = 1) AS bm25_score FROM both_ GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, best_rank, document_id) AS rank FROM fused)"""


def hybrid(spark, sf_dir, limit: int = 20) -> DataFrame:
    queries = asked(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings")
    probes = queries.join(vectors.withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "embedding")
    dense = R.dense_topk(vectors, probes, 20).select("query_id", F.col("vec_id").cast("string").alias("document_id"), F.col("vec_id").alias("chunk_id"), "score", "rank")
    sparse = R.bm25_ranking(stored(spark, sf_dir), tokens_of(queries))
    return R.fuse(dense, sparse.select("query_id", "document_id", "chunk_id", "score", "rank"), limit)


@register(f"WITH {BM25_SQL}, {DENSE_SQL}, {SPARSE_SQL}, {FUSED_SQL} SELECT query_id, document_id, rrf_score, dense_rank, bm25_rank, rank FROM r WHERE rank <= 20")
def rrf_fusion(spark, sf_dir):
    return hybrid(spark, sf_dir).select("query_id", "document_id", "rrf_score", *[F.col(c).cast("long").alias(c) for c in ("dense_rank", "bm25_rank", "rank")])


#: Two rankings of the documents of each language: by length, and by the number of lines.
_RANKED_SQL = "d AS (SELECT lang, doc_id, n_chars, length(text) - length(replace(text, chr(10), '')) AS lines FROM documents), t AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM d UNION ALL SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY lines DESC, doc_id) AS rank FROM d)"


@register(f"WITH {_RANKED_SQL}, f AS (SELECT lang, doc_id, round(sum(1e0 / (60 + rank)), 8) AS rrf_score, min(rank) AS best_rank FROM t WHERE rank <= 20 GROUP BY lang, doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rrf_score DESC, best_rank, doc_id) AS rank FROM f) SELECT lang, doc_id, rrf_score, rank FROM r WHERE rank <= 20")
def rrf_fusion_golden(spark, sf_dir):
    """The first twenty documents of each language by length and by lines, fused."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("long"), F.regexp_count("text", F.lit("\n")).alias("lines"))
    by = lambda c: R.ranked(docs.withColumn("score", F.col(c)), "query_id", F.col("score").desc(), F.col("document_id"), limit=20)
    fused = R.fuse(by("long"), by("lines"))
    return fused.select(F.col("query_id").alias("lang"), F.col("document_id").alias("doc_id"), "rrf_score", F.col("rank").cast("long").alias("rank"))


_LABEL_SQL = "concat_ws('+', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END, 'rrf')"


@register(f"WITH {BM25_SQL}, {DENSE_SQL}, {SPARSE_SQL}, {FUSED_SQL} SELECT query_id, 'R' || rank AS evidence_id, document_id, round(greatest(0e0, rrf_score), 6) AS score, {_LABEL_SQL} AS provider FROM r WHERE rank <= 5")
def hybrid_evidence(spark, sf_dir):
    got = hybrid(spark, sf_dir, 5)
    label = R.provider_label(F.col("dense_rank").isNotNull(), F.col("bm25_rank").isNotNull(), F.lit(False))
    return got.select("query_id", F.concat(F.lit("R"), F.col("rank")).alias("evidence_id"), "document_id", R.evidence_score(F.lit(None).cast("double"), F.col("rrf_score")).alias("score"), label.alias("provider"))


@register(f"""WITH {BM25_SQL}, h AS (SELECT * FROM (SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score >= 40) WHERE rank <= 3),
{_LEX_TOKENS}, s AS (SELECT query_id, doc_id, round({_LEX_SCORE}, 6) AS score FROM lt, dt WHERE query_id NOT IN (SELECT query_id FROM h)), l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, document_id, score, rank, 'hybrid' AS stage FROM h UNION ALL SELECT query_id, doc_id::VARCHAR, score, rank, 'lexical' FROM l WHERE rank <= 3""")
def hybrid_with_fallback(spark, sf_dir):
    """Queries that the index answers (score 40 or more) keep its answer; the others get the lexical one."""
    queries = asked(spark, sf_dir)
    scored = R.bm25(stored(spark, sf_dir), tokens_of(queries)).where("score >= 40")
    found = R.ranked(scored, "query_id", F.col("score").desc(), F.col("chunk_id"), limit=3).select("query_id", "document_id", "score", "rank", F.lit("hybrid").alias("stage"))
    found = staged(found, "answered")  # pairs are scored once
    open_ = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    docs = searched(spark, sf_dir).withColumn("document_id", F.col("document_id").cast("string"))
    rest = R.lexical_ranking(docs, open_, 3).select("query_id", "document_id", "score", "rank", F.lit("lexical").alias("stage"))
    return found.unionByName(rest).withColumn("rank", F.col("rank").cast("long"))


@register(f"WITH {BM25_SQL}, {SPARSE_SQL}, c AS (SELECT query_id, document_id, chunk_id, rank AS vector_rank, round((chunk_id * 7919 % 1000) / 1000e0, 6) AS rerank_score FROM sparse WHERE chunk_id % 3 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, document_id) AS rank FROM c) SELECT query_id, document_id, rerank_score, rank FROM r WHERE rank <= 3")
def rerank_by_score(spark, sf_dir):
    """A stand-in reranker, whose scores come from the document's number and miss every third one."""
    ranking = R.bm25_ranking(stored(spark, sf_dir), tokens_of(asked(spark, sf_dir)))
    scores = ranking.where("chunk_id % 3 <> 0").select("query_id", "document_id", F.round((F.col("chunk_id") * 7919 % 1000) / 1000.0, 6).alias("rerank_score"))
    return R.rerank(ranking, scores, 3).select("query_id", "document_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


@register(f"WITH {BM25_SQL}, {SPARSE_SQL}, c AS (SELECT s.query_id, s.document_id, (length(left(d.text, 1600)) % 997 + length(a.query)) / 4e0 AS rerank_score FROM sparse s JOIN documents d ON d.doc_id = s.chunk_id JOIN asked a USING (query_id) WHERE length(left(d.text, 1600)) % 7 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, document_id) AS rank FROM c) SELECT query_id, document_id, rerank_score, rank FROM r WHERE rank <= 4")
def rerank_by_provider(spark, sf_dir):
    """A provider that is called with pairs of texts; this one goes by their lengths, and has no score for some."""
    queries = asked(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    found = staged(R.bm25_ranking(stored(spark, sf_dir), tokens_of(queries)).join(queries, "query_id"), "candidates")
    found = found.join(docs, "chunk_id")  # their size is known now: few of them go to the texts
    best = R.reranked(found, lambda pairs: [None if len(t) % 7 == 0 else (len(t) % 997 + len(q)) / 4 for q, t in pairs], 4)
    return best.select("query_id", "document_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


@register("SELECT item_id, [length('q: ' || text)::DOUBLE, len(string_split('q: ' || text, ' '))::DOUBLE] AS embedding FROM benchmark")
def embed_by_provider(spark, sf_dir):
    """A provider that is called with batches of texts behind an instruction; this one counts letters and words."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return R.embedded(rows, lambda texts: [[float(len(t)), float(t.count(" ") + 1)] for t in texts], instruct="q: ").select("item_id", "embedding")


@register("SELECT doc_id, [length(text)::DOUBLE, len(string_split(text, ' '))::DOUBLE] AS embedding FROM documents")
def embed_resumed(spark, sf_dir):
    """Every document's text by a provider whose answers are kept: a first run has those of some languages, the second asks for what is left."""
    own = Answers(spark, fresh_path(spark, "answers"), "letters and words")
    provider = lambda texts: [[float(len(t)), float(t.count(" ") + 1)] for t in texts]
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    own.embedded(rows.where("lang <> 'en'"), provider)
    return own.embedded(rows, provider).select("doc_id", "embedding")


@register("SELECT event_id, concat_ws('+', CASE WHEN d THEN 'dense' END, CASE WHEN s THEN 'bm25' END, CASE WHEN d OR s THEN 'rrf' END, CASE WHEN r THEN 'rerank' END) AS label FROM (SELECT event_id, event_id % 2 = 0 AS d, event_id % 3 = 0 AS s, event_id % 5 = 0 AS r FROM events)")
def provider_label(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", R.provider_label(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("label"))
