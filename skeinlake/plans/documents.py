"""Queries: Markdown cleaning, fences, chunks, display blocks, near duplicates, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinlake.functions import markdown as M
from skeinlake.functions import text as T
from skeinlake.operators import curation as C
from skeinlake.operators import documents as D
from skeinlake.operators import folds
from skeinlake.sources import tables as S
from skeinlake.sources.commits import Table

from . import sqltext as Q
from .registry import Registry, table, texts

register = Registry()
NL = "chr(10)"


def marked_up(spark, sf_dir):
    """Documents as Markdown: a heading, the text, a list of numbers, a fence, an image, a link and a comment section."""
    t = F.concat(F.lit("# "), "source", F.lit("\n\n"), "text", F.lit("\n\n1\n2\n3\n4\n5\n\n```py\nx = 1\n"), F.when(F.col("doc_id") % 4 != 0, "```\n").otherwise(""), F.lit("![icon](a.png) [link](http://x) <b>bold</b>\n\n---\n## 评论 (3)\nbye\n"))
    return texts(spark, sf_dir).select("doc_id", "source", t.alias("text"))


@register()
def markdown_clean(spark, sf_dir):
    return D.cleaned(marked_up(spark, sf_dir), "concepts").select("doc_id", F.md5("cleaned").alias("digest"), "stats", "balanced")


@register()
def markdown_clean_cases(spark, sf_dir):
    item = F.to_json(F.struct(F.col("source").alias("problem_slug"), F.lit("x").alias("author")))
    return D.cleaned(marked_up(spark, sf_dir).withColumn("item", item), "cases", item="item").select("doc_id", F.md5("cleaned").alias("digest"), "stats", "balanced")


@register()
def markdown_clean_problems(spark, sf_dir):
    return D.cleaned(marked_up(spark, sf_dir), "problems").select("doc_id", F.md5("cleaned").alias("digest"), "stats", "balanced")


@register("SELECT doc_id, doc_id % 4 <> 0 AS balanced FROM documents")
def fence_balance(spark, sf_dir):
    text = F.concat(F.lit("a\n```py\nx\n"), F.when(F.col("doc_id") % 4 != 0, "```\n").otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return D.each(rows, "doc_id", ["text"], lambda r: [{"balanced": M.balanced(r[1])}], "doc_id long, balanced boolean")


@register(f"""WITH l AS (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM (SELECT doc_id, string_split('1' || {NL} || '2' || {NL} || {NL} || '3' || {NL} || '4' || {NL} || CASE WHEN doc_id % 2 = 0 THEN '5' ELSE '7' END || {NL} || 'end' || {NL} || '9', {NL}) AS parts FROM documents))
SELECT doc_id, pos::BIGINT AS pos, line FROM l WHERE NOT (doc_id % 2 = 0 AND pos <= 6)""")
def number_run_removal(spark, sf_dir):
    text = F.concat(F.lit("1\n2\n\n3\n4\n"), F.when(F.col("doc_id") % 2 == 0, "5").otherwise("7"), F.lit("\nend\n9"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(text, "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "line", F.lit(False).alias("in_code"))
    return C.number_runs(lines, "doc_id").select("doc_id", "pos", "line")


@register(f"SELECT doc_id, md5(regexp_replace(regexp_replace(source || {NL} || {NL} || {NL} || {NL} || {NL} || text, '[ \\t]+({NL})', '\\1', 'g'), '\\n{{4,}}', {NL} || {NL} || {NL}, 'g')) AS digest FROM documents".replace("({NL})", "(\\n)").replace(f"[ \\t]+({NL})", "[ \\t]+(\\n)"))
def blank_collapse(spark, sf_dir):
    """Texts without fences: at most two blank lines together, nothing behind lines."""
    t = F.concat("source", F.lit("\n\n\n\n\n"), "text")
    flat = F.regexp_replace(F.regexp_replace(t, r"[ \t]+(\n)", "$1"), r"\n{4,}", "\n\n\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(flat).alias("digest"))


@register(f"SELECT doc_id, md5(text) AS digest FROM documents")
def noise_truncate(spark, sf_dir):
    """Lines before the first comment heading."""
    lines = F.split(F.concat("text", F.lit("\n## Comments (2)\nnoise\n### 评论\nmore")), "\n")
    at = F.array_position(F.transform(lines, lambda s: s.rlike(r"(?i)^\s*#{1,6}\s*(?:评论|comments?)")), True)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.slice(lines, F.lit(1), F.when(at > 0, at - 1).otherwise(F.size(lines)).cast("int")), "\n")).alias("digest"))


@register(f"SELECT doc_id, 'a' || {NL} || 'b' || chr(9) || 'c' || {NL} || '中😀' || {NL} || '\\x' || source AS decoded FROM documents")
def escape_decode(spark, sf_dir):
    text = F.concat(F.lit('a\\nb\\tc\\n\\u4e2d\\ud83d\\ude00\\n\\x'), F.col("source"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return D.each(rows, "doc_id", ["text"], lambda r: [{"decoded": M.unescape_once(r[1]) if M.is_escaped(r[1]) else r[1]}], "doc_id long, decoded string")


@register(f"WITH t AS (SELECT doc_id, text || {NL} || '评论 (3)' || {NL} || 'x' || {NL} || 'Comments' || {NL} AS raw FROM documents), p AS (SELECT *, instr(substr(raw, 501), {NL} || '评论 (3)' || {NL}) AS a FROM t) SELECT doc_id, CASE WHEN length(text_) >= 500 THEN length(regexp_replace(text_, '\\s+$', '')) + 1 ELSE length(raw) END AS n FROM (SELECT p.*, d.text AS text_ FROM p JOIN documents d USING (doc_id))")
def comment_cut(spark, sf_dir):
    """Texts cut at the earliest comment boundary at letter 500 or later; earlier ones are navigation."""
    raw = F.concat("text", F.lit("\n评论 (3)\nx\nComments\n"))
    tail = F.substr(raw, F.lit(501))
    marks = (r"\n#{0,6}\s*评论\s*(?:\([^\n)]*\))?\s*\n", r"(?i)\n#{0,6}\s*Comments?\s*(?:\([^\n)]*\))?\s*\n", r"\n💡\s*讨论区规则\s*\n")
    first = F.least(*[F.nullif(F.regexp_instr(tail, F.lit(m)), F.lit(0)) for m in marks])
    cut = F.concat(F.regexp_replace(F.left(raw, (F.lit(499) + first).cast("int")), r"\s+$", ""), F.lit("\n"))
    early = F.length("text") < 500
    # What begins before letter 500 doesn't count, even if it reaches beyond.
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.when(first.isNull() | early, raw).otherwise(cut)).cast("long").alias("n"))


@register("WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ ]+') AS w FROM documents) SELECT doc_id, i // 96 AS chunk_index, len(list_slice(w, i + 1, i + 128)) AS n, sha256(array_to_string(list_slice(w, i + 1, i + 128), ' ')) AS content_sha256 FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 128 THEN [0] ELSE range(0, len(w), 96) END) AS i FROM t WHERE len(w) > 0)")
def chunk_token_windows(spark, sf_dir):
    """Windows of 128 words, 32 into the last."""
    w = F.col("w")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.when(F.size(w) <= 128, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(w) - 1, F.lit(96)))
    cut = rows.select("doc_id", "w", F.explode(starts).alias("i")).select("doc_id", "i", F.slice(w, F.col("i") + 1, F.lit(128)).alias("c"))
    return cut.select("doc_id", F.floor(F.col("i") / 96).cast("long").alias("chunk_index"), F.size("c").cast("long").alias("n"), F.sha2(F.array_join("c", " "), 256).alias("content_sha256"))


@register("SELECT doc_id, left(sha256(concat_ws('|', lang, doc_id, 0, sha256(text), 'words', 64)), 32) AS chunk_id FROM documents")
def chunk_ids_sha256(spark, sf_dir):
    parts = ("lang", "doc_id", F.lit(0), F.sha2("text", 256), F.lit("words"), F.lit(64))
    return table(spark, sf_dir, "documents").select("doc_id", F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(32)).alias("chunk_id"))


@register()
def markdown_chunks(spark, sf_dir):
    return D.chunked(marked_up(spark, sf_dir), 200, 40).select("doc_id", "chunk_index", "chunk_count", "chunk_id", "tokens")


@register()
def embedding_batches(spark, sf_dir):
    chunks = D.chunked(marked_up(spark, sf_dir), 200, 40)
    return D.batched(chunks.select("doc_id", "chunk_index", "tokens").withColumn("library", F.lit("concepts")), "library", ["doc_id", "chunk_index"], most_tokens=9_500)


@register()
def display_blocks(spark, sf_dir):
    return D.display(marked_up(spark, sf_dir)).select("doc_id", "pos", "kind", "info", F.md5("parts").alias("digest"), "inline")


@register(f"SELECT doc_id, nullif(regexp_extract(text_, '(?m)^[ \\t]*# (.*)$', 1), '') AS heading FROM (SELECT doc_id, '# ' || source || {NL} || text AS text_ FROM documents)")
def first_heading(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_heading(F.concat(F.lit("# "), "source", F.lit("\n"), "text")).alias("heading"))


_LEN_SQL = "f AS (SELECT doc_id, length(regexp_replace(lower(text), '\\s+', '', 'g')) AS n FROM documents), c AS (SELECT n, count(*) AS docs FROM f WHERE n > 0 GROUP BY n)"


@register(f"WITH {_LEN_SQL}, l AS (SELECT a.n, sum(b.docs)::BIGINT - 1 AS n_links, min(b.n) AS least, max(b.n) AS most FROM c a JOIN c b ON least(a.n, b.n)::DOUBLE / greatest(a.n, b.n) >= 94e-2 GROUP BY a.n) SELECT doc_id, f.n AS class_id, n_links, least, most FROM f JOIN l USING (n)")
def near_dup_length_pairs(spark, sf_dir):
    """For each document those whose lengths lie within a factor of 0.94: how many, and the least and greatest of their lengths. Documents of one length are
    a class; classes meet by an equi-join on classes of log length and their neighbours, with counts for their members."""
    f = table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace(F.lower("text"), r"\s+", "")).alias("n")).where("n > 0")
    return D.length_links(f, "doc_id").select("doc_id", F.col("n").cast("long").alias("class_id"), "n_links", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"))


@register()
def near_dup_edges(spark, sf_dir):
    """All pairs of different texts at a ratio of 0.92, by the least keys of those texts, and each other copy of a text as a pair with its least key."""
    docs = S.spread(table(spark, sf_dir, "documents"))
    return D.near_edges(docs).unionByName(D.copy_edges(docs))


@register()
def dedup_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    exact = C.exact_duplicates(docs).select("duplicate", "canonical", F.lit("normalized_exact").alias("reason"))
    rest = docs.join(exact.select(F.col("duplicate").alias("doc_id")), "doc_id", "left_anti")
    return exact.unionByName(D.near_manifest(rest).withColumn("reason", F.lit("near_duplicate")))


# Sources and sinks, by a round trip through the shared folder


@register("SELECT doc_id, lang, n_chars FROM documents")
def jsonl_round_trip(spark, sf_dir):
    path = S.fresh_path(spark, "jsonl")
    S.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path)
    return S.read_jsonl(spark, path, "doc_id long, lang string, n_chars long")


@register("SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 0")
def jsonl_tolerant(spark, sf_dir):
    """Every fifth line is cut off, as by a writer that is still at it."""
    path = S.fresh_path(spark, "torn")
    line = F.to_json(F.struct("doc_id", "lang"))
    table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 == 0, F.left(line, F.lit(9))).otherwise(line).alias("value")).write.text(path)
    return S.read_jsonl_tolerant(spark, path, "doc_id long, lang string")


@register("SELECT label AS library, count(*) AS n FROM embeddings GROUP BY label")
def vector_store_verified(spark, sf_dir):
    """Counted as it is read back, and only then committed."""
    own = Table(spark, S.fresh_path(spark, "vectors"))
    own.replace(table(spark, sf_dir, "embeddings").withColumn("library", F.col("label")), F.pmod(F.xxhash64("vec_id"), F.lit(8)).cast("int"))
    return own.read().groupBy("library").agg(F.count("*").alias("n"))


@register("SELECT vec_id, label FROM embeddings")
def collection_scan(spark, sf_dir):
    """All rows of a stored collection, by some of its columns: the scan reads those alone."""
    own = Table(spark, S.fresh_path(spark, "collection"))
    n = own.replace(table(spark, sf_dir, "embeddings"))
    return own.read().select("vec_id", "label").limit(max(1, n))


@register("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def embedding_checkpoint_upsert(spark, sf_dir):
    """Rows put in place of others by key: the buckets that they fall into are written anew."""
    own = Table(spark, S.fresh_path(spark, "checkpoint"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    own.upsert(rows, "vec_id", buckets=16)
    own.upsert(rows.where("vec_id % 3 = 0").withColumn("label", F.lit(-1).cast("long")), "vec_id")
    return own.read().select("vec_id", F.col("label").cast("int").alias("label"))


@register("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, CASE WHEN turn % 2 = 0 THEN role ELSE 'message' END AS event, text AS data FROM conversations WHERE text <> ''")
def event_stream_frames(spark, sf_dir):
    """Each conversation as a stream: a frame a turn, every second one without a name, and one at the end that isn't finished."""
    lines = F.concat(F.lit("data: "), F.replace("text", F.lit("\n"), F.lit("\r\ndata: ")))
    frame = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("event: "), "role", F.lit("\n"))).otherwise(""), lines, F.lit("\r\n\n"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", frame.alias("frame")))), lambda s: s["frame"])
    streams = table(spark, sf_dir, "conversations").where("text <> ''").groupBy("conv_id").agg(F.concat(F.array_join(turns, ""), F.lit("event: rest\ndata: d")).alias("value"))
    return S.event_frames(streams, "value", "conv_id").select("conv_id", F.col("pos").cast("long").alias("pos"), "event", "data")


@register("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN string_agg(text, chr(10) ORDER BY turn, role, text) ELSE 'talk ' || conv_id || chr(10) || 'turns: ' || count(*) || CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'source: http://talks/' || conv_id ELSE '' END END AS content FROM conversations GROUP BY conv_id")
def markdown_bodies(spark, sf_dir):
    """A file of text for each conversation, and bodies by path; a path that leaves the root and a missing file fall back to what the manifest says."""
    root = S.fresh_path(spark, "bodies")
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"), F.count("*").alias("n"))
    talks = S.staged(said.select("conv_id", "n", F.array_join(F.col("said.text"), "\n").alias("value")), "talks")
    talks.select("conv_id", "value").write.partitionBy("conv_id").text(root)
    name = F.concat(F.lit(f"{root}/"), F.regexp_extract("path", r"/conv_id=([0-9]+)/[^/]*$", 1), F.lit(".md"))
    bodies = S.read_bodies(spark, root).select(name.alias("path"), F.col("body").substr(F.lit(1), F.length("body") - 1).alias("body"))
    k, number = F.col("conv_id"), F.col("conv_id").cast("string")
    file = F.concat(F.when(k % 3 == 1, "../").when(k % 3 == 2, "gone/").otherwise(""), number, F.lit(".md"))
    link = F.when(k % 2 == 0, F.concat(F.lit("http://talks/"), number)).otherwise("")
    manifest = talks.select("conv_id", F.concat(F.lit("talk "), number).alias("title"), F.create_map(F.lit("turns"), F.col("n").cast("string")).alias("metadata"), link.alias("source_url"), file.alias("markdown_file"))
    return S.with_bodies(manifest, bodies, root).select("conv_id", "content")


@register(f"""WITH RECURSIVE e AS (SELECT lang, source, doc_id, {Q.token_estimate("text")} AS tokens, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS i FROM documents),
b AS (SELECT lang, source, doc_id, i, 0::BIGINT AS batch, 1 AS texts, tokens AS used FROM e WHERE i = 1 UNION ALL
SELECT lang, source, doc_id, i, batch + ended, CASE WHEN ended = 1 THEN 1 ELSE texts + 1 END, CASE WHEN ended = 1 THEN tokens ELSE used + tokens END
FROM (SELECT e.*, b.batch, b.texts, b.used, CASE WHEN b.texts >= 12 OR b.used + e.tokens > 4000 THEN 1 ELSE 0 END AS ended FROM b JOIN e ON e.lang = b.lang AND e.source = b.source AND e.i = b.i + 1))
SELECT lang, source, doc_id, batch FROM b""")
def token_batches_sql(spark, sf_dir):
    """Batches of at most 12 texts and 4,000 tokens for each language and source, by a table function in SQL."""
    folds.register(spark)
    sized = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    return spark.sql("SELECT lang, source, doc_id, batch FROM token_batches(TABLE(SELECT * FROM {sized}) PARTITION BY (lang, source) ORDER BY (doc_id), 12, 4000)", sized=sized)
