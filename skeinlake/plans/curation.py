"""Queries: pages, duplicates, gates, catalogue and selection, sets, dashboards, audits, payloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinlake.functions import code as K
from skeinlake.functions import text as T
from skeinlake.operators import curation as C
from skeinlake.operators import retrieval as R
from skeinlake.sources.tables import running_total, staged

from . import sqltext as S
from .registry import Registry, said, said_sql, table

register = Registry()


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# Pages


@register(f"SELECT page_id, md5({S.html_to_text('html')}) AS digest, length({S.html_to_text('html')}) AS n FROM pages")
def clean_html_to_text(spark, sf_dir):
    plain = T.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", plain.alias("t")).select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@register(f"SELECT page_id, {S.canonical_url('url')} AS canonical FROM pages")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@register("""WITH p AS (SELECT page_id, url, list_transform(string_split(coalesce(nullif(regexp_replace(url_decode(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '^/+|/+$', '', 'g'), ''), 'index'), '/'), lambda x: left(coalesce(nullif(regexp_replace(regexp_replace(x, '[^0-9A-Za-z._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), ''), 'page'), 120)) AS parts FROM pages)
SELECT page_id, array_to_string(list_concat(list_slice(parts, 1, len(parts) - 1), [regexp_replace(parts[-1], '\\.html$', '') || '-' || left(sha256(url), 10) || '.md']), '/') AS path FROM p""")
def safe_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_path(F.col("url")).alias("path"))


@register(f"SELECT category, count(*) AS pages FROM (SELECT regexp_extract({S.canonical_url('url')}, '^https?://[^/]+/([^/]+)', 1) AS category FROM pages) GROUP BY category")
def url_category(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.url_category(F.col("url")).alias("category")).agg(F.count("*").alias("pages"))


@register(f"SELECT page_id, {S.canonical_url('url')} AS source_url, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS title, length(html) AS markdown_chars, sha256(html) AS content_sha256 FROM pages WHERE length(html) >= 200")
def page_manifest(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.length("html") >= 200).select("page_id", T.canonical_url(F.col("url")).alias("source_url"), F.trim(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"), F.length("html").cast("long").alias("markdown_chars"), F.sha2("html", 256).alias("content_sha256"))


@register(f"WITH w AS (SELECT DISTINCT {S.canonical_url('url')} AS u FROM pages), h AS (SELECT DISTINCT {S.canonical_url('url')} AS u FROM pages WHERE page_id % 3 <> 0) SELECT u AS missing_url FROM w WHERE u NOT IN (SELECT u FROM h)")
def missing_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("missing_url"))
    return pages.select("missing_url").distinct().join(pages.where("page_id % 3 <> 0").select("missing_url"), "missing_url", "left_anti")


# Duplicates

_DUP_SQL = f"rows AS (SELECT doc_id, length(text) AS n, sha256({S.fingerprint('text')}) AS hash FROM documents), best AS (SELECT hash, count(*) AS members, max(struct_pack(n := n, doc_id := doc_id)) AS b FROM rows GROUP BY hash HAVING count(*) > 1), dup AS (SELECT doc_id AS duplicate, b.doc_id AS canonical, hash FROM rows JOIN best USING (hash) WHERE doc_id <> b.doc_id)"


@register(f"WITH {_DUP_SQL} SELECT duplicate, canonical, hash FROM dup")
def exact_duplicates(spark, sf_dir):
    return C.exact_duplicates(table(spark, sf_dir, "documents"))


@register(f"WITH {_DUP_SQL} SELECT members, count(*) AS n FROM best GROUP BY members")
def duplicate_groups_having(spark, sf_dir):
    keys = C.hashed(table(spark, sf_dir, "documents")).groupBy("hash").agg(F.count("*").alias("members"))
    return keys.where("members > 1").groupBy("members").agg(F.count("*").alias("n"))


@register(f"WITH {_DUP_SQL} SELECT DISTINCT canonical, (SELECT length(text) FROM documents WHERE doc_id = canonical) AS n FROM dup")
def canonical_by_length(spark, sf_dir):
    return C.copied(C.hashed(table(spark, sf_dir, "documents"))).select("canonical", F.col("n").cast("long").alias("n")).distinct()


@register("""WITH RECURSIVE a AS (SELECT doc_id AS src, doc_id // 3 AS dst FROM documents WHERE doc_id > 0 AND lang <> 'en'),
w AS (SELECT src, dst FROM a UNION ALL SELECT w.src, a.dst FROM w JOIN a ON a.src = w.dst WHERE a.dst <> w.src) SELECT src, dst FROM w WHERE dst NOT IN (SELECT src FROM a)""")
def alias_resolution(spark, sf_dir):
    """Documents in other languages than English as aliases of a third of their number."""
    own = table(spark, sf_dir, "documents").where("doc_id > 0 AND lang <> 'en'").select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 3).cast("long").alias("dst"))
    return C.resolve_aliases(own)


# Gates


@register("""SELECT d.doc_id, array_to_string(list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN contains(text, 'data:image/') THEN 'base64_image' END, CASE WHEN contains(text, ' | ') THEN 'table_noise' END, CASE WHEN coalesce(l.quality, 1) = 0 THEN 'low_quality' END, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def quality_gate_raw(spark, sf_dir):
    """Reasons to reject each document; unlabelled ones have none from labels."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    t = F.col("text")
    reasons = F.array_compact(F.array(F.when(F.length(t) < 200, "short"), F.when(t.contains("data:image/"), "base64_image"), F.when(t.contains(" | "), "table_noise"), F.when(F.coalesce("quality", F.lit(1)) == 0, "low_quality"), F.when(F.coalesce("toxic", F.lit(0)) == 1, "toxic")))
    return both.select("doc_id", F.array_join(reasons, ",").alias("reasons"))


@register(f"WITH {_DUP_SQL}, c AS (SELECT d.doc_id, d.text, dup.canonical, sha256(d.text) AS own FROM documents d LEFT JOIN dup ON dup.duplicate = d.doc_id) SELECT c.doc_id, c.canonical, (k.own IS NULL OR k.own = c.own) AS same_text, length(c.text) >= 200 OR c.canonical IS NOT NULL AS long_enough FROM c LEFT JOIN c k ON k.doc_id = c.canonical")
def quality_gate_processed(spark, sf_dir):
    """Aliases against their canonical document's hash, in a self join; only documents that stay need the length. Texts are read once, and
    only aliases look for another document, so that those without one don't meet in a task."""
    docs = staged(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), T.fingerprint_sha256(F.col("text")).alias("hash"), F.sha2("text", 256).alias("own")), "gate")
    best = C.copied(docs).select("hash", "canonical")
    aliases = docs.join(best, "hash").where("doc_id <> canonical").select("doc_id", "canonical")
    far = docs.select(F.col("doc_id").alias("canonical"), F.col("own").alias("far"))
    both = docs.join(aliases.join(far, "canonical", "left"), "doc_id", "left")
    return both.select("doc_id", "canonical", (F.col("far").isNull() | (F.col("far") == F.col("own"))).alias("same_text"), ((F.col("n") >= 200) | F.col("canonical").isNotNull()).alias("long_enough"))


@register("SELECT source, bool_and(e IS NULL) AS passed, coalesce(array_to_string(list_sort(list_distinct(list(e) FILTER (e IS NOT NULL))), ','), '') AS codes FROM (SELECT source, CASE WHEN length(text) < 60 THEN 'too_short' WHEN contains(text, '!!') THEN 'noise' END AS e FROM documents) GROUP BY source")
def quality_verdict(spark, sf_dir):
    e = F.when(F.length("text") < 60, "too_short").when(F.col("text").contains("!!"), "noise")
    return C.verdict(table(spark, sf_dir, "documents").select("source", e.alias("error")), "source")


@register("SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def set_equality_check(spark, sf_dir):
    return C.set_difference(table(spark, sf_dir, "documents").where("doc_id % 2 = 0"), table(spark, sf_dir, "labels"), "doc_id")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE coalesce(o_totalprice / 1000, 0) >= 100 AND coalesce(o_totalprice, 0) >= 10000")
def engagement_gate(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(C.engaged(F.col("o_totalprice") / 1000, F.col("o_totalprice"))).select("o_orderkey", "o_custkey")


# Catalogue and selection: problem := customer, cards := orders, likes and views from the price


@register("""WITH c AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 1500)::BIGINT AS likes, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE floor(o_totalprice / 10)::BIGINT END AS views, o_orderpriority FROM orders),
t AS (SELECT *, CASE WHEN views IS NULL THEN 9 WHEN NOT (likes >= 100 AND views >= 10000) THEN 8 WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END AS tier FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY tier, likes DESC, views DESC NULLS LAST, o_orderkey) AS n FROM t)
SELECT o_custkey, o_orderkey, tier, CASE tier WHEN 9 THEN 'pending_metrics' WHEN 8 THEN 'pending_quality_threshold' ELSE 'selected' END AS status FROM r WHERE n = 1""")
def choose_post_tiers(spark, sf_dir):
    cards = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1500).alias("likes"), F.when(F.col("o_orderkey") % 11 != 0, F.floor(F.col("o_totalprice") / 10)).alias("views"), "o_orderpriority")
    tier = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    return C.choose_post(cards, "o_custkey", tier, F.col("o_orderkey")).select("o_custkey", "o_orderkey", "tier", "status")


@register("WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part) SELECT * FROM r WHERE place <= 3")
def top3_per_group(spark, sf_dir):
    return C.first_n(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), 3, "p_brand", F.col("p_partkey")).withColumn("place", F.col("place").cast("long"))


@register("""WITH f AS (SELECT l_partkey AS k, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS position FROM lineitem GROUP BY l_partkey QUALIFY position <= 6),
g AS (SELECT p_partkey AS k, p_partkey AS position FROM part WHERE p_partkey <= 5), h AS (SELECT p_partkey AS k, p_partkey AS position FROM part),
u AS (SELECT k, position, 0 AS source FROM f UNION ALL SELECT k, position, 1 FROM g UNION ALL SELECT k, position, 2 FROM h), b AS (SELECT k, min(struct_pack(source := source, position := position)) AS b FROM u GROUP BY k)
SELECT k, b.source AS source, b.position AS position FROM b ORDER BY source, position, k LIMIT 10""")
def quota_topup_fill(spark, sf_dir):
    """Ten parts: the six most sold, then parts 1 to 5, then any."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(6)
    sold = sold.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "k")).cast("long"))  # six rows
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("long").alias("position"))
    return C.quota_fill([sold, part.where("k <= 5"), part], "k", 10)


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def paired_selection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    own = lambda c: orders.where(c).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(own("o_totalprice > 300000"), "c_custkey", "left_semi").join(own("o_orderstatus = 'F'"), "c_custkey", "left_semi")


@register("WITH r AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS rank FROM part) SELECT p_partkey, row_number() OVER (ORDER BY coalesce(rank, 1000000000), p_name, p_partkey) AS place FROM r")
def catalog_order(spark, sf_dir):
    """The catalogue's order: by plan rank (those without last), then name."""
    rank = F.coalesce(F.when(F.col("p_partkey") % 4 == 0, F.col("p_size")), F.lit(1_000_000_000))
    rows = table(spark, sf_dir, "part").select("p_partkey", rank.alias("r"), "p_name")
    return running_total(rows, "place", F.col("r"), F.col("p_name"), F.col("p_partkey")).select("p_partkey", "place")


@register("""WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders), top AS (SELECT * FROM c WHERE n = 1 AND o_totalprice >= 200000),
off AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority LIKE '5%' GROUP BY o_custkey)
SELECT c_custkey, coalesce(top.o_orderkey, off.o_orderkey) AS post, top.o_orderkey IS NULL AND off.o_orderkey IS NOT NULL AS fallback FROM customer LEFT JOIN top ON top.o_custkey = c_custkey LEFT JOIN off ON off.o_custkey = c_custkey""")
def official_fallback(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    top = C.first_n(orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("top"), "o_totalprice"), 1, "c_custkey", F.desc("o_totalprice"), F.col("top")).where("o_totalprice >= 200000").select("c_custkey", "top")
    off = orders.where(F.col("o_orderpriority").startswith("5")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("off"))
    both = table(spark, sf_dir, "customer").select("c_custkey").join(top, "c_custkey", "left").join(off, "c_custkey", "left")
    return both.select("c_custkey", F.coalesce("top", "off").alias("post"), (F.col("top").isNull() & F.col("off").isNotNull()).alias("fallback"))


# Joins and sets


@register("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey")
def catalog_left_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    c = table(spark, sf_dir, "customer")
    named = c.join(nation, c.c_nationkey == nation.n_nationkey, "left")
    region = table(spark, sf_dir, "region")
    return named.join(region, named.n_regionkey == region.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def pending_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@register("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def semi_join_selected(spark, sf_dir):
    asia = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").join(asia, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


def _nations(spark, sf_dir, name, column):
    return table(spark, sf_dir, name).where(f"{column} % 3 <> 0").select(F.col(column).alias("k")).distinct()


@register("SELECT c_nationkey AS k FROM customer WHERE c_nationkey % 3 <> 0 UNION SELECT s_nationkey FROM supplier WHERE s_nationkey < 10")
def set_union(spark, sf_dir):
    return _nations(spark, sf_dir, "customer", "c_nationkey").union(table(spark, sf_dir, "supplier").where("s_nationkey < 10").select("s_nationkey")).distinct()


@register("SELECT c_nationkey AS k FROM customer WHERE c_nationkey % 3 <> 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10")
def set_intersect(spark, sf_dir):
    return _nations(spark, sf_dir, "customer", "c_nationkey").intersect(table(spark, sf_dir, "supplier").where("s_nationkey < 10").select("s_nationkey"))


@register("SELECT c_nationkey AS k FROM customer WHERE c_nationkey % 3 <> 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10")
def set_except(spark, sf_dir):
    return _nations(spark, sf_dir, "customer", "c_nationkey").subtract(table(spark, sf_dir, "supplier").where("s_nationkey < 10").select("s_nationkey"))


@register("SELECT p_partkey AS k, 'old' AS v FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_partkey % 5 = 0")
def replace_by_key(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return C.replace_by_key(part.withColumn("v", F.lit("old")), part.where("k % 5 = 0").withColumn("v", F.lit("new")), "k")


@register("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    return C.latest(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


# Text and code values

@register("SELECT event_id, CASE event_id % 6 WHEN 0 THEN floor(round(value, 1) * 1e3 + 1e-6) WHEN 1 THEN floor(value) * 10000 WHEN 2 THEN floor(value * 100) WHEN 3 THEN floor(value) WHEN 4 THEN floor(floor(value) * 1e6 + 1e-6) END::BIGINT AS value FROM events")
def metric_value_parse(spark, sf_dir):
    """Values as people write them: 1.2K, 5万, 1,234, with blanks around, 3m, and words that are none."""
    k, v = F.col("event_id") % 6, F.col("value")
    whole = F.floor(v).cast("string")
    told = F.when(k == 0, F.concat(F.format_string("%.1f", F.round(v, 1)), F.lit("K"))).when(k == 1, F.concat(whole, F.lit("万"))).when(k == 2, F.format_number(F.floor(v * 100), 0)).when(k == 3, F.concat(F.lit(" "), whole, F.lit(" "))).when(k == 4, F.concat(whole, F.lit("m"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.metric_value(told).alias("value"))


@register("SELECT page_id, left(trim(split_part(regexp_extract(html, '<title>([^<]*)', 1), ' | ', 1)), 500) AS title FROM pages")
def title_compact(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.compact_title(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))


@register(f"SELECT doc_id, CASE WHEN length({S.squeeze('text')}) <= 600 THEN {S.squeeze('text')} ELSE regexp_replace(left({S.squeeze('text')}, 599), '\\s+$', '') || '…' END AS excerpt FROM documents")
def excerpt_600(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.short_excerpt(F.col("text")).alias("excerpt"))


@register("WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS c FROM documents) SELECT doc_id, md5(CASE WHEN length(c) <= 3500 THEN c ELSE regexp_replace(left(c, 3500), '\\s+$', '') || chr(10) || '[片段已截断]' END) AS digest FROM t")
def excerpt_3500(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.excerpt(F.col("text"))).alias("digest"))


@register("WITH t AS (SELECT conv_id, turn, text || ' [R' || (turn % 4) || '] [W' || (conv_id % 3) || '] [R9]' AS s FROM conversations), c AS (SELECT conv_id, turn, regexp_extract_all(s, '\\[((?:R|W)[0-9]+)\\]', 1) AS cited FROM t) SELECT conv_id, turn, array_to_string(cited, ',') AS cited, array_to_string(list_filter(cited, lambda x: NOT list_contains(['R1', 'R2', 'R3', 'W1', 'W2'], x)), ',') AS unknown FROM c")
def citations_audit(spark, sf_dir):
    """Evidence that answers cite, and what of it isn't available."""
    said = F.concat("text", F.lit(" [R"), F.col("turn") % 4, F.lit("] [W"), F.col("conv_id") % 3, F.lit("] [R9]"))
    have = F.array(*[F.lit(x) for x in ("R1", "R2", "R3", "W1", "W2")])
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.citations(said).alias("c"))
    return got.select("conv_id", "turn", F.array_join("c", ",").alias("cited"), F.array_join(F.filter("c", lambda x: ~F.array_contains(have, x)), ",").alias("unknown"))


@register("SELECT doc_id, sha256(concat_ws('␟', lang, source, doc_id)) AS h FROM documents")
def stable_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.stable_hash(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("h"))


_CODE = ["#include <vector>\nint main() { return 0; }", "public class A { void f() { System.out.println(1); } }", "def f(x):\n    return x\n    # two", "fn main() { let mut x = 1; }", "interface A { x: number }", "const a = () => 1;", "package main\nfunc main() {}", "plain words only"]
def _java(pattern: str) -> str:
    return pattern.replace("'", "''")


@register(f"WITH t AS ({said_sql(_CODE)}) SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(s, '{_java(p)}') THEN '{n}'" for n, p in K.LANGUAGES) + " END AS language FROM t")
def language_detect(spark, sf_dir):
    return said(spark, sf_dir, _CODE).select("conv_id", "turn", K.detect_language(F.col("s")).alias("language"))


_FENCES = ("\n```py\nprint(1)\n```\nand\n```cpp\nint main() { return 0; }\n```", "", "\n```\nplain\n```")


@register(r"""WITH m AS (SELECT conv_id, turn, turn % 3 AS k, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations) SELECT conv_id, turn, CASE k WHEN 0 THEN 'int main() { return 0; }' ELSE 'plain' END AS code, CASE k WHEN 0 THEN 'C++' END AS language, CASE k WHEN 0 THEN t || chr(10) || ' ' || chr(10) || 'and' ELSE t END AS instruction FROM m WHERE k <> 1""")
def code_artifact(spark, sf_dir):
    """Messages with two fenced blocks, none, and one in no language."""
    k = F.col("turn") % 3
    fences = F.when(k == 0, _FENCES[0]).when(k == 1, _FENCES[1]).otherwise(_FENCES[2])
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", K.code_artifact(F.concat(T.strip(F.col("text")), fences)).alias("a")).where("a IS NOT NULL")
    return got.select("conv_id", "turn", "a.code", "a.language", "a.instruction")


_LOGS = "SELECT o_orderkey AS id, o_orderkey % 9 + 1 AS planned, o_custkey % 3 <> 0 AS accepted, CASE o_orderkey % 5 WHEN 0 THEN 'ok' || chr(10) || 'ALL_TESTS_PASSED ' || (o_orderkey % 9 + 1) || '/' || (o_orderkey % 9 + 1) WHEN 1 THEN 'TESTS_FAILED ' || (o_custkey % 12) || '/7' WHEN 2 THEN 'ALL_TESTS_PASSED 4/5' WHEN 3 THEN '' ELSE 'TESTS_FAILED  9/2 x' END AS log FROM orders"


@register(f"WITH t AS ({_LOGS}), m AS (SELECT *, nullif(regexp_extract(log, 'ALL_TESTS_PASSED\\s+([0-9]+)/([0-9]+)', 1), '')::BIGINT AS a, nullif(regexp_extract(log, 'ALL_TESTS_PASSED\\s+([0-9]+)/([0-9]+)', 2), '')::BIGINT AS b, nullif(regexp_extract(log, 'TESTS_FAILED\\s+([0-9]+)/([0-9]+)', 1), '')::BIGINT AS c, nullif(regexp_extract(log, 'TESTS_FAILED\\s+([0-9]+)/([0-9]+)', 2), '')::BIGINT AS d FROM t), p AS (SELECT *, coalesce(accepted AND a = planned AND b = planned, false) AS good FROM m) SELECT id, CASE WHEN good THEN 'passed' ELSE 'failed' END AS status, CASE WHEN c IS NOT NULL THEN least(c, planned) WHEN good THEN planned ELSE 0 END::BIGINT AS passed, CASE WHEN c IS NOT NULL THEN greatest(d, planned) ELSE planned END::BIGINT AS total FROM p")
def test_log_parse(spark, sf_dir):
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 9 + 1).cast("string")
    log = F.when(k % 5 == 0, F.concat(F.lit("ok\nALL_TESTS_PASSED "), n, F.lit("/"), n)).when(k % 5 == 1, F.concat(F.lit("TESTS_FAILED "), F.col("o_custkey") % 12, F.lit("/7"))).when(k % 5 == 2, "ALL_TESTS_PASSED 4/5").when(k % 5 == 3, "").otherwise("TESTS_FAILED  9/2 x")
    r = K.test_report(log, (k % 9 + 1).cast("long"), F.col("o_custkey") % 3 != 0)
    return table(spark, sf_dir, "orders").select(k.alias("id"), r.alias("r")).select("id", "r.*")


# Dashboards


@register("SELECT lang AS library, count(*) AS documents, count(l.doc_id) AS labelled, sum(n_chars)::BIGINT AS chars, min(n_chars) AS least, max(n_chars) AS most, round(100e0 * count(l.doc_id) / count(*), 1) AS coverage, CASE WHEN count(l.doc_id) >= count(*) THEN 'ready' ELSE 'partial' END AS status FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def library_overview(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("labelled"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").groupBy(F.col("lang").alias("library")).agg(F.count("*").alias("documents"), F.count("labelled").alias("labelled"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    return rows.select("*", F.round(100.0 * F.col("labelled") / F.col("documents"), 1).alias("coverage"), F.when(F.col("labelled") >= F.col("documents"), "ready").otherwise("partial").alias("status"))


@register("WITH f AS (SELECT text, arg_min(source, doc_id) AS source, min(doc_id) AS seen FROM documents GROUP BY text), c AS (SELECT source AS label, count(*) AS n, min(seen) AS seen FROM f GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, seen) AS place FROM c) SELECT label, n, place FROM r WHERE place <= 8")
def top8_distribution(spark, sf_dir):
    """The eight most frequent sources of distinct texts; of equals the one seen first."""
    first = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.min_by("source", "doc_id").alias("label"), F.min("doc_id").alias("seen"))
    best = first.groupBy("label").agg(F.count("*").alias("n"), F.min("seen").alias("seen")).orderBy(F.desc("n"), "seen").limit(8)
    return best.select("label", "n", F.row_number().over(Window.orderBy(F.desc("n"), "seen")).cast("long").alias("place"))  # eight rows


@register("SELECT bool_and(n >= 100) AS all_ready, bool_or(n >= 100) AS any_ready, CASE WHEN bool_and(n >= 100) THEN 'ready' ELSE 'partial' END AS status FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def status_rollup(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.agg(F.bool_and(F.col("n") >= 100).alias("all_ready"), F.bool_or(F.col("n") >= 100).alias("any_ready")).withColumn("status", F.when(F.col("all_ready"), "ready").otherwise("partial"))


@register("SELECT rule, sum(n)::BIGINT AS n FROM (SELECT 'caps' AS rule, length(text) - length(replace(text, '!!', '')) AS n FROM documents UNION ALL SELECT 'pipes', length(text) - length(replace(text, '|', '')) FROM documents) WHERE n > 0 GROUP BY rule")
def cleanup_map_sum(spark, sf_dir):
    """Counters of each document, as a map, summed by rule."""
    drop = lambda s: F.length("text") - F.length(F.replace("text", F.lit(s)))
    maps = table(spark, sf_dir, "documents").select(F.map_filter(F.create_map(F.lit("caps"), drop("!!"), F.lit("pipes"), drop("|")), lambda k, v: v > 0).alias("m"))
    return maps.select(F.explode("m").alias("rule", "n")).groupBy("rule").agg(F.sum("n").alias("n"))


@register("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def explode_count(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@register("SELECT event_type, count(*) AS n, greatest(1, max(count(*)) OVER ()) AS scale FROM events GROUP BY event_type")
def histogram_scale(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.greatest(F.lit(1), F.max("n")).alias("scale"))))


_PLAN_SQL = "l AS (SELECT lang, doc_id, doc_id || ':' || sha256(text) AS line FROM documents)"


@register(f"WITH {_PLAN_SQL}, b AS (SELECT lang, left(sha256(doc_id::VARCHAR), 4) AS bucket, sha256(string_agg(line, chr(10) ORDER BY doc_id, line)) AS h FROM l GROUP BY ALL) SELECT lang, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS fingerprint FROM b GROUP BY lang")
def plan_fingerprint(spark, sf_dir):
    """One hash of each library's documents: of the hashes of 65,536 buckets by the documents' ids, each of its lines in order, so that no
    list grows with the library."""
    return C.plan_fingerprint(table(spark, sf_dir, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("sha")), "lang", "doc_id", "sha")


@register("SELECT conv_id, sha256(string_agg(turn || ':' || sha256(text), chr(10) ORDER BY turn, text)) AS fingerprint FROM conversations GROUP BY conv_id")
def ordered_fingerprint(spark, sf_dir):
    """The hash of a group's id:hash lines, joined in order by line ends: of groups that a row can hold, here a conversation's turns."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: F.concat_ws(":", s["turn"].cast("string"), F.sha2(s["text"], 256)))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


# Evidence and payloads


@register("WITH o AS (SELECT source, doc_id, text, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM documents), k AS (SELECT source, doc_id, left(text, (12000 - coalesce(used, 0))::INT) AS c FROM o WHERE 12000 - coalesce(used, 0) > 0 AND length(text) > 0) SELECT source, 'R' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS evidence_id, doc_id, length(c) AS n FROM k")
def evidence_budget_12000(spark, sf_dir):
    got = C.running_budget(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", 12_000, "text", F.col("doc_id"))
    return got.select("source", F.concat(F.lit("R"), "number").alias("evidence_id"), "doc_id", F.length("text").cast("long").alias("n"))


@register("""WITH t AS (SELECT doc_id AS pos, 'W' || row_number() OVER (ORDER BY doc_id) AS evidence_id, lang AS collection, source AS source_url, text AS title FROM documents WHERE n_chars % 2 = 0),
i AS (SELECT doc_id AS pos, lang AS collection, source AS source_url, text AS title FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY collection, source_url, title ORDER BY pos) AS n FROM i WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.collection = i.collection AND t.source_url = i.source_url AND t.title = i.title))
SELECT pos, evidence_id FROM t UNION ALL SELECT pos, 'W' || ((SELECT count(*) FROM t) + row_number() OVER (ORDER BY pos)) FROM k WHERE n = 1""")
def evidence_merge_renumber(spark, sf_dir):
    """All documents come in to those of even length: whole titles decide what is the same."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("lang").alias("collection"), F.col("source").alias("source_url"), F.col("text").alias("title"), "n_chars")
    given = running_total(docs.where("n_chars % 2 = 0"), "number", F.col("pos"))
    target = given.withColumn("evidence_id", F.concat(F.lit("W"), "number")).drop("n_chars", "number")
    incoming = docs.drop("n_chars").withColumn("evidence_id", F.lit(None).cast("string"))
    return C.merge_evidence(target, incoming, "W").select("pos", "evidence_id")


@register("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) SELECT source, doc_id, rank, round(greatest(0e0, 1e0 - 1e-1 * (rank - 1)), 6) AS score FROM r WHERE rank <= 12")
def web_rank_score(spark, sf_dir):
    got = C.first_n(table(spark, sf_dir, "documents").select("source", "doc_id"), 12, "source", F.col("doc_id"))
    return got.select("source", "doc_id", F.col("place").cast("long").alias("rank"), F.round(F.greatest(F.lit(0.0), 1.0 - 0.1 * (F.col("place") - 1)), 6).alias("score"))


@register(r"""WITH d AS (SELECT doc_id, source, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), r AS (
SELECT doc_id, 1 AS p, source AS title, 'http://a/' || doc_id AS url, lang AS snippet, 'answer_box' AS source_type FROM d UNION ALL SELECT doc_id, 2, 'K', NULL, 'T；' || lang, 'knowledge_graph' FROM d
UNION ALL SELECT doc_id, 3, CASE WHEN t = '' THEN 'again' ELSE 'One' END, 'http://d/' || doc_id, CASE WHEN t = '' THEN 'x' ELSE t END, 'organic_results' FROM d UNION ALL SELECT doc_id, 4, 'http://e', 'http://e', source, 'organic_results' FROM d)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rank, title, url, md5(snippet) AS digest, source_type FROM r""")
def search_payload_flatten(spark, sf_dir):
    """A payload for each document: an answer box, a knowledge panel, and results of which one repeats a URL, one has no snippet, and one no title."""
    from skeinlake.operators.payloads import search_results

    text = lambda c: c.cast("string")
    item = lambda title, link, snippet: F.struct(text(title).alias("title"), link.alias("link"), snippet.alias("snippet"))
    own = F.concat(F.lit("http://d/"), "doc_id")
    results = F.array(item(F.lit("One"), own, F.concat(F.lit(" "), "text", F.lit(" "))), item(F.lit("No"), F.lit("http://n"), F.lit(None).cast("string")), item(F.lit("again"), own, F.lit("x")), item(F.lit(None), F.lit("http://e"), F.col("source")))
    box = F.struct(F.col("source").alias("title"), F.concat(F.lit("http://a/"), "doc_id").alias("link"), F.col("lang").alias("answer"))
    graph = F.struct(F.lit("K").alias("title"), F.lit("T").alias("type"), F.col("lang").alias("description"))
    payloads = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(box.alias("answer_box"), graph.alias("knowledge_graph"), results.alias("organic_results"))).alias("payload"))
    return search_results(payloads, "doc_id", "payload").select("doc_id", F.col("rank").cast("long").alias("rank"), "title", "url", F.md5("snippet").alias("digest"), "source_type")


@register("SELECT event_type, user_id % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def reactions_by_type(spark, sf_dir):
    """Reactions of a post as an array of structs, counted by type: here events of ten groups."""
    posts = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("bucket"), "event_type").agg(F.count("*").alias("n"))
    arrays = posts.groupBy("bucket").agg(F.collect_list(F.struct("event_type", "n")).alias("reactions"))  # a struct a type
    return arrays.select("bucket", F.explode("reactions").alias("r")).select("r.event_type", "bucket", "r.n")


@register("SELECT (props->>'k')::INT AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY k")
def json_props_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_CONTESTS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'Biweekly Contest ' ELSE 'Weekly Contest ' END || (o_custkey % 400 + 100) AS title, o_orderdate::DATE AS upcoming, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE - ((o_orderkey % 45)::INT - 3) END AS target FROM orders"


@register(f"WITH t AS ({_CONTESTS}), d AS (SELECT *, upcoming - target AS days FROM t) SELECT id, CASE WHEN NOT starts_with(lower(title), 'weekly contest') THEN NULL WHEN target IS NULL THEN regexp_extract(title, '([0-9]+)$', 1)::INT WHEN days < -1 OR days > 35 THEN NULL ELSE regexp_extract(title, '([0-9]+)$', 1)::INT - greatest(0, round_even(days / 7, 0)::INT) END AS number FROM d")
def contest_number(spark, sf_dir):
    """Contests ahead, and dates up to six weeks before or three days behind them."""
    from skeinlake.operators.payloads import contest_number as number

    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    title = F.concat(F.when(k % 7 == 0, "Biweekly Contest ").otherwise("Weekly Contest "), F.col("o_custkey") % 400 + 100)
    return table(spark, sf_dir, "orders").select(k.alias("id"), number(title, day, F.when(k % 5 > 0, F.date_sub(day, (k % 45 - 3).cast("int")))).alias("number"))


_INTENTS = {"problem_solving": "problem_solving_agent", "guided_hint": "problem_solving_agent", "solution_comparison": "problem_solving_agent", "mock_interview": "problem_solving_agent", "code_generation": "implementation_agent", "code_diagnosis": "code_analysis_agent", "complexity_analysis": "code_analysis_agent", "review_planning": "learning_planning_agent", "learning_consultation": "learning_planning_agent", "concept_explanation": "tutoring_agent", "visual_explanation": "tutoring_agent"}
_INTENT_NAMES = [*_INTENTS, "chitchat"]


@register(f"SELECT event_id, CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _INTENTS.items()) + f" ELSE 'conversation_agent' END AS agent FROM (SELECT event_id, ({_INTENT_NAMES!r})[1 + event_id % {len(_INTENT_NAMES)}] AS intent FROM events)")
def intent_routing(spark, sf_dir):
    routes = F.create_map(*[F.lit(x) for kv in _INTENTS.items() for x in kv])
    intent = F.get(F.array(*[F.lit(x) for x in _INTENT_NAMES]), (F.col("event_id") % len(_INTENT_NAMES)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(routes, intent), F.lit("conversation_agent")).alias("agent"))
