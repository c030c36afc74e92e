"""What must hold for any input."""

import random

import pytest
from pyspark.sql import functions as F

from skeinlake.operators import curation as C
from skeinlake.operators import evaluation as E
from skeinlake.operators import retrieval as R
from skeinlake.operators import sessions as S

ROW = "query_id int, document_id string, chunk_id string, rank int, score double"


def rankings(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(2):
        rows = []
        for q in range(4):
            docs = rng.sample("abcdefghij", rng.randrange(1, 8))
            rows += [(q, d, d, i + 1, 1.0 / (i + 1)) for i, d in enumerate(docs)]
        out.append(rows)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_fusion_is_symmetric_in_scores(spark, seed):
    a, b = (spark.createDataFrame(r, ROW) for r in rankings(seed))
    scores = lambda f: {(r["query_id"], r["document_id"]): r["rrf_score"] for r in f.collect()}
    assert scores(R.fuse(a, b)) == scores(R.fuse(b, a))


@pytest.mark.parametrize("seed", range(3))
def test_metrics_are_shares(spark, seed):
    rows, rel = rankings(seed)
    ranking = spark.createDataFrame([(q, d, i) for q, d, _, i, _ in rows], "case_id int, document_id string, rank int")
    judged = spark.createDataFrame([(q, d, i % 4) for q, d, _, i, _ in rel], "case_id int, document_id string, grade int")
    cases = spark.range(5).select(F.col("id").cast("int").alias("case_id"))
    got = E.case_metrics(cases, ranking, judged, [1, 3, 10]).collect()
    assert len(got) == 15
    for r in got:
        assert all(0 <= r[m] <= 1 + 1e-12 for m in E.METRICS)
        assert r["hit"] == (r["precision"] > 0) and r["reciprocal_rank"] <= r["hit"]


def test_duplicates_settle(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, rng.choice(["A b", "a  B", "# h\nab", "x", "", "y" * rng.randrange(3)])) for i in range(60)], "doc_id int, text string")
    dup = C.exact_duplicates(docs)
    rest = docs.join(dup.select(F.col("duplicate").alias("doc_id")), "doc_id", "left_anti")
    assert C.exact_duplicates(rest).count() == 0
    assert not {r["duplicate"] for r in dup.collect()} & {r["canonical"] for r in dup.collect()}


def test_quota_and_replacement(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "k int, position int")
    b = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "k int, position int")
    assert [(r["k"], r["source"]) for r in C.quota_fill([a, b], "k", 3).collect()] == [(1, 0), (2, 0), (3, 1)]
    got = C.replace_by_key(a, b.where("k = 2"), "k")
    assert sorted((r["k"], r["position"]) for r in got.collect()) == [(1, 1), (2, 1)]


def test_budget_and_eviction(spark):
    rows = spark.createDataFrame([("s", i, "x" * n) for i, n in enumerate([5, 0, 7, 9])], "g string, i int, t string")
    got = C.running_budget(rows, "g", 10, "t", F.col("i")).orderBy("i").collect()
    assert [(r["number"], len(r["t"])) for r in got] == [(1, 5), (2, 5)]
    messages = spark.createDataFrame([(1, 0, "system", 50), (1, 1, "user", 50), (1, 2, "assistant", 50), (1, 3, "user", 50)], "session_id int, seq int, role string, tokens int")
    assert [r["seq"] for r in S.evict(messages, hard=110, base=0).orderBy("seq").collect()] == [0, 3]
    assert S.evict(messages, hard=0, base=0).count() == 1


def test_width_variants_are_duplicates(spark):
    """Compatibility forms, case, white space and a heading make no other text; long accented texts stay apart."""
    base = "ABC def 123 " * 30
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in base)
    rows = [(1, base), (2, wide), (3, f"# Title\n{base.lower()}"), (4, "é" * 300), (5, "é" * 300), (6, "e" * 300), (7, base.replace(" ", "\x1c "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["duplicate"]: r["canonical"] for r in C.exact_duplicates(docs).collect()}
    assert got[1] == got[2] == got[3] and got[4] == 5 and 6 not in got and {1, 2, 3, 7} - set(got) == {got[1]}
    from skeinlake.functions import markdown as M
    from skeinlake.functions import text as T

    for r in docs.select("text", T.fingerprint(F.col("text")).alias("f")).collect():
        assert r["f"] == M.normal_form(r["text"])


def test_stable_letters_are_left_by_composition():
    import re
    import unicodedata

    from skeinlake.functions.text import STABLE

    inside = re.compile(f"[{STABLE}]")
    letters = [c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and inside.match(c)]
    assert len(letters) > 30_000
    for c in letters:
        assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and not c.isspace() and len(c.lower()) == 1, hex(ord(c))
    rng = __import__("random").Random(1)
    for _ in range(2000):
        t = "".join(rng.choices(letters, k=20))
        assert unicodedata.normalize("NFKC", t) == t
