"""Helpers that keep tasks small, stored tables and files, and operators against brute force on a few rows."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlake.operators import audit as A
from skeinlake.operators import documents as D
from skeinlake.operators import evaluation as E
from skeinlake.operators import postings as P
from skeinlake.operators import retrieval as R
from skeinlake.sources import tables as S


def test_running_total(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(50), rng.randrange(1, 9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, n int, i int")
    got = S.running_total(df, "upto", F.col("g"), F.col("v"), F.col("i"), amount=F.col("n")).orderBy("upto").collect()
    total = 0
    for r, (g, v, n, i) in zip(got, sorted(rows, key=lambda r: (r[0], r[1], r[3])), strict=True):
        total += n
        assert (r["g"], r["v"], r["i"], r["upto"]) == (g, v, i, total)
    assert S.running_total(df.limit(0), "upto", F.col("v")).count() == 0
    one = S.running_total(df.withColumn("k", F.lit(1)), "place", F.col("k"))  # all rows tie
    assert sorted(r["place"] for r in one.collect()) == list(range(1, 501))


def test_latency_of_any_values(spark):
    rng = random.Random(2)
    groups = {"one": [5.0], "two": [1.0, 9.0], "equal": [3.0] * 40, "many": [float(rng.randrange(20)) for _ in range(301)]}
    calls = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("many", None)], "g string, v double")
    for r in E.latency(calls, "v", "g").collect():
        vs = sorted(groups[r["g"]])
        assert (r["calls"], r["min"], r["max"], r["median"]) == (len(vs), vs[0], vs[-1], float(np.median(vs)))
        assert r["p95"] == vs[max(1, round(len(vs) * 0.95)) - 1]


def test_batches_of_ranges(spark):
    rng = random.Random(3)
    rows = [(lib, i, rng.randrange(1, 60)) for lib in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "library string, i int, tokens int")
    got = D.batched(df, "library", ["i"], most_texts=5, most_tokens=100).orderBy("library", "i").collect()
    assert [(r["library"], r["i"], r["tokens"]) for r in got] == rows
    batches = {}
    for r in got:
        batches.setdefault((r["part"], r["batch"]), []).append(r)
    full = 0
    for own in batches.values():
        assert len({r["library"] for r in own}) == 1 and len(own) <= 5 and (sum(r["tokens"] for r in own) <= 100 or len(own) == 1)
        assert [r["i"] for r in own] == list(range(own[0]["i"], own[0]["i"] + len(own)))
        after = next((r for r in got if (r["library"], r["i"]) == (own[0]["library"], own[-1]["i"] + 1)), None)
        full += after is None or after["part"] != own[0]["part"] or len(own) == 5 or sum(r["tokens"] for r in own) + after["tokens"] > 100
    assert full == len(batches)  # each ends for a reason


def test_length_links(spark):
    rng = random.Random(4)
    ns = [rng.choice((1, 2, 16, 17, 90, 95, 96, 100, 101, 5000, 5200, 5320)) for _ in range(80)]
    got = {r["k"]: (r["n_links"], r["least"], r["most"]) for r in D.length_links(spark.createDataFrame(list(enumerate(ns)), "k int, n int"), "k").collect()}
    for k, n in enumerate(ns):
        near = [m for m in ns if min(m, n) / max(m, n) >= 0.94]
        assert got[k] == (len(near) - 1, min(near), max(near))


# Retrieval


def test_stored_index_answers_alike(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["the"] * 30
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(200)], "id long, text string")
    records = R.records(docs, "id", F.lit("t"), F.col("text"), F.lit(""), F.lit(None).cast("long"), F.col("id").cast("string"))
    queries = spark.createDataFrame([(q, rng.choices(words, k=3)) for q in range(5)], "query_id int, tokens array<string>")
    own = P.Postings(spark, f"file://{tmp_path}/index", folders=16)
    index = own.build(records, "a")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(R.bm25(index, queries)) == rows(R.bm25(records, queries)) != []
    again = P.Postings(spark, f"file://{tmp_path}/index").open("a")
    assert rows(R.bm25_ranking(again, queries)) == rows(R.bm25_ranking(records, queries))
    plan = R.bm25(again, queries.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    with pytest.raises(P.StaleIndex):
        own.open("b")
    with pytest.raises(P.StaleIndex):
        P.Postings(spark, f"file://{tmp_path}/none").open()


def test_index_follows_what_is_added_and_deleted(spark, tmp_path):
    """After each step the index answers as one made from what is left, and its older versions as before."""
    rng = random.Random(9)
    texts = {i: " ".join(rng.choices([f"w{j}" for j in range(15)], k=rng.randint(1, 30))) for i in range(80)}
    queries = spark.createDataFrame([(q, rng.choices([f"w{j}" for j in range(15)], k=4)) for q in range(4)], "query_id int, tokens array<string>")

    def made(some):
        docs = spark.createDataFrame(sorted(some.items()), "id long, text string")
        return R.records(docs, "id", F.lit("t"), F.col("text"), F.lit(""), F.lit(None).cast("long"), F.col("id").cast("string"))

    rows = lambda index: sorted(tuple(r) for r in R.bm25(index, queries).collect())
    own = P.Postings(spark, f"file://{tmp_path}/index", folders=4)
    own.build(made(texts), "0")
    first = rows(own.open("0"))
    left = dict(texts)
    for step in range(4):
        if step % 2 == 0:
            new = {i: f"w{i % 15} w3 new{step}" for i in range(40 * step, 40 * step + 100, 7)}
            left |= new
            got = own.add(made(new), str(step + 1))
        else:
            away = [i for i in left if i % 3 == step % 3] + [10_000]
            left = {i: t for i, t in left.items() if i not in away}
            got = own.delete(spark.createDataFrame([(i,) for i in away], "chunk_id long"), str(step + 1))
        assert rows(got) == rows(made(left))
    assert rows(own.compact()) == rows(made(left)) and not own.table.snapshot().of("gone")
    assert rows(own.open(version=0)) == first
    own.table.vacuum(versions=1, older=0)
    assert rows(own.open("4")) == rows(made(left))


@pytest.mark.parametrize("by", [None, "label"])
def test_many_queries_go_by_tiles(spark, monkeypatch, by):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8 if i % 10 else 4).tolist(), int(rng.integers(3))) for i in range(300)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [None] * 8, 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding", "label").where("vec_id < 60")
    rank = lambda: sorted(tuple(r) for r in R.dense_topk(vectors, queries, 4, by=by).collect())
    at_once = rank()
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 50)
    assert rank() == at_once
    for i, v, label in rows[:60]:
        ids = [j for j, w, other in rows[:300] if len(w) == len(v) and (by is None or other == label)]
        cos = {j: np.round(np.dot(rows[j][1], v) / np.linalg.norm(rows[j][1]) / np.linalg.norm(v), 6) for j in ids}
        want = sorted(ids, key=lambda j: (-cos[j], j))[:4]
        assert [t[-3] if by is None else t[2] for t in sorted((t for t in at_once if t[0] == i), key=lambda t: t[-1])] == want


def test_lexical_scores_pair_by_pair(spark):
    """Against the score of every pair, queries that stand inside other words among them."""
    from skeinlake.functions import text as T

    texts = ["an array of words", "the quick brown fox", "arrays and quick sorts", "nothing", "", "动态规划 and more", "ray of light the", "THE QUICK brown"]
    asks = ["array", "ray", "the quick", "动态规划", "quick brown fox jumps", "", "x"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "document_id int, search_text string, input_pos int")
    queries = spark.createDataFrame(list(enumerate(asks)), "query_id int, query string")
    pairs = queries.select("query_id", T.expand_aliases(F.col("query")).alias("q")).crossJoin(docs)
    want = {(r["query_id"], r["document_id"]): r["s"] for r in pairs.select("query_id", "document_id", F.round(T.lexical_score(F.col("q"), F.col("search_text")), 6).alias("s")).collect() if r["s"] > 0}
    got = {(r["query_id"], r["document_id"]): r["score"] for r in R.lexical_ranking(docs, queries, 100).collect()}
    assert got == want and (1, 0) in got


# Stores


def test_tables_are_replaced_only_when_verified(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(100).withColumn("k", F.col("id") % 3)
    assert S.write_verified(rows, path, "k") == 100
    doubled = spark.read.parquet(path).unionByName(spark.range(5).withColumn("k", F.lit(1).cast("int")))
    assert S.write_verified(doubled, path, "k") == 105 and spark.read.parquet(path).count() == 105  # reads what it replaces
    broken = spark.range(10).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        S.write_verified(broken, path)
    assert spark.read.parquet(path).count() == 105
    assert not [f for f in os.listdir(tmp_path) if ".old-" in f]


def test_reports_and_texts(spark, tmp_path):
    path = f"file://{tmp_path}/r/report.json"
    for n in (1, 2):
        S.write_report(spark, {"名": "值", "n": n}, path)
    text = (tmp_path / "r" / "report.json").read_text()
    assert text == '{\n  "名": "值",\n  "n": 2\n}\n' and json.loads(text)["n"] == 2
    assert os.listdir(tmp_path / "r") == [".report.json.crc", "report.json"] or "report.json" in os.listdir(tmp_path / "r")


def test_records_are_saved(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "text é\n", '{"x": 1}'), ("c", None, None)], "name string, text string, raw string")
    got = {r["name"]: r for r in S.save_records(rows, f"file://{tmp_path}").collect()}
    assert (tmp_path / "markdown" / "a" / "b.md").read_text() == "text é\n" and (tmp_path / "raw" / "a" / "b.json").read_text() == '{"x": 1}'
    assert (tmp_path / "markdown" / "c.md").read_text() == "" and got["c"]["raw_file"] is None and got["a/b"]["chars"] == 7
    for bad in ("/x", "a/../../x"):
        with pytest.raises(Exception, match="leaves the folder"):
            S.save_records(spark.createDataFrame([(bad, "t", None)], "name string, text string, raw string"), f"file://{tmp_path}").count()


def test_staged_tables_can_go(spark):
    df = S.staged(spark.range(3), "gone")
    path = df._staged_at.removeprefix("file://")
    assert os.path.exists(path) and df.count() == 3
    S.discard(df, None, spark.range(1))
    assert not os.path.exists(path)


# Decision rules, one by one

BASE = {"session_id": 1, "step": 0, "action": "delegate", "collection": "c", "query": "q", "agent": "implementation_agent"}
TYPES = "session_id int, step int, action string, collection string, query string, agent string"


def broken(spark, *steps, **task):
    names = sorted({k for s in steps for k in s} | set(task) - set(BASE))
    kinds = {"needs_rag": "boolean", "native_only": "boolean", "must_verify": "boolean", "open_reference": "boolean", "web_up": "boolean", "follow_up": "boolean", "updates": "int"}
    extra = [n for n in names if n not in BASE]
    rows = [tuple({**BASE, **dict.fromkeys(extra), **{k: A.TRACE[k] for k in extra}, **task, **s, "step": i + 1}[k] for k in [*BASE, *extra]) for i, s in enumerate(steps)]
    schema = TYPES + "".join(f", {n} {kinds.get(n, 'string')}" for n in extra)
    return {r["step"]: set(r["rules"].split(",")) for r in A.violations(spark.createDataFrame(rows, schema)).collect()}


def test_decision_rules(spark):
    rag, web, finish = ({"action": a} for a in ("retrieve_rag", "search_web", "finish"))
    solve, check, test = {"action": "delegate", "agent": "implementation_agent"}, {"action": "delegate", "agent": "verification_agent"}, {"action": "execute_code_tests"}
    assert broken(spark, rag, solve, check, finish) == {}
    assert broken(spark, web, needs_rag=True)[1] == {"evidence_first"}
    assert broken(spark, rag, native_only=True)[1] == {"native_only"}
    assert broken(spark, {**rag, "query": " "})[1] == {"evidence_without_query"}
    assert broken(spark, {**rag, "rag_status": "miss"}, solve, needs_rag=True)[2] == {"no_switch_after_miss"}
    assert broken(spark, {**web, "why": None}, {**web, "query": "other", "web_up": False}) == {1: {"web_without_query_or_reason"}, 2: {"web_is_down"}}
    code = {**solve, "code_hash": "h"}
    assert broken(spark, test)[1] == {"test_without_code"}
    assert broken(spark, code, check)[2] == {"code_not_tested"}
    passed, failed = ({**test, "tested_hash": "h", "test_status": s} for s in ("passed", "failed"))
    assert broken(spark, code, passed, check, finish) == {}
    assert broken(spark, code, passed, passed)[3] == {"tested_again"}
    assert broken(spark, code, failed, check, finish) == {3: {"test_failed"}, 4: {"test_failed"}}
    assert broken(spark, code, failed, {**code, "code_hash": "i"}, {**test, "tested_hash": "i", "test_status": "passed"}, check, finish) == {}
    assert broken(spark, {**solve, "instruction": ""})[1] == {"delegate_without_instruction"}
    assert broken(spark, solve, open_reference=True)[1] == {"reference_not_searched"} and broken(spark, web, solve, open_reference=True) == {}
    assert broken(spark, {"action": "persist_memory", "updates": 0}, {"action": "ask_clarification", "question": " "}) == {1: {"memory_without_updates"}, 2: {"clarification_without_question"}}
    assert broken(spark, solve, check, {**finish, "why": None})[3] == {"finish_without_reason"}
    assert broken(spark, solve, {**check, "follow_up": True}, finish)[3] == {"finish_with_open_work"}
    assert broken(spark, solve, finish)[2] == {"finish_without_verification"} and broken(spark, solve, finish, must_verify=False) == {}
    assert broken(spark, check, finish)[2] == {"finish_without_solution"} and broken(spark, solve, check, solve, finish)[4] == {"finish_unverified"}
