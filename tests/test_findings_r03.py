"""What the findings of round 3 name: results on rows that the small tables lack, and plans that grow with their input alone."""

import glob
import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from skeinlake.llm import collocations as L
from skeinlake.operators import documents as D
from skeinlake.operators import evaluation as E
from skeinlake.operators import retrieval as R
from skeinlake.operators.postings import Postings
from skeinlake.plans import catalogue
from skeinlake.sources import commits
from skeinlake.streaming import keyed, stateful


def run(spark, tmp_path, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return catalogue.QUERIES[name](spark, str(tmp_path))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_comment_heading_counts_as_eight_letters(spark, tmp_path):
    rows = [(k, "x" * n, "en", "src0", n) for k, n in ((65, 192), (70, 191))]
    got = {r["doc_id"]: r["rejects"] for r in run(spark, tmp_path, "hard_rejects", documents=(rows, DOCS)).collect()}
    assert got == {65: "", 70: "short,noise"}


def test_letters_without_a_capital_of_their_own_are_still_the_term(spark, tmp_path):
    rows = [(2, 2, "user", "Die Straße und der Fluß sind heute ganz nah"), (2, 4, "user", "SSß ssßs SS")]
    got = run(spark, tmp_path, "intent_assertions", conversations=(rows, "conv_id long, turn int, role string, text string")).collect()
    assert {r["turn"]: r["failures"] for r in got} == {2: "intent", 4: "intent"}


def test_the_line_end_of_a_post_is_no_letter_of_it(spark, tmp_path):
    rows = [(k, "x" * n, "en", "src10", n) for k, n in ((0, 289), (1, 290))]
    got = {r["doc_id"]: r["post_sha256"] for r in run(spark, tmp_path, "post_extraction", documents=(rows, DOCS)).collect()}
    assert got == {0: None, 1: hashlib.sha256(("## src10\n\n" + "x" * 290 + "\n").encode()).hexdigest()}


def test_all_messages_of_a_session_are_counted(spark, tmp_path):
    rows = [(c, t, ("user", "assistant", "system")[t % 3], "x") for c, n in ((5, 7), (9, 1)) for t in range(n)]
    got = run(spark, tmp_path, "session_message_count", conversations=(rows, "conv_id long, turn int, role string, text string")).collect()
    assert {r["session_id"]: (r["messages"], r["message_count"]) for r in got} == {5: (7, 2), 9: (1, 0)}


def test_grams_in_common_leave_few_pairs_to_be_compared_and_lose_none(monkeypatch):
    rng = random.Random(7)
    syllables = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.choice((2, 2, 3)))) for _ in range(60)]
    texts = ["".join(rng.choices(syllables, k=1_100))[:2_500] for _ in range(40)]
    for t in texts[:10]:
        at = [rng.randrange(len(t)) for _ in range(90)]
        texts.append("".join(c for i, c in enumerate(t) if i not in at[:45]) + "z" * 20)
        texts.append("".join("z" if i in at else c for i, c in enumerate(t)))
    short = ["".join(rng.choices("ab", k=n)) for n in (3, 4, 5, 9, 9, 9)]
    rows = pd.DataFrame([(k, t, len(t)) for k, t in enumerate(texts + short)], columns=["key", "norm", "n"])
    calls = []
    monkeypatch.setattr(D, "common_length", lambda a, b, f=D.common_length: calls.append(1) or f(a, b))
    got = {(a, b) for a, b, *_ in D._pairs(rows, rows)}
    assert len(calls) < 250  # of 1,830 pairs
    near = lambda a, b: min(len(a), len(b)) >= D.LENGTH * max(len(a), len(b)) and D.gestalt(a[:600], b[:600]) >= D.PREFIX and D.gestalt(a, b) >= D.CANDIDATE
    all_ = texts + short
    kin = [(i, j) for i in range(len(all_)) for j in range(i + 1, len(all_)) if i < 10 and j >= 40 or i >= 40]
    assert got == {p for p in kin if near(all_[p[0]], all_[p[1]])} and len(got) >= 20
    monkeypatch.setattr(D, "MATRIX", 0)
    assert {(a, b) for a, b, *_ in D._pairs(rows, rows)} == got


def test_records_are_counted_where_they_are_and_pairs_dealt_to_tasks_that_hold_them(spark, monkeypatch):
    rows = [(k, str(k), ["a"] * (k % 3) + ["树", "b"] + ["a"] * (k % 2), 2 + k % 3 + k % 2) for k in range(50)] + [(50, "50", [], 0)]
    own = spark.createDataFrame(rows, "chunk_id long, document_id string, tokens array<string>, len int")
    plain = R.counted(own.select("chunk_id", "document_id", "len", F.explode("tokens").alias("term")))
    each = R.counted_each(own)
    assert sorted(map(tuple, each.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert "Exchange" not in each._jdf.queryExecution().executedPlan().toString()
    queries = spark.createDataFrame([(q, ["a", "树"]) for q in range(4)], "query_id long, tokens array<string>")
    whole = sorted(map(tuple, R.bm25(own, queries).collect()))
    monkeypatch.setattr(R, "PAIRS", 10)
    dealt = R.bm25(own, queries)
    assert ", 21), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()  # 51 chunks, 4 queries
    assert sorted(map(tuple, dealt.collect())) == whole and len(whole) == 200


def test_scores_of_a_block_are_made_in_portions(monkeypatch):
    rng = np.random.default_rng(3)
    vectors, names = rng.normal(size=(60, 8)), list(range(40))
    batch = pa.record_batch({"vec_id": pa.array(range(60)), "v": pa.array(vectors.tolist())})
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    whole = R._best(names, vectors[:40], batch, 8, 5, "vec_id", 6, kinds, None).to_pylist()
    sizes = []
    monkeypatch.setattr(R, "SCORES", 200)
    monkeypatch.setattr(R.np, "round", lambda x, n, f=np.round: sizes.append(x.size) or f(x, n))
    assert R._best(names, vectors[:40], batch, 8, 5, "vec_id", 6, kinds, None).to_pylist() == whole and len(whole) == 200
    assert max(sizes) <= 200


def test_rows_are_made_for_slices_of_a_batch(monkeypatch):
    class Rows:
        select = lambda self, *columns: self
        mapInPandas = lambda self, run, schema: run

    monkeypatch.setattr(D, "SLICE", 100, raising=False)
    run = D.each(Rows(), "k", ["t"], lambda r: [{"n": len(r[1] or "")}], "k long, n long")
    frames = list(run(iter([pd.DataFrame({"k": range(20), "t": ["x" * 30] * 10 + [None] + ["y" * 300] * 9}), pd.DataFrame({"k": [20], "t": [None]})])))
    assert [(k, n) for f in frames for k, n in zip(f["k"], f["n"], strict=True)] == [(k, 30 if k < 10 else 0 if k in (10, 20) else 300) for k in range(21)]
    assert max(len(f) for f in frames) <= 4


def test_a_batch_of_packed_suffixes_is_counted_in_slices_of_its_bytes(monkeypatch):
    words = [f"{k:03d} ".encode() for k in range(300, 0, -1)]
    batch = pa.record_batch({"part": pa.array([0] * 300, pa.int32()), "lang": pa.array([b"en"] * 300), "word": pa.array(words), "rest": pa.array([b"\n"] * 300), "counts": pa.array([b"\x02\0\0\0"] * 300)})
    sizes = []
    monkeypatch.setattr(L, "HELD", 20)
    monkeypatch.setattr(L, "_closed", lambda table, least, f=L._closed: sizes.append(len(table)) or f(table, least))
    got = [r for b in L._prefixes(iter([batch]), 1) for r in b.to_pylist()]
    assert max(sizes) <= 40 and {r["phrase"]: r["f"] for r in got if r["size"]} == {w.decode().strip(): 2 for w in words}
    assert sum(r["f"] for r in got if not r["size"]) == 600


def test_holders_are_counted_where_the_texts_are(spark, monkeypatch):
    rng = random.Random(5)
    alphabet = "ab树é😀 "
    texts = ["".join(rng.choices(alphabet, k=rng.choice((0, 1, 2, 5, 30, 90, 400)))) for _ in range(150)]
    texts += [texts[-1][:60] + t for t in texts[:30]] + [None, "", texts[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cut = [(k, t[: rng.choice((1, 3, 8, 16, 17, 40, 109))]) for k, t in enumerate(texts) if t] + [(900, "nowhere at all"), (901, ""), (902, None), (903, "ab")]
    patterns = spark.createDataFrame(cut + [(1000 + k, p) for k, p in cut[:9]], "pattern_id long, pattern string")
    want = {}
    for k, p in cut + [(1000 + k, p) for k, p in cut[:9]]:
        if p and (held := [i for i, t in enumerate(texts) if t and p in t]):
            want[k] = (len(held), held[0])
    for kept, piece in ((E.KEPT, E.PIECE), (7, 50)):
        monkeypatch.setattr(E, "KEPT", kept)
        monkeypatch.setattr(E, "PIECE", piece)
        got = E.counted_holders(docs, patterns)
        assert {r["pattern_id"]: (r["documents"], r["first"]) for r in got.collect()} == want and got.count() == len(want)
    assert E.counted_holders(docs, patterns.limit(0)).count() == 0


def test_texts_that_share_an_opening_make_no_row_each(spark, tmp_path):
    rows = [(k, "the same opening of very many near copies, long enough for all of its lengths, " * 2 + str(k), "en", "s", 1) for k in range(400)]
    got = run(spark, tmp_path, "opening_holders", documents=(rows, DOCS))
    found = got.collect()
    assert len(found) == 90 and {(r["documents"], r["first"]) for r in found} == {(400, 0)}
    found = E._windows(spark.createDataFrame(rows, DOCS).repartition(2), spark.createDataFrame([(0, rows[0][1][:50])], "pattern_id long, pattern string"), "doc_id", "text")
    sums = [r["documents"] for r in found.collect()]
    assert len(sums) == 2 and sum(sums) == 400


def test_texts_are_read_and_hashed_once_for_duplicates(spark, tmp_path):
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(["# a\nSame  text", "sametext", "other", "ＳＡＭＥ text", "é x", "É X", "# b\nsame text" + " " * 200])] + [(7, None, "en", "s", 0), (8, None, "en", "s", 0)]
    got = {"exact_duplicates": run(spark, tmp_path, "exact_duplicates", documents=(rows, DOCS))}
    got |= {n: run(spark, tmp_path, n) for n in ("canonical_by_length", "quality_gate_processed")}
    assert {n for n, df in got.items() if any("documents.parquet" in f for f in df.inputFiles())} == {"canonical_by_length"}
    assert got["canonical_by_length"]._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    of = {0: 6, 1: 6, 3: 6, 4: 5}
    assert {r["duplicate"]: r["canonical"] for r in got["exact_duplicates"].collect()} == of
    assert {tuple(r) for r in got["canonical_by_length"].collect()} == {(6, len(rows[6][1])), (5, 3)}
    gate = {r["doc_id"]: (r["canonical"], r["same_text"], r["long_enough"]) for r in got["quality_gate_processed"].collect()}
    assert gate == {k: (of[k], False, True) if k in of else (None, True, False if k < 7 and k != 6 else k == 6 or None) for k in range(9)}


class _State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_a_user_is_one_group_of_the_mastery_stream():
    class Rows:
        def groupBy(self, *by):
            self.by = by
            return self

        applyInPandasWithState = lambda self, fold, *rest: fold

    fold = stateful.stream_mastery(rows := Rows())
    assert rows.by == ("user_id",)
    made = lambda *r: pd.DataFrame(r, columns=["user_id", "concept", "ts", "seq", "outcome"])
    state = _State()
    first = pd.concat(fold((7,), iter([made((7, "b", 2, 2, "incorrect"), (7, "a", 1, 1, "correct")), made((7, None, 1, 3, "reviewed"), (7, "a", 3, 4, "hinted"))]), state))
    then = pd.concat(fold((7,), iter([made((7, "b", 4, 5, "correct"))]), state))
    assert {(r.concept, r.n) for r in first.itertuples()} == {("a", 2), ("b", 1), (None, 0)} and [(r.concept, r.n) for r in then.itertuples()] == [("b", 2)]
    whole = pd.concat(fold((7,), iter([made((7, "b", 2, 2, "incorrect"), (7, "b", 4, 5, "correct"))]), _State()))
    assert list(whole["mastery"]) == list(then["mastery"])


def test_what_is_over_costs_a_few_calls_to_the_store_for_each_key():
    calls = []

    class Value(_State):
        def __init__(self):
            self.value = None

        exists = lambda self: calls.append("exists") or self.value is not None
        get = lambda self: calls.append("get") or self.value
        clear = lambda self: self.update(None)

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        getValueState = lambda self, *a: Value()
        registerTimer = lambda self, at: calls.append("timer")

    class Times:
        getCurrentWatermarkInMs = lambda self: 10**15

    own = keyed._Streams()
    own.init(Handle())
    rows = pd.DataFrame({"ts": pd.to_datetime(range(300), unit="s"), "stream": range(300), "cancels": False})
    cancels = rows.assign(cancels=True)[::3]
    out = [r.stream for f in own.handleInputRows((1,), iter([rows, cancels]), Times()) for r in f.itertuples()]
    assert sorted(out) == list(range(299)) and len(calls) < 12
    again = [r.stream for f in own.handleInputRows((1,), iter([cancels, rows]), Times()) for r in f.itertuples()]
    assert again == []
    list(own.handleExpiredTimer((1,), Times(), None))
    assert own.over.value is None or set(own.over.value[0]) <= {299}


def test_rankings_are_made_once_and_meet_the_texts_without_dealing_them(spark, tmp_path):
    rng = random.Random(2)
    words = ["graph", "tree", "queue", "树图论", "heap", "sort"]
    rows = [(k, " ".join(rng.choices(words, k=12)), "en", "s", 1) for k in range(60)]
    asks = ([(k, " ".join(rng.choices(words, k=3))) for k in range(5)], "item_id long, text string")
    run(spark, tmp_path, "bm25_top5", documents=(rows, DOCS), benchmark=asks)
    got = {n: run(spark, tmp_path, n) for n in ("rerank_by_provider", "hybrid_with_fallback", "eval_candidate_final_grid")}
    postings = {n for n, df in got.items() if any("/postings-" in f for f in df.inputFiles())}
    assert postings == {"eval_candidate_final_grid"}
    assert not any("documents.parquet" in f for f in got["eval_candidate_final_grid"].inputFiles())
    assert len(got["rerank_by_provider"].collect()) == 20


def test_postings_are_sorted_once_as_they_are_written(spark, tmp_path, monkeypatch):
    own = spark.createDataFrame([(k, str(k), ["b", "a", "树树树"], 3) for k in range(20)], "chunk_id long, document_id string, tokens array<string>, len int")
    orders = []
    monkeypatch.setattr(commits.Table, "write", lambda self, df, part, kind="rows", *a, f=commits.Table.write, **b: orders.append((kind, "Sort" in df._jdf.queryExecution().optimizedPlan().toString(), b.get("order"))) or f(self, df, part, kind, *a, **b))
    Postings(spark, f"file://{tmp_path}/p", 1).build(own, "x")
    assert ("postings", False, ("term",)) in orders
    files = glob.glob(f"{tmp_path}/p/data/*/kind=postings/*/*.parquet")
    terms = [[r["term"] for r in spark.read.parquet(f).collect()] for f in files]
    assert sum(map(len, terms)) == 60 and all(t == sorted(t) for t in terms)
