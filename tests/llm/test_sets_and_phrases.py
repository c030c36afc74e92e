"""Whitening, license scans and collocations against brute force, and what they do with odd rows."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skeinlake.llm import collocations as C
from skeinlake.llm import licenses as L
from skeinlake.llm import whitening as W

# Collocations


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def brute_phrases(docs, least, top=2000):
    f = Counter()
    for lang, text in docs:
        for ws in words_of(text):
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang or "und", tuple(ws[i : i + k])] += 1
    out = []
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for lang in {p[0] for p in f}:
        n = sum(a for (g, p), a in f.items() if g == lang and len(p) == 1)
        rows = []
        for (g, p), a in candidates.items():
            if g != lang or any(len(q) > len(p) and h == g and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (h, q), b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def made_docs(n, seed=0):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "x\x01", "x", "Été", "日本", "The", "b.c", "d,", "e!", "\tf", "long" * 30, "g h"]
    return [(rng.choice(["en", "de", None, "e n"]), rng.choice([" ", "  ", "\n"]).join(rng.choices(vocabulary, [9, 8, 5, 3, 3, 2, 2, 2, 1, 1, 1, 1, 1, 1], k=rng.randrange(60)))) for _ in range(n)]


def test_collocations_are_those_of_brute_force(spark):
    docs = [*made_docs(150), ("en", None), (None, ""), ("en", " . ,"), ("en", "New York City. " * 40)]
    for parts in ("4", "37"):  # many ranges cut frequent words and pairs
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = spark.createDataFrame([(1, "x", *d) for d in docs], "doc_id int, phrase string, lang string, text string")
        got = sorted(tuple(r) for r in C.collocations(rows, least=5).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == brute_phrases(docs, 5) and len(got) > 50


def test_collocations_top_ties_and_empty(spark):
    docs = [("en", "b a. c a. d a. " * 3)]
    rows = spark.createDataFrame(docs, "lang string, text string")
    assert [r["phrase"] for r in C.collocations(rows, least=3, top=2).orderBy("rank").collect()] == ["b a", "c a"]
    assert C.collocations(rows.limit(0)).count() == 0 and C.collocations(rows, least=100).count() == 0


@pytest.mark.parametrize("portion", [7, 64, 1 << 20])
def test_prefixes_of_long_texts_and_any_bounds(monkeypatch, portion):
    monkeypatch.setattr(C, "PORTION", portion)
    monkeypatch.setattr(C, "ROOM", 32)
    monkeypatch.setattr(C, "HELD", 200)
    docs = [(lang or "und", text) for lang, text in made_docs(30, 3)]
    batch = pa.record_batch({"lang": pa.array([d[0] for d in docs]), "text": pa.array([d[1] for d in docs])})
    bounds = sorted({(lang.encode(), b) for lang in ("en", "und", "zz") for b in (b"the ", b"the of ", b"x\x01 the a x", b"of a of the ", b"m")})
    rows = [r for b in C._suffixes(iter([batch]), bounds) for r in b.to_pylist()]
    rows.sort(key=lambda r: tuple(-b for b in (*r["word"], -300)))
    rows.sort(key=lambda r: (-sum(x * 256 ** (9 - i) for i, x in enumerate(r["lang"].ljust(10, b"\0")))))
    rows.sort(key=lambda r: r["part"])
    packed = pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("lang", pa.binary()), ("word", pa.binary()), ("rest", pa.binary()), ("counts", pa.binary())]))
    got = Counter()
    for b in C._prefixes(iter([packed.slice(i, 5) for i in range(0, packed.num_rows, 5)]), 4):
        for r in b.to_pylist():
            got[r["lang"], r["phrase"]] += r["f"]
    want = Counter()
    for lang, text in docs:
        for ws in words_of(text):
            want[lang, ""] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    want[lang, " ".join(ws[i : i + k])] += 1
    kept = {p: n for p, n in want.items() if n >= 4 or not p[1]}
    assert {p: n for p, n in got.items() if n >= 4 or not p[1]} == {p: n for p, n in kept.items() if n}


# Licenses


def brute_licenses(text, templates, threshold=0.8):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    step = L.block_words(templates)
    out = []
    for i, t in enumerate(templates):
        own = [x.decode() for x in t.words()]
        if t.phrase:
            out += [(i, p, 1.0) for p in range(len(w)) if w[p : p + len(own)] == own]
        else:
            out += [(i, b, c) for b in range(0, len(w), step) if (c := len(set(w[b : b + 2 * step]) & set(own)) / len(set(own))) >= threshold]
    return len(w), sorted(out)


def license_texts():
    rng = random.Random(5)
    texts = [None, "", "...", "CC BY cc-by, CC  BY!", "All rights\nreserved. all rights", "GNU General Public License general public license", "Reservé 日本 all rights reserved"]
    for t in L.TEMPLATES:
        ws = t.wording.split()
        for keep in (1.0, 0.85, 0.75):
            some = [x for x in ws if rng.random() < keep]
            texts.append(" ".join(rng.choices(["lorem", "the", "license", "of", "cc", "ipsum"], k=rng.randrange(300))) + " " + " ".join(some) + " tail" * rng.randrange(50))
    return texts


def test_licenses_are_those_of_brute_force(spark):
    templates = (*L.PHRASES, *L.TEMPLATES)
    texts = license_texts()
    docs = spark.createDataFrame([(i % 50 or None, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, found string")
    got = L.scan(docs).collect()
    want = [brute_licenses(t, templates) for t in texts]
    key = lambda n, found: (n, sorted((f["template"], f["place"], f["containment"]) for f in found))
    assert sorted(map(str, (key(r["n_words"], r["found"]) for r in got))) == sorted(map(str, want))
    assert sum(len(f) for _, f in want) > 60
    odd = {r["n_words"]: r for r in L.digest(L.scan(docs.limit(3))).collect()}
    assert odd[0]["labels"] == odd[0]["base_labels"] == "" and odd[0]["score"] == 0.0 and odd[0]["first_word"] is None and odd[0]["n_base"] == 0
    assert L.scan(docs.limit(0)).count() == 0


def test_licenses_in_portions_and_in_passes(spark, monkeypatch):
    templates = (*L.PHRASES, *L.TEMPLATES)
    step = L.block_words(templates)
    text = " ".join(t for t in license_texts() if t)
    index = L.Index(templates, {}, 0.8, step)
    whole = L._found(index, pa.array([text]))
    monkeypatch.setattr(L, "PORTION", step * 3)
    cut = L._found(index, pa.array([text]))
    assert whole[1] == cut[1] and whole[0].tolist() == cut[0].tolist()
    assert sorted((t, p, n / int(index.sizes[t])) for _, t, p, n in whole[1]) == brute_licenses(text, templates)[1]
    monkeypatch.setattr(L, "MOST_WORDS", 30)
    assert len(list(L._parts(templates))) > 3
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    (got,) = L.digest(L.scan(docs)).collect()
    assert set(got["labels"].split(",")) == {t.label for t in templates} and got["score"] == 1.0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_filters_lose_no_block(threshold):
    rng = random.Random(int(threshold * 10))
    letters = [f"w{i}" for i in range(40)]
    templates = tuple(L.Template(str(i), " ".join(rng.sample(letters, rng.randrange(1, 15)))) for i in range(20))
    index = L.Index(templates, {w.encode(): rng.randrange(9) for w in letters}, threshold, 20)
    blocks = [rng.sample(range(len(index.vocabulary)), rng.randrange(1, 30)) for _ in range(200)]
    flat = [(b, r) for b, rs in enumerate(blocks) for r in rs]
    got = index.contained(*(np.array(c, np.int64) for c in zip(*flat, strict=True)))
    want = {(b, t, n) for (b, rs), t in itertools.product(enumerate(blocks), range(20)) if (n := int(index.members[t, rs].sum())) / index.sizes[t] >= threshold}
    assert set(zip(*(c.tolist() for c in got), strict=True)) == want


# Whitening


def brute_whitening(rows, k=32):
    x = np.floor(np.array(rows, float) * 64) + 1_000_000
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return x, values, centred @ vectors / np.sqrt(values), values / (centred**2).sum() * len(x)


@pytest.mark.parametrize("d", [8, 64, 150])
def test_whitening_is_that_of_all_eigenvectors(spark, d):
    rng = np.random.default_rng(d)
    vectors = rng.standard_normal((400, d)) * np.geomspace(30, 0.5, d)
    if d == 150:  # a range of few dimensions and noise: the basis needn't be widened
        vectors = rng.standard_normal((400, 34)) @ rng.standard_normal((34, d)) * 100
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id int, embedding array<double>, component int")
    got = W.whitened(df).toPandas().sort_values(["vec_id", "component"])
    x, values, want, explained = brute_whitening(vectors)
    k = min(d, 32)
    assert len(got) == 400 * k
    mine = got["whitened"].to_numpy().reshape(400, k)
    mine *= np.sign((mine * want).sum(axis=0))
    assert np.abs(mine - want).max() < 1e-6 and np.abs(got["explained"].to_numpy().reshape(400, k)[0] / explained - 1).max() < 1e-9
    assert (got["identity_error"] < 1e-9).all() and got["identity_error"].nunique() == 1
    sums = [sum(map(int, c)) for c in x.T]
    exact = [sum((400 * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    assert got["deviation"].to_numpy().reshape(400, k)[:, 0].tolist() == exact and (got["n"] == 400).all()


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, None], [nan, 0.0], [inf, 1.0], [1.0], [1.0, 2.0, 3.0]]
    plain = [[0.1, 0.2], [0.5, -1.0], [0.5, -1.0], [-2.0, 0.3]]
    df = spark.createDataFrame(list(enumerate([*odd, *plain])), "vec_id int, embedding array<double>")
    got = W.whitened(df).toPandas()
    assert sorted(got["vec_id"]) == [7, 7, 8, 8, 9, 9, 10, 10] and (got["n"] == 4).all() and got["identity_error"].max() < 1e-9
    twins = got[got["vec_id"].isin([8, 9])].groupby("component")["whitened"].nunique()
    assert (twins == 1).all()
    assert W.whitened(df.limit(0)).count() == 0 and W.whitened(df.where("vec_id = 7")).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(4)], "vec_id int, embedding array<double>")
    assert {r["component"] for r in W.whitened(flat).collect()} == {1}
    assert W._deviations(np.array([[2.0**40, 0.0]]), 10**6, [0, 0]) == [None]
