"""What the findings of round 4 name: near duplicates are all there, whatever their lengths and openings, and few pairs are looked at one by one."""

import difflib
import random

import pandas as pd
import pytest

from skeinlake.operators import documents as D
from skeinlake.plans import catalogue

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return "".join(rng.choice("bcdfgklmnprstvwz") + rng.choice("aeiou") for _ in range(n // 2))


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def run(spark, tmp_path, name, rows):
    spark.createDataFrame([(k, t, "en", "src0", len(t or "")) for k, t in rows], DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return catalogue.QUERIES[name](spark, str(tmp_path)).collect()


def test_edges_are_all_pairs_at_the_ratio(spark, tmp_path):
    rng = random.Random(4)
    base, long = words(rng, 1_000), words(rng, 4_000)
    rows = [(1, base), (2, base[:870]), (3, words(rng, 250) + long[250:]), (4, long), (5, words(rng, 900)), (6, base.upper()), (7, None), (8, ""), (9, base)]
    got = {(r["left"], r["right"]): r for r in run(spark, tmp_path, "near_dup_edges", rows)}
    assert set(got) == {(1, 2), (3, 4), (1, 6), (1, 9)}  # lengths 0.87 apart, openings nearly so; copies by their least key
    assert got[1, 2]["length_ratio"] < D.LENGTH and got[1, 2]["similarity"] == round(ratio(base, base[:870]), 6)
    assert got[3, 4]["opening_ratio"] < D.PREFIX and got[3, 4]["similarity"] == round(ratio(rows[2][1], long), 6)
    assert got[1, 6]["similarity"] == 1.0


def test_an_alias_may_begin_otherwise(spark, tmp_path):
    rng = random.Random(5)
    long = words(rng, 24_000)
    rows = [(1, words(rng, 300) + long[300:]), (2, long + "!"), (3, words(rng, 600) + long[2_000:])]
    assert [(r["duplicate"], r["canonical"], r["reason"]) for r in run(spark, tmp_path, "dedup_manifest", rows)] == [(1, 2, "near_duplicate")]


@pytest.mark.parametrize("least", [D.CANDIDATE, D.ALIAS])
def test_no_pair_is_lost_by_filters(monkeypatch, least):
    rng = random.Random(6)
    texts = []
    for n in (3, 9, 30, 60, 150, 400, 1_300):
        for _ in range(3):
            base = words(rng, n) if rng.random() < 0.8 else ("abcab" * n)[:n]
            texts.append(base)
            for share in (0.004, 0.01, 0.04, 0.07, 0.1):
                t = list(base)
                for _ in range(max(1, int(share * len(t)))):
                    at = rng.randrange(len(t))
                    t[at : at + rng.choice((0, 1, 2))] = rng.choice(("", "x", "é", "東x"))
                texts.append("".join(t) or "y")
            texts.append(base[len(base) // 12 :] + base[: len(base) // 12])
    texts = sorted(set(texts))
    rng.shuffle(texts)
    rows = pd.DataFrame([(k, t, len(t)) for k, t in enumerate(texts)], columns=["key", "norm", "n"])
    want = {}
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            if 2 * min(len(a), len(texts[j])) >= least * (len(a) + len(texts[j])) and difflib.SequenceMatcher(None, a, texts[j], autojunk=False).quick_ratio() >= least and (r := ratio(a, texts[j])) >= least:
                want[i, j] = round(r, 6)
    assert len(want) > 15
    looked = []
    monkeypatch.setattr(D, "gestalt", lambda *a, f=D.gestalt: looked.append(a) or f(*a))
    for matrix, slab in ((D.MATRIX, D.SLAB), (0, 4_000), (1_000, 9_000)):
        monkeypatch.setattr(D, "MATRIX", matrix)
        monkeypatch.setattr(D, "SLAB", slab)
        looked.clear()
        assert {(a, b): s for a, b, _, s, _ in D._pairs(rows, rows, least)} == want
        assert sum(len(a) == 3 for a in looked) < 2 * len(want) + 100
        half = rows["key"] % 2 == 0
        across = D._pairs(rows[half].reset_index(drop=True), rows[~half].reset_index(drop=True), least)
        assert {(a, b): s for a, b, _, s, _ in across} == {p: s for p, s in want.items() if sum(p) % 2}


def test_the_manifest_looks_for_aliases_alone(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(D, "near_edges", lambda *a, f=D.near_edges: asked.append(a[3:]) or f(*a))
    rng = random.Random(7)
    base = words(rng, 700)
    docs = spark.createDataFrame([(1, base), (2, base[:-3]), (3, base[:-60])], "doc_id long, text string")
    assert [tuple(r) for r in D.near_manifest(docs).collect()] == [(2, 1)]
    assert asked == [(D.ALIAS,)]
