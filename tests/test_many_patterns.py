"""Strings looked up by anchors against plain search; evidence with one key for all rows."""

import random

import numpy as np
import pytest

from skeinlake.operators import curation as C
from skeinlake.operators import evaluation as E


@pytest.mark.parametrize("width", [1, 2, 4, 16, 64])
def test_what_is_held_has_its_anchors_in_the_text(width):
    rng = random.Random(width)
    for _ in range(50):
        text = "".join(rng.choice("ab\u6771\U0001f600") for _ in range(rng.randrange(width, 400)))
        at = rng.randrange(len(text) - width + 1)
        part = text[at : at + rng.randrange(width, 2 * width + 1)]
        own = E.anchors(part, width)
        assert len(own) and np.isin(own, E.anchors(text, width)).all()
        assert (E.anchors(text, width) == E.anchors(text, width, piece=7)).all()
    assert len(E.anchors("a" * (width - 1), width)) == 0


def test_both_ways_find_the_same(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc \u00e9") for _ in range(rng.choice((0, 3, 40, 900)))) for _ in range(40)]
    texts += [texts[7], texts[7], None, "x" * 400_000 + "needle" + "y" * 9]
    parts = [(i, t[a : a + rng.choice((1, 2, 5, 17, 80))]) for i, t in enumerate(texts[:40]) for a in (0, len(t) // 2)]
    parts += [(100, "needle"), (101, "needle"), (102, ""), (103, None), (104, "nowhere at all"), (105, "x" * 300)]
    docs = spark.createDataFrame([(i // 2, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, pattern string")
    patterns = spark.createDataFrame(parts, "pattern_id long, pattern string")
    want = sorted((p, i // 2) for p, s in parts if s for i, t in enumerate(texts) if t and s in t)
    for most in (E.MOST_PATTERNS, 0):
        monkeypatch.setattr(E, "MOST_PATTERNS", most)
        got = E.holders(docs, patterns)
        assert got.columns == ["pattern_id", "doc_id"]
        if most:
            assert {tuple(r) for r in got.collect()} == set(want)
        else:
            assert set(want) == {tuple(r) for r in got.collect()}
    assert E.joined_holders(docs, patterns.where("pattern_id < 0")).count() == 0
    assert E.joined_holders(docs.limit(0), patterns).count() == 0


def test_evidence_of_one_key(spark):
    shape = "pos long, evidence_id string, collection string, source_url string, title string"
    none = spark.createDataFrame([], shape)
    same = spark.createDataFrame([(i, f"x{i}", "c", None, "t" * 1000) for i in range(500)], shape)
    other = spark.createDataFrame([(3, "y", "c", "", "t" * 1000), (2, "z", "c", None, None), (2, "z", "c", None, None)], shape)
    got = sorted((r["pos"], r["evidence_id"]) for r in C.merge_evidence(none, same.union(other), "R").collect())
    assert got == [(0, "R1"), (2, "R2"), (3, "R3")]
    got = sorted((r["side"], r["pos"], r["evidence_id"]) for r in C.merge_evidence(same.limit(3), same.union(other), "x").collect())
    assert got == [(0, 0, "x0"), (0, 1, "x1"), (0, 2, "x2"), (1, 2, "x4"), (1, 3, "x5")]
