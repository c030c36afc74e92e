"""Very long texts, in each operator and in pieces; odd rows through every stage of the pipeline."""

import hashlib
import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skeinlake.llm import bpe, bytetext, matroska, packing, pii, quality, simhash, token_files, tokens, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def long_text(n: int = 5_000_000, seed: int = 3) -> str:
    rng = random.Random(seed)
    known = ["".join(rng.choices("etaoinshrdlué", k=rng.randint(1, 9))) for _ in range(3000)]
    out, size = [], 0
    while size < n:
        s = " ".join(rng.choices(known, k=rng.randint(3, 20))).capitalize() + rng.choice(". ! ? \n".split(" "))
        out.append(s)
        size += len(s) + 1
    return " ".join(out)


# In pieces as in one


def test_hashes_by_block(monkeypatch):
    rng = np.random.default_rng(1)
    buf = np.frombuffer((b"ab cdefg h " * 40 + b"x" * 300 + b" tail ab") * 3 + b"\n", np.uint8)
    starts, ends = bytetext.words(buf)
    whole = bytetext.Hasher(buf).spans(starts, ends)
    monkeypatch.setattr(bytetext, "BLOCK", 64)
    assert (bytetext.Hasher(buf).spans(starts, ends) == whole).all()
    assert len(set(whole.tolist())) == len({bytes(buf[a:b]) for a, b in zip(starts, ends, strict=True)})
    at = np.sort(rng.integers(0, len(buf) - 5, 200))
    assert (bytetext.Hasher(buf).spans(at, at + 5) == np.array([bytetext.Hasher(buf[a : a + 5]).spans(np.array([0]), np.array([5]))[0] for a in at])).all()


@pytest.mark.parametrize("size", [40, 97, 1000])
def test_sentences_by_segment(size):
    rng = np.random.default_rng(size)
    model = toxicity.Model(rng.normal(0, 1, 1 << toxicity.BUCKET_BITS).astype(np.float32), -2.0)
    texts = ["", "one. two! three? four\nfive", "no end at all " * 30, "x" * 500 + " y. " + "z" * 300, "... !!! ... ok. " * 9, "a" * 90, long_text(3000), "end. " + "word " * 60 + "end."]
    for t in texts:
        raw = toxicity.lowered(t)
        if not raw:
            continue
        want = toxicity.sentences(model, [raw])
        got = toxicity.sentences(model, [raw], size)
        assert got[0] == pytest.approx(want[0]) and got[1].tolist() == want[1].tolist()
        assert got[3].tolist() == want[3].tolist()
        assert [raw[a:b].strip() for a, b in zip(got[2], got[3], strict=True)] == [raw[a:b].strip() for a, b in zip(want[2], want[3], strict=True)]


def test_passages_by_segment():
    for n in (1024, 3000, 20_000, 20_480):
        t = long_text(n).encode()[:n]
        whole, first = quality.passages([t], 1 << 30)
        parts, last = quality.passages([t], 2048, 1024)
        assert first.tolist() == last.tolist() and np.allclose(whole, parts)


def test_fingerprints_by_portion():
    for t in (b"", b"  ", b"one", b"one two", b"A b c", b"x" * 100 + b" y z w", long_text(5000).encode()):
        assert len({simhash.fingerprint(t, most=n) for n in (1, 7, 100, 1 << 30)}) == 1


# 5 MB in each operator


@pytest.fixture(scope="module")
def one_long(spark):
    text = long_text()
    return text, spark.createDataFrame([(1, text), (2, "short text."), (3, None)], "doc_id long, text string")


def test_long_text_is_scored(spark, one_long):
    text, docs = one_long
    weights = np.zeros(1 << toxicity.BUCKET_BITS, np.float32)
    weights[toxicity.bags([b"idiot"]).bucket] = 20
    model = toxicity.Model(weights, -30.0)
    toxic = spark.createDataFrame([(1, text), (2, text + " You idiot. " + text[:1000]), (3, None)], "doc_id long, text string")
    a, b, c = toxicity.score(toxic, model).orderBy("doc_id").collect()
    assert a["score"] < 0.7 <= b["score"] and c["score"] == 0 and [text_of(b, s) for s in b["offending"]] == ["You idiot."]
    assert toxicity.select(toxic, model, lambda p: p < 0.7).count() == 2
    rows = [(i, "some good words here, and more. " * (1 + i % 7) if i % 2 else "### $$$ 123 " * 20) for i in range(10, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    p = quality.score(docs, quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)).orderBy("doc_id").collect()
    assert p[0]["score"] > 0.5 and all(0 <= r["score"] <= 1 for r in p) and p[0]["telling_byte"] % quality.PASSAGE == 0


def text_of(row, span) -> str:
    whole = long_text()
    return (whole + " You idiot. " + whole[:1000])[span["start"] : span["end"]].strip()


def test_long_text_is_encoded(spark, one_long):
    text, docs = one_long
    ids = Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids + [2]
    crc = zlib.crc32(np.array(ids, "<u4").tobytes())
    back = token_files.read_documents(token_files.write_token_files(docs, BYTE)).where("key = 1").first()
    assert (back["n_tokens"], back["ids_crc32"]) == (len(ids), crc)
    pieces = packing.pack_documents(docs, BYTE).where("doc_id = 1").orderBy("piece").collect()
    assert [(r["start"], r["length"]) for r in pieces] == [(sum(packing.cut(len(ids), 1024)[:i]), n) for i, n in enumerate(packing.cut(len(ids), 1024))]
    assert zlib.crc32(b"".join(bytes(r["ids"]) for r in pieces)) == crc
    words = Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids
    got = bpe.encode_documents(docs, WORD, texts=False).where("doc_id = 1").first()
    assert (got["n_tokens"], got["ids_sha256"]) == (len(words), hashlib.sha256(" ".join(map(str, words)).encode()).hexdigest())


def test_long_text_is_stored_and_linked(spark, one_long):
    text, docs = one_long
    got = matroska.store_texts(docs, keep_media=False).where("doc_id = 1").first()
    payload = matroska.padded(text.encode())
    assert (got["n_bytes"], got["payload_sha256"]) == (len(text.encode()), hashlib.sha256(payload).hexdigest())
    copies = docs.union(spark.createDataFrame([(9, text), (8, text + " more words here.")], "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(copies).collect()} == {1: 1, 9: 1, 8: 1, 2: 2, 3: 3}
    long = spark.createDataFrame([(1, text + " 8.8.8.8")], "doc_id long, text string")
    assert pii.pseudonymize(long, "k").first()["n_ipv4"] == 1


# Odd rows through the pipeline


def odd_rows(spark, sf: str):
    """The smallest documents, and among them nulls, repeats, a long text and columns that are named as others inside."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.schema
    extra = [(None, None, None, None, None), (None, "", "en", "s", 0), (7, None, "en", None, None), (1_000_000, long_text(3_000_000), "en", "s", None), (None, None, None, None, None)]
    rows = docs.unionByName(spark.createDataFrame(extra, some)).unionByName(docs.limit(5))
    return rows.withColumns({"n_email": F.lit("mine"), "score": F.lit(3), "fp": F.lit("x"), "__row": F.lit(1), "component": F.col("doc_id"), "y": F.lit(None).cast("int")})


def test_odd_rows_through_each_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = odd_rows(spark, sf)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, sf), f"odd-{name}")
        if name == "packing":
            break
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.where("n_email <> 'mine' OR score <> 3 OR __row <> 1").count() == 0
        assert 0 < out.count() <= docs.count()
        if name == "simhash":
            assert out.where("doc_id IS NOT NULL").groupBy(F.xxhash64("text")).count().where("count > 1").count() == 0
        docs = out
    want = docs.select("doc_id").distinct().count()
    assert out.select("doc_id").distinct().count() == want and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_stages_without_optional_columns(spark):
    """Only key and text: enough for every stage."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "doc_id")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf) if stage is corpus_pipeline.STAGES[-1][1] else corpus_pipeline.staged(stage(spark, docs, sf), "bare")
    assert docs.count() > 0


def test_added_tokens_of_any_spelling(tmp_path):
    """Added tokens are what the file says, not what they look like."""
    with open(BYTE) as f:
        model = json.load(f)
    like = dict(model["added_tokens"][0])
    for name, extra in (("plain", ["abc."]), ("spaced", ["end of text"])):
        model["added_tokens"] = [model["added_tokens"][0], *({**like, "id": 50257 + i, "content": c} for i, c in enumerate(extra))]
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(model))
        lib, own = Tokenizer.from_file(str(path)), tokens.ChunkEncoder(str(path))
        for text in ("abc. xabc. abc.y abc", "the end of text here", "end of  text.", "abc abc abc.", "xabc. xabc xabc."):
            assert np.frombuffer(own.encode(text), own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, (name, text)


def test_words_of_letters_as_the_library_has_them(tmp_path):
    """Words that the model gets directly: Latin letters of all kinds, behind blanks and line ends, with marks, and beside added tokens of letters."""
    rng = random.Random(11)
    latin = [chr(c) for c in range(33, 0x260)] + list("'sdtm\n\n  \u4e2d\u0301\u0660")
    texts = ["".join(rng.choices(latin, k=rng.randint(1, 60))) for _ in range(2000)]
    texts += [" ".join("".join(rng.choices("abz\u00e9\u00df\u010d\u01bb\u024f", k=rng.randint(1, 14))) + rng.choice(["", ".", "\n", "'s", "\u0250"]) for _ in range(30)) for _ in range(200)]
    model = json.loads(Path(BYTE).read_text())
    for i, extra in enumerate(([], ["ab"], ["\n"], ["\nza"])):
        like = dict(model["added_tokens"][0])
        named = {**model, "added_tokens": [like, *({**like, "id": 50257 + k, "content": c} for k, c in enumerate(extra))]}
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(named))
        lib, own = Tokenizer.from_file(str(path)), tokens.ChunkEncoder(str(path), keep=500)
        assert (own.model is None) == bool(extra)
        for text in texts:
            assert np.frombuffer(own.encode(text), own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, (extra, text)
