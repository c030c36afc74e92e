"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A document is a bag of sentences (cut behind . ! ? and line ends). A sentence's probability is logistic in the sum of its
features' weights; features are hashed words and hashed five-byte pieces of words (lower-cased), so that forms of a word
share what they have in common. A document is toxic unless every sentence is clean: 1 - product of (1 - p). The log-likelihood of document labels
under this noisy-or is maximised directly, which tells the guilty sentences from their neighbours without sentence labels;
they are then located as character spans.

Training takes at most `Settings.sample` labelled documents of each class, by a hash of their key among those of at most
`Settings.longest` bytes, on the driver; classes are weighted to their shares among all labelled rows. Scoring covers every whole
text: longer ones than `SEGMENT` bytes are read in segments that end where a sentence does, and one without an end is added up
over its segments, so that memory stays bounded.

Defined results: null and empty texts, and texts without words, have no sentence and score 0.0; equal texts score alike;
repeated rows are scored each; contradictory labels of a key count as 1; of a key's several texts one is learned from; labels or keys that are null are not learned from; without both
classes all scores are 0.0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import WORD, Hasher, joined, lookup, words
from .common import keep_rows, plain_text, slices, staged, texts_sizes

BUCKET_BITS = 18
PIECE = 5
_BREAK = lookup(b".!?\n")


@dataclass(frozen=True)
class Settings:
    sample: int = 4000
    longest: int = 65_536
    least_df: int = 5
    least_odds: float = 1.0
    rounds: int = 250
    rate: float = 0.1
    l2: float = 2e-5


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def lowered(text: str) -> bytes:
    """Lower case with as many characters."""
    return (text.replace("İ", "I") if "İ" in text else text).lower().encode()


@dataclass
class Bags:
    """Features of a slice of texts: bucket and sentence of each; document, start and end byte (in the text) of each sentence."""

    bucket: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bags(texts: list[bytes]) -> Bags:
    buf, at = joined(texts)
    starts, ends = words(buf)
    hashes = Hasher(buf)
    stops = np.flatnonzero(_BREAK[buf]) + 1  # each sentence's end; the last byte is a newline
    inside = WORD[buf]
    whole = inside[: -PIECE + 1].copy()
    for i in range(1, PIECE):
        whole &= inside[i : len(inside) - PIECE + 1 + i]
    pieces = np.flatnonzero(whole)
    bucket = np.concatenate([hashes.spans(starts, ends) ^ np.uint64(1 << 63), hashes.spans(pieces, pieces + PIECE)]) >> np.uint64(64 - BUCKET_BITS)
    of_byte = np.zeros(len(buf) + 1, np.int32)
    of_byte[stops] = 1
    np.cumsum(of_byte, out=of_byte)
    # Only sentences with words count.
    has = np.zeros(len(stops), bool)
    has[of_byte[starts]] = True
    number = np.cumsum(has, dtype=np.int32) - 1
    sentence = number[of_byte[np.concatenate([starts, pieces])]]
    begin = np.append(0, stops[:-1])[has]
    document = np.searchsorted(at, begin, side="right") - 1
    return Bags(bucket.astype(np.int32), sentence, document, begin - at[document], np.minimum(stops[has], at[document + 1] - 1) - at[document])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def sentence_scores(model: Model, b: Bags) -> np.ndarray:
    return _sigmoid(np.bincount(b.sentence, model.weights[b.bucket], len(b.document)) + model.bias)


#: Bytes of one text that are read at once.
SEGMENT = 2 << 20


def segments(raw: bytes, size: int) -> Iterator[tuple[int, int, bool]]:
    """Where segments of a text start and end, and whether a sentence ends there: each is cut at its last sentence end, without one
    behind its last byte that is of no word, and where all are, behind the word."""
    at = 0
    while at < len(raw):
        stop, whole = at + size, True
        if stop < len(raw):
            some = np.frombuffer(raw, np.uint8, size, at)
            if len(ends := np.flatnonzero(_BREAK[some])):
                stop = at + int(ends[-1]) + 1
            elif len(gaps := np.flatnonzero(~WORD[some])):
                stop, whole = at + int(gaps[-1]) + 1, False
            else:
                while stop < len(raw) and WORD[raw[stop]]:
                    stop += 1
                whole = False
        yield at, min(stop, len(raw)), whole
        at = stop


def sentences(model: Model, raw: list[bytes], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence with words: its score, document, and start and end byte."""
    if len(raw) != 1 or len(raw[0]) <= size:
        b = bags(raw)
        return sentence_scores(model, b), b.document, b.start, b.end
    sums, starts, ends = [], [], []
    known = False  # whether the last sentence found goes on in the next segment
    for a, z, whole in segments(raw[0], size):
        b = bags([raw[0][a:z]])
        own = np.bincount(b.sentence, model.weights[b.bucket], len(b.document))
        joins = known and len(own) > 0 and b.start[0] == 0
        if joins:
            sums[-1][-1] += own[0]
            ends[-1][-1] = a + b.end[0]
        skip = int(joins)
        if len(own) > skip:
            sums.append(own[skip:])
            starts.append(a + b.start[skip:])
            ends.append(a + b.end[skip:])
        known = not whole and (known or len(own) > 0)  # without a sentence's end, a segment is part of one sentence
    if not sums:
        none = np.zeros(0, np.int64)
        return np.zeros(0), none, none, none
    each = _sigmoid(np.concatenate(sums) + model.bias)
    return each, np.zeros(len(each), np.int64), np.concatenate(starts), np.concatenate(ends)


def noisy_or(scores: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    return 0.0 - np.expm1(np.bincount(document, np.log1p(-np.minimum(scores, 1 - 1e-12)), n))


def gradient(theta: np.ndarray, feature: np.ndarray, sentence: np.ndarray, document: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the weighted log-likelihood of document labels under the noisy-or of their sentences, with respect to the weights and the bias (last).
    feature, sentence: of each feature's occurrence; document: of each sentence."""
    p = _sigmoid(np.bincount(sentence, theta[feature], len(document)) + theta[-1])
    clean = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))  # log of the probability that all are clean
    q = np.clip(-np.expm1(clean), 1e-6, 1.0)
    # By a sentence's logit: (y - q) / q * p, for the noisy-or of logistic scores.
    pull = (weight * (y - q) / q)[document] * p
    return np.append(np.bincount(feature, pull[sentence], len(theta) - 1), pull.sum())


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray, settings: Settings = Settings()) -> Model:
    """weight: of each document. Features that hardly tell the classes apart stay at weight zero."""
    model = Model(np.zeros(1 << BUCKET_BITS, np.float32), -np.inf)
    if not 0 < labels.sum() < len(labels):
        return model
    raw = [lowered(t) for t in texts]
    seen = np.zeros((2, 1 << BUCKET_BITS))
    for a, b in slices([len(t) for t in raw]):
        part = bags(raw[a:b])
        doc = part.document[part.sentence]
        pairs = np.unique(doc.astype(np.int64) << BUCKET_BITS | part.bucket)
        for y in (0, 1):
            seen[y] += np.bincount(pairs[labels[a + (pairs >> BUCKET_BITS)] == y] & (1 << BUCKET_BITS) - 1, minlength=1 << BUCKET_BITS)
    positive = int(labels.sum())
    odds = np.log((seen[1] + 0.5) / (positive + 1)) - np.log((seen[0] + 0.5) / (len(labels) - positive + 1))
    kept = np.flatnonzero((seen.sum(axis=0) >= settings.least_df) & (np.abs(odds) >= settings.least_odds))
    number = np.full(1 << BUCKET_BITS, -1, np.int32)
    number[kept] = np.arange(len(kept))
    feature, sentence, document, many = [], [], [], 0
    for a, b in slices([len(t) for t in raw]):
        part = bags(raw[a:b])
        good = number[part.bucket] >= 0
        feature.append(number[part.bucket[good]])
        sentence.append(part.sentence[good] + many)
        document.append(part.document + a)
        many += len(part.document)
    feature, sentence, document = map(np.concatenate, (feature, sentence, document))
    theta, first, second = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    theta[-1] = -6.0
    weight = weight / weight.sum()
    y = labels.astype(float)
    for t in range(1, settings.rounds + 1):
        grad = gradient(theta, feature, sentence, document, y, weight)
        grad[:-1] -= settings.l2 * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta += settings.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    model.weights[kept], model.bias = theta[:-1], float(theta[-1])
    return model


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; of a null key: of an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int, longest: int, key: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most `sample` labelled documents of each class, chosen by a hash of their key among those that have a
    text of at most `longest` bytes; of a key's texts the first by hash."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & learn).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    rows = plain_text(docs, key, text=text).where(F.octet_length("text") <= longest)
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    fit_for = staged(known.join(rows.select(key).hint("merge"), key, "left_semi").withColumn("h", F.xxhash64(key)), "learnable")
    chosen = None
    for r in fit_for.groupBy("y").agg(F.count("*").alias("n")).collect():
        of = fit_for.where(F.col("y") == r["y"])
        # The least hashes: of those below a bound under which lie a few more than wanted, so that tasks hand on few.
        share = 1.2 * sample / r["n"] + 64 / r["n"]
        while share < 0.9:
            least = of.where(F.col("h") < int((2 * share - 1) * 2**63))
            if least.count() >= sample:
                of = least
                break
            share *= 2
        some = of.orderBy("h", key).limit(sample).select(key, "y")
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return [], np.zeros(0, np.int64), np.zeros(0)
    # At most `sample` keys a class: a documented bound.
    got = rows.join(F.broadcast(chosen), key).groupBy(key, "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy("y", F.xxhash64(key), key).collect()
    ys = np.array([r["y"] for r in got], np.int64)
    many = np.bincount(ys, minlength=2)
    return [r["text"] for r in got], ys, np.array([shares[y] / many[y] for y in ys.tolist()])


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """learn: which label rows may be learned from."""
    return fit(*labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, settings.sample, settings.longest, key, text), settings)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, sentence_threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs: key, score, offending: spans (start and end character, score) of the sentences that make a document
    reach the threshold, the worst one always among them."""
    rows = plain_text(docs, key, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts_sizes(texts)):
                raw = [lowered(x) for x in texts.slice(a, b - a).to_pylist()]
                each, document, start, end = sentences(model, raw)
                total = noisy_or(each, document, len(raw))
                found: list[list[dict]] = [[] for _ in raw]
                bounds = np.searchsorted(document, np.arange(len(raw) + 1))
                for d in np.flatnonzero(total >= threshold):
                    own = slice(bounds[d], bounds[d + 1])
                    least = min(sentence_threshold, each[own].max())
                    at = begun = 0
                    for s in np.flatnonzero(each[own] >= least) + bounds[d]:
                        begun += len(raw[d][at : start[s]].decode())
                        at = int(end[s])
                        stop = begun + len(raw[d][start[s] : at].decode())
                        found[d].append({"start": begun, "end": stop, "score": float(each[s])})
                        begun = stop
                yield pa.record_batch({key: batch.column(key).slice(a, b - a), "score": pa.array(total), "offending": pa.array(found, pa.list_(span))})

    return rows.mapInArrow(made, f"`{key}` {dict(rows.dtypes)[key]}, score double, offending array<struct<start:int,end:int,score:double>>")


def select(docs: DataFrame, model: Model, passes: Callable[[np.ndarray], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score passes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(texts: list[str]) -> np.ndarray:
        each, document, _, _ = sentences(shared.value, [lowered(x) for x in texts])
        return passes(noisy_or(each, document, len(texts)))

    return keep_rows(docs, judged, text)
