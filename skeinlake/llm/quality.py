"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` bytes (whole texts; the last may be shorter). Each passage is encoded: how often
each kind of byte follows each other kind, how often a word repeats one of the words before it, and how long words are, through a
learned layer. Gated attention, softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages; the document's probability is
logistic in the weighted passage representation. Encoder, attention and classifier are trained together from document labels
(Adam on the log-likelihood, gradients written out below), so that a document is judged by the passages that tell.

Training takes at most `Settings.sample` labelled documents of each class, by a hash of their key among those of at most
`Settings.longest` bytes, on the driver; classes are weighted to their shares among all labelled rows. Scoring covers every whole
text: longer ones than `SEGMENT` bytes have their passages encoded a segment at a time, with `AROUND` bytes beside it, within
which words and their repeats are seen whole.

Defined results: null and empty texts are one empty passage; equal texts score alike; repeated rows are scored each;
contradictory labels of a key count as 1; of a key's several texts one is learned from; labels or keys that are null are not learned from; with one class or none in the labels every score is that
class, or 0.5; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import Hasher, joined, lookup, words
from .common import keep_rows, plain_text, slices, texts_sizes
from .toxicity import labelled_sample

PASSAGE = 512

_KINDS = [lookup(x) for x in (bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t", b"\n\r", b".", b",", b"!?", b"|", b"*$%#&@~^=+<>_/\\", b"\"'()[]{}-:;`", bytes(range(192, 256)), bytes(range(128, 192)))]
_KIND = np.full(256, len(_KINDS), np.uint8)
for _i, _t in enumerate(_KINDS):
    _KIND[_t] = _i
_N = len(_KINDS) + 1
#: Pairs of kinds, then: words that repeat the last word, one of the last 2 to 4, mean word length, words, passage length.
FEATURES = _N * _N + 5


@dataclass(frozen=True)
class Settings:
    sample: int = 3000
    longest: int = 65_536
    hidden: int = 32
    gates: int = 16
    epochs: int = 30
    batch: int = 256
    rate: float = 0.004
    decay: float = 1e-4
    seed: int = 7


#: Bytes of one text that are encoded at once, and those around them that are looked at: whole passages.
SEGMENT, AROUND = 2 << 20, 64 << 10


def passages(texts: list[bytes], size: int = SEGMENT, around: int = AROUND) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and where each text's passages start (and the end)."""
    if len(texts) == 1 and len(texts[0]) > size:
        text, parts = texts[0], []
        for a in range(0, len(text), size):
            lo = max(0, a - around)
            x, _ = passages([text[lo : a + size + around]], size + 2 * around)
            # What the last passage of a segment's surroundings ends in isn't the text's end: only whole ones count.
            parts.append(x[(a - lo) // PASSAGE :][: -(-(min(len(text), a + size) - a) // PASSAGE)])
        x = np.concatenate(parts)
        return x, np.array([0, len(x)])
    buf, at = joined(texts)
    sizes = np.diff(at) - 1
    each = np.maximum(1, -(-sizes // PASSAGE))
    first = np.append(0, np.cumsum(each))
    n = int(first[-1])
    lengths = np.full(n, PASSAGE, np.int64)
    lengths[first[1:] - 1] = sizes - (each - 1) * PASSAGE + 1  # with the newline behind the text
    of = np.repeat(np.arange(n, dtype=np.int32), lengths)
    # Each byte with the one before; before a text stands a newline.
    kind = _KIND[np.append(np.uint8(10), buf)]
    code = of * np.int32(_N * _N)
    code += kind[:-1].astype(np.int32) * _N + kind[1:]
    pairs = np.bincount(code, minlength=n * _N * _N).reshape(n, -1)
    starts, ends = words(buf)
    hashed = Hasher(buf).spans(starts, ends)
    home = of[starts]
    many = np.bincount(home, minlength=n)
    far = np.maximum(1, many)
    text_of = np.repeat(np.arange(len(texts)), each)[home]
    again = lambda k: (hashed[k:] == hashed[:-k]) & (text_of[k:] == text_of[:-k])
    last, near = np.zeros(len(hashed), bool), np.zeros(len(hashed), bool)
    last[1:] = again(1)
    for k in (2, 3, 4):
        near[k:] |= again(k)
    out = np.empty((n, FEATURES), np.float32)
    out[:, : _N * _N] = pairs / np.maximum(1, lengths)[:, None]
    out[:, -5] = np.bincount(home, last, n) / far
    out[:, -4] = np.bincount(home, near, n) / far
    out[:, -3] = np.bincount(home, ends - starts, n) / far / 10
    out[:, -2] = many / 100
    out[:, -1] = np.maximum(0, lengths - 1) / PASSAGE
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """mean, scale: of the features; the rest: parameters by name. constant: the score of all, if nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    constant: float | None = None

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised features; the attention of passages and the scores of documents, with what lies between."""
        w = self.w
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * g) @ w["a"]
        starts, sizes = first[:-1], np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"][0])}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted negative log-likelihood."""
        w, f, sizes = self.w, self.forward(x, first), np.diff(first)
        err = weight * (f["p"] - y)
        dz = np.repeat(err[:, None] * w["c"], sizes, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), sizes))
        dt = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dz * f["a"][:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ err, "d": np.array([err.sum()])}


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray, settings: Settings = Settings()) -> Model:
    """weight: of each document."""
    if not 0 < labels.sum() < len(labels):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(labels.mean()) if len(labels) else 0.5)
    raw = [t.encode() for t in texts]
    parts, sizes = [], []
    for a, b in slices([len(t) for t in raw]):
        x, first = passages(raw[a:b])
        parts.append(x)
        sizes.append(np.diff(first))
    x, first = np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))
    rng = np.random.default_rng(settings.seed)
    k, g = settings.hidden, settings.gates
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, {"W": draw(FEATURES, k), "b": np.zeros(k, np.float32), "V": draw(k, g), "U": draw(k, g), "a": draw(g), "c": draw(k), "d": np.zeros(1, np.float32)})
    x = model.standard(x)
    weight = weight / weight.mean()
    first_m, second_m = ({n: np.zeros_like(v) for n, v in model.w.items()} for _ in range(2))
    steps = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), settings.batch):
            docs = order[at : at + settings.batch]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            own = np.append(0, np.cumsum(first[docs + 1] - first[docs]))
            steps += 1
            for n, grad in model.gradient(x[rows], own, labels[docs], weight[docs] / len(docs)).items():
                grad = grad + settings.decay * model.w[n]
                first_m[n] = 0.9 * first_m[n] + 0.1 * grad
                second_m[n] = 0.999 * second_m[n] + 0.001 * grad**2
                model.w[n] = model.w[n] - settings.rate * (first_m[n] / (1 - 0.9**steps)) / (np.sqrt(second_m[n] / (1 - 0.999**steps)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """learn: which label rows may be learned from."""
    return fit(*labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, settings.sample, settings.longest, key, text), settings)


def scores(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its score and the start byte of the passage that weighs most."""
    if model.constant is not None:
        return np.full(len(texts), model.constant), np.zeros(len(texts), np.int64)
    x, first = passages(texts)
    f = model.forward(model.standard(x), first)
    best = np.array([np.argmax(f["a"][a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
    return f["p"].astype(float), best * PASSAGE


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs: key, score, telling_byte (where the passage of most attention starts in the text's UTF-8)."""
    rows = plain_text(docs, key, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts_sizes(texts)):
                p, at = scores(shared.value, [x.encode() for x in texts.slice(a, b - a).to_pylist()])
                yield pa.record_batch({key: batch.column(key).slice(a, b - a), "score": pa.array(p), "telling_byte": pa.array(at)})

    return rows.mapInArrow(made, f"`{key}` {dict(rows.dtypes)[key]}, score double, telling_byte long")


def select(docs: DataFrame, model: Model, passes: Callable[[np.ndarray], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score passes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda texts: passes(scores(shared.value, [x.encode() for x in texts])[0]), text)
