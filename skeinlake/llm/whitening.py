"""Whitening of embeddings by a randomised range finder.

Vectors become integers, whose sums and squared deviations are exact. A random basis with oversampling is multiplied by the
covariance of all centred rows in repeated power passes, made orthonormal between them; each pass yields the Rayleigh-Ritz
components of the basis and their residuals. Where a residual isn't down to rounding after a few passes, the basis is widened, up to the full dimension, at which one
pass is exact. The components' whitening is then checked by one more pass over all rows.

A pass sums one matrix of (dimension x basis) in each task and adds up its cells by a shuffle; the driver sees that matrix alone.

Defined results: vectors that are null, empty, or hold null or non-finite entries are left out, and so are those of another length than
most vectors have (on a tie: than the longest); repeated rows and ids are rows each; equal vectors have equal results; components whose eigenvalue can't be
told from zero (fewer distinct vectors than dimensions, constant dimensions) can't be scaled to variance 1 and are left out, so that vectors
that are all equal give no rows; ties between eigenvalues leave any basis of their space; a deviation beyond 64 bits is null; an empty table gives no rows;
columns beside key and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the integer form: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Vectors of the basis beside the components asked for, passes before it is widened, and the residual, as a share of the greatest eigenvalue, that is rounding.
OVER, PASSES, RESIDUAL = 10, 4, 1e-13


@dataclass(frozen=True)
class Fit:
    """n vectors of integer sums; a column of `components` and an entry of `values` for each component; trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, v (doubles): the vectors that whitening takes."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").alias(key), v.alias("v"))
    good = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    usual = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1)
    found = usual.collect()  # one row
    return good.where(F.size("v") == (found[0]["d"] if found else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors as integers in double precision. Entries too large for those are as exact as doubles are."""
    lists = batch.column("v")
    return np.floor(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) * SCALE) + SHIFT


def fit(rows: DataFrame, k: int = 32, seed: int = 0) -> Fit | None:
    """Of usable rows; None without any, or if all are equal."""
    n, sums = _sums(rows)
    if not n:
        return None
    mean, d = np.array([s / n for s in sums]), len(sums)
    width = min(d, k + OVER)
    rng = np.random.default_rng(seed)
    basis = _orthonormal(rng.standard_normal((d, width)))
    passes = 0
    while True:
        if width == d:
            basis = np.eye(d)
        product, trace = _pass(rows, mean, basis)
        product, trace, passes = product / n, trace / n, passes + 1
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        components = basis @ turn
        off = np.linalg.norm(product @ turn - components * values, axis=0)[:k]
        if width == d or (off <= RESIDUAL * values[0]).all():
            break
        if passes == PASSES:
            width, passes = min(d, 2 * width), 0
            product = np.hstack([product, rng.standard_normal((d, width - product.shape[1]))])
        basis = _orthonormal(product)
    kept = int((values[:k] > max(values[0], 0) * d * 1e-15 * 64).sum())
    if not kept or values[0] <= 0:
        return None
    components, values = components[:, :kept], values[:kept]
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(kept)])
    whitened = components / np.sqrt(values)
    spread, _ = _pass(rows, mean, whitened, whitened)
    return Fit(n, sums, components, values, trace, float(np.abs(spread / n - np.eye(kept)).max()))


def _orthonormal(m: np.ndarray) -> np.ndarray:
    return np.linalg.qr(m)[0]


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors, and the exact sum of each dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                exact = x.astype(np.int64).sum(axis=0) if np.abs(x).max() < 2**40 else [sum(map(int, c)) for c in x.T]
                yield pa.record_batch({"i": pa.array(range(x.shape[1]), pa.int32()), "s": pa.array(map(str, map(int, exact)), pa.string()), "n": pa.array([len(x)] * x.shape[1], pa.int64())})

    parts = rows.mapInArrow(summed, "i int, s string, n long")
    got = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()  # a row for each dimension
    got.sort(key=lambda r: r["i"])
    return (got[0]["n"] if got else 0), [int(r["s"]) for r in got]


def _pass(rows: DataFrame, mean: np.ndarray, right: np.ndarray, left: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The sum over all rows of (x left)' (x right), where x is centred (left: none), and of x'x. Cells are added up by a shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, right, left))  # dimension x basis
    shape = (len(mean) if left is None else left.shape[1], right.shape[1])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, right, left = shared.value
        total, squares, some = np.zeros(shape), 0.0, False
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch) - mean
                total += (x if left is None else x @ left).T @ (x @ right)
                squares, some = squares + float(np.einsum("ij,ij->", x, x)), True
        if some:
            cells = np.append(total.ravel(), squares)
            yield pa.record_batch({"cell": pa.array(np.arange(len(cells), dtype=np.int32)), "part": pa.array(cells)})

    got = rows.mapInArrow(summed, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part")).toPandas()  # one matrix
    cells = np.zeros(shape[0] * shape[1] + 1)
    cells[got["cell"].to_numpy()] = got["part"].to_numpy()
    shared.unpersist()
    return cells[:-1].reshape(shape), float(cells[-1])


def project(rows: DataFrame, own: Fit, key: str = "vec_id") -> DataFrame:
    """key, deviation, whitened (an array, a value for each component) of each usable row."""
    shared = rows.sparkSession.sparkContext.broadcast(own)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        mean, scaled = np.array([s / f.n for s in f.sums]), f.components / np.sqrt(f.values)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                w = (x - mean) @ scaled
                lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch({key: batch.column(key), "deviation": pa.array(_deviations(x, f.n, f.sums), pa.int64()), "whitened": lists})

    return rows.mapInArrow(made, f"`{key}` {dict(rows.dtypes)[key]}, deviation long, whitened array<double>")


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n x - S)^2 of each row, exactly; None beyond 64 bits."""
    bound = np.abs(x - np.array([s / n for s in sums])).max() + 1
    if (float(n) * bound) ** 2 * x.shape[1] < 2**62 and float(n) * np.abs(x).max() < 2**62:
        gap = n * x.astype(np.int64) - np.array(sums, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 2**63 else None for v in exact]


def whitened(vectors: DataFrame, k: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    rows = usable(vectors, key, vector)
    own = fit(rows, k)
    if own is None:
        own = Fit(0, [], np.zeros((0, 0)), np.zeros(0), 1.0)
        rows = rows.limit(0)
    shares = F.array(*[F.lit(float(v / own.trace)) for v in own.values]) if len(own.values) else F.array().cast("array<double>")
    each = project(rows, own, key).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(key, (F.col("at") + 1).alias("component"), F.lit(own.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(own.identity_error).alias("identity_error"))
