"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors are projected on `projections` random directions and sorted along each. Around every query lies a window on
each of these lines; two vectors collide on a line if one lies in the other's window. Vectors of the wanted cosine collide on a
known share of lines, others on far fewer: pairs that collide often enough are candidates, and their cosine is then worked out
in double precision. The window's half-width and the least count follow from the recall wanted at the threshold itself (a
binomial tail); closer pairs are found more surely.

Windows of sorted lines are kept as bitmaps: a bitmap of the first 64 c vectors of a line, for each c, gives any window by two
look-ups (rounded outwards to 64 places, which loses nothing), and bit-sliced counters add the windows of all lines, 64 vectors a
machine word. So pairs are counted, not listed. Equal vectors are one class first. Classes are dealt to blocks of about `BLOCK`;
each pair of blocks is one group, which reports for each class its number of links and one step of a spanning forest, never pairs.
The work is quadratic in the number of classes, at some three nanoseconds a pair; rows moved grow by the number of blocks. (Ranges of one
projection prune no pair of blocks in 64 dimensions: the distance at the threshold, 0.32, spans most of a projection.)

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different
length link with nothing of another length; rows that share an id are one node, whose links add up; null ids form their own
rows with null component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, staged

BLOCK = 8192


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    projections: int = 16
    share: float = 0.95  # of lines on which a pair at the threshold collides
    recall: float = 0.999
    seed: int = 5

    @property
    def half_width(self) -> float:
        """A unit-variance Gaussian line spreads a pair by its distance."""
        lo, hi = 0.0, 10.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if math.erf(mid / math.sqrt(2)) < self.share else (lo, mid)
        return hi * math.sqrt(max(0.0, 2 - 2 * self.threshold))

    @property
    def least(self) -> int:
        """The greatest count that a pair at the threshold reaches with the recall wanted."""
        n, p = self.projections, self.share
        tail = 0.0
        for k in range(n, 0, -1):
            tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if tail >= self.recall:
                return k
        return 0


@lru_cache(maxsize=4)
def directions(dims: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, n))


class Lines:
    """Sorted projections of some vectors, with prefix bitmaps at every 64th place."""

    def __init__(self, points: np.ndarray):
        self.n, self.m = points.shape
        self.words = -(-self.n // 64)
        order = np.argsort(points, axis=0, kind="stable")
        self.sorted = [np.ascontiguousarray(points[order[:, j], j]) for j in range(self.m)]
        self.prefix = []
        for j in range(self.m):
            bits = np.zeros((self.words + 1, self.words), np.uint64)
            np.bitwise_or.at(bits, (np.arange(self.n) // 64 + 1, order[:, j] // 64), np.uint64(1) << (order[:, j] % 64).astype(np.uint64))
            self.prefix.append(np.bitwise_or.accumulate(bits, axis=0))

    def often(self, queries: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) that collide on at least `least` lines."""
        planes: list[np.ndarray] = []
        for j in range(self.m):
            a = np.searchsorted(self.sorted[j], queries[:, j] - half, side="left") // 64
            b = -(-np.searchsorted(self.sorted[j], queries[:, j] + half, side="right") // 64)
            carry = self.prefix[j][b]
            carry &= ~self.prefix[j][np.minimum(a, b)]
            for k, plane in enumerate(planes):
                planes[k], carry = plane ^ carry, plane & carry
            if (j + 1).bit_length() > len(planes):
                planes.append(carry)
        above, equal = np.zeros_like(planes[0]), np.full_like(planes[0], ~np.uint64(0))
        for k in range(len(planes) - 1, -1, -1):
            if least >> k & 1:
                equal &= planes[k]
            else:
                above |= equal & planes[k]
                equal &= ~planes[k]
        good = above | equal
        x, word = np.nonzero(good)
        some = good[x, word]
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        y = word[at] * 64 + bit
        inside = y < self.n
        return x[at][inside], y[inside]


def linked(a: np.ndarray, b: np.ndarray, settings: Settings):
    """Index pairs (of a, of b) with cosine at or above the threshold that collide often enough, in portions."""
    units = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b)]
    turn = directions(a.shape[1], settings.projections, settings.seed)
    half, least = settings.half_width, settings.least
    lines, queries = Lines(units[1] @ turn), units[0] @ turn
    for at in range(0, len(a), 1024):
        x, y = lines.often(queries[at : at + 1024], half, least)
        for k in range(0, len(x), 200_000):
            i, j = x[k : k + 200_000] + at, y[k : k + 200_000]
            near = np.einsum("ij,ij->i", units[0][i], units[1][j]) >= settings.threshold
            yield i[near], j[near]


def near_duplicates(vectors: DataFrame, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each row of vectors: key, n_links, component_id, kept."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    sound = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # A vector with nulls makes exists() null as well as false: only a sure answer counts.
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull())
    classes = staged(rows.where("sound").groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n")), "classes")
    blocks = max(1, -(-classes.count() // BLOCK))
    own = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")
    dealt = classes.select("node", "n", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dims"), own.alias("own"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("dims", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "n", "v")

    def compare(group: pa.Table) -> pa.Table:
        dims, lo, hi = (group.column(c)[0].as_py() for c in ("dims", "lo", "hi"))
        mine, node, n = (group.column(c).to_numpy() for c in ("own", "node", "n"))
        v = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(mine), dims)
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        links = np.zeros(len(mine), np.int64)
        src, dst = [], []
        if len(left) and len(right):
            for i, j in linked(v[left], v[right], settings):
                i, j = left[i], right[j]
                i, j = (i[i != j], j[i != j]) if lo == hi else (i, j)
                links += np.bincount(i, n[j], len(mine)).astype(np.int64)
                if lo != hi:
                    links += np.bincount(j, n[i], len(mine)).astype(np.int64)
                tree = np.array(forest(node[i], node[j]), np.int64).reshape(-1, 2)
                src.append(tree[:, 0])
                dst.append(tree[:, 1])
        joined = forest(np.concatenate([*src, np.empty(0, np.int64)]), np.concatenate([*dst, np.empty(0, np.int64)]))
        seen = np.flatnonzero(links)
        up = dict(joined)
        return pa.table({"node": pa.array(node[seen]), "links": pa.array(links[seen]), "up": pa.array([up.get(x, x) for x in node[seen].tolist()], pa.int64())})

    found = staged(pairs.groupBy("dims", "lo", "hi").applyInArrow(compare, "node long, links long, up long"), "collisions")
    groups = connected_components(found.select(F.col("node").alias("src"), F.col("up").alias("dst")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    # A class's other members are linked with one another too.
    told = classes.join(counts, "node", "left").join(groups, "node", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    out = rows.where("sound").join(staged(told, "told"), "v").select("id", "links", "component").unionByName(rows.where("not sound").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
