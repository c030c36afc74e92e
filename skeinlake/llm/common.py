"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.operators.graph import connected_components
from skeinlake.sources.tables import fresh_path, staged

__all__ = ["connected_components", "forest", "fresh_path", "keep_rows", "plain_text", "slices", "staged", "texts_sizes"]

#: Bytes of text that a Python worker looks at in one go; longer texts come alone.
SLICE_BYTES = 2 << 20


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold at most limit bytes together, or one text."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def texts_sizes(texts: pa.Array) -> list[int]:
    """Bytes of each text; null: 0."""
    return [n or 0 for n in pc.binary_length(texts).to_pylist()]


def plain_text(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Only the key columns and the text (null: empty), so that scans read nothing else."""
    return docs.select(*[F.col(f"`{k}`").alias(k) for k in keys], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def keep_rows(docs: DataFrame, passes: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text (null: empty) passes. Each row is judged by itself in its own place: nothing moves."""
    at = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for a, b in slices(texts_sizes(texts)):
                good = passes([x or "" for x in texts.slice(a, b - a).to_pylist()])
                yield batch.slice(a, b - a).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links a[i]-b[i], those (as member, root) that hold the same groups together: one for each member but its group's least."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x] = top
            x = up
        return top

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root.setdefault(x, x)
        root.setdefault(y, y)
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in root if find(x) != x]
