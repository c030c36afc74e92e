"""Best-fit packing of token pieces into sequences, after Martello and Toth's dominance reduction.

Only lengths matter, and there are at most `capacity` of them: the plan is made on the histogram of piece lengths, which
Spark counts (map-side combined) and which stays at `capacity` rows whatever the corpus. The reduction fixes sequences that
provably belong to some best packing:

* a longest piece that nothing else fits beside stays alone;
* a longest piece goes with the longest one that fits, if that fills the sequence, or if no two other pieces that fit
  together are longer in sum (then the pair dominates every other set with that longest piece).

Both repeat until no rule fires for any length; fixing a pair shrinks the instance, so lengths are looked at again. What remains is packed best-fit, longest
first; as equal lengths are interchangeable, whole runs of equal sequences are handled at once. Each run of a length's ranks
then belongs to a slot (first sequence, offset), and pieces find their slot by their rank within their length. Ranks come
from windows over (length, salt) and counts of those groups; a length has salts in proportion to its pieces, so that no task
gets more than `RANKED` or a small share of all, however frequent a length or key is. Pieces that fill a sequence, which most are in a corpus of long documents, need no rank: the
number of their row names their sequence.

Defined results: null text is an empty text (the end id alone); repeated keys and rows are packed each; a very long text is
encoded whole and cut; an empty table packs to no rows; columns beside key and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain_text, slices, staged, texts_sizes
from .tokens import KEEP, encoder

#: Pieces of one length that are ranked together are about so many at most, and at most such a share of all.
RANKED, SHARES = 250_000, 256


@dataclass
class Run:
    """`count` equal sequences of these lengths."""

    lengths: tuple[int, ...]
    count: int


def _dominated_pair(left: list[int], counts: dict[int, int], long: int, room: int, other: int) -> bool:
    """Whether no two or more pieces of lengths in left that fit in room are longer together than `other`."""
    own = [x for x in left if x <= room - left[0] and (x != long or counts[x] > 1)] if left else []
    if not own or own[0] * 2 > room:
        return True
    reach = 0  # bit s: sum s, of any number of pieces; each length as often as wanted, which can only reach more
    some = 1
    mask = (1 << (room + 1)) - 1
    for x in own:
        step = x
        while step <= room:
            some |= some << step & mask
            step *= 2
    for x in own:
        reach |= (some & ~1) << x & mask
    return reach.bit_length() - 1 <= other


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """The sequences that some best packing has, and the counts of what is left."""
    counts = {k: v for k, v in counts.items() if v}
    left = sorted(counts)
    fixed: list[Run] = []

    def take(*lengths: int) -> None:
        n = min(counts[x] // lengths.count(x) for x in lengths)
        fixed.append(Run(lengths, n))
        for x in lengths:
            counts[x] -= n
        for x in {*lengths}:
            if not counts[x]:
                del counts[x]
                left.remove(x)

    again = True
    while again:
        again = False
        for long in sorted(left, reverse=True):
            while long in counts:
                room = capacity - long
                fits = [x for x in left if x <= room and (x != long or counts[x] > 1)]
                if not fits:
                    take(long)
                elif fits[-1] == room or _dominated_pair(left, counts, long, room, fits[-1]):
                    take(long, fits[-1])
                else:
                    break
                again = True
            if long * 2 < capacity and not again:
                break  # a short piece decides nothing before longer ones have gone
    return fixed, counts


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Run]:
    """Longest first, each into the fullest sequence that has room; runs of equal sequences at once."""
    open_runs: list[tuple[int, tuple[int, ...], int]] = []  # (room, lengths, count), ascending

    for length in sorted(counts, reverse=True):
        n = counts[length]
        at = 0
        while n and at < len(open_runs):
            room, lengths, many = open_runs[at]
            if room < length:
                at += 1
                continue
            # The fullest run with room: all its sequences take one piece, or several while they stay the fullest.
            each = room // length
            whole = min(many, n // each)
            open_runs.pop(at)
            if whole:
                insort(open_runs, (room - each * length, lengths + (length,) * each, whole))
                n -= whole * each
            if many > whole:
                rest = many - whole
                if n and n < each:
                    insort(open_runs, (room - n * length, lengths + (length,) * n, 1))
                    rest, n = rest - 1, 0
                if rest:
                    insort(open_runs, (room, lengths, rest))
            at = 0
        each = capacity // length
        if n // each:
            insort(open_runs, (capacity - each * length, (length,) * each, n // each))
        if n % each:
            insort(open_runs, (capacity - n % each * length, (length,) * (n % each), 1))
    return [Run(lengths, many) for _, lengths, many in open_runs]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


def slots(runs: list[Run]) -> pd.DataFrame:
    """A row for each place in each run: length, first (rank of the first piece there), sequence (of that piece), offset."""
    rows, used, sequence = [], {}, 0
    for run in runs:
        offset = 0
        for length in run.lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + run.count
            offset += length
        sequence += run.count
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).astype("int64").sort_values(["length", "first"], ignore_index=True)


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: the first may be shorter, and only more than capacity is cut."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", keep_ids: bool = True, keep_pieces: int = KEEP) -> DataFrame:
    """Each document's ids with the end id, cut to pieces: key, piece, start, length, ids_crc32, and ids (little-endian 32-bit, if kept)."""
    rows = plain_text(docs, key, text=text)
    kind = dict(rows.dtypes)[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_file, keep_pieces)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts_sizes(texts)):
                take, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
                for row, x in enumerate(texts.slice(a, b - a).to_pylist(), a):
                    ids = np.frombuffer(tokens.encode(x), tokens.dtype).astype("<u4")
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start = 0
                    for piece, n in enumerate(cut(len(ids), capacity)):
                        part = ids[start : start + n].tobytes()
                        for k, v in zip(out, (piece, start, n, zlib.crc32(part), part if keep_ids else None), strict=True):
                            out[k].append(v)
                        take.append(row)
                        start += n
                columns = {key: batch.column(key).take(pa.array(take, pa.int64())), "piece": pa.array(out["piece"], pa.int32())}
                columns |= {k: pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")}
                yield pa.record_batch(columns | ({"ids": pa.array(out["ids"], pa.binary())} if keep_ids else {}))

    return rows.mapInArrow(encode, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces (any columns, among them length), stored once in the shared folder, with sequence_id and offset."""
    columns = pieces.columns
    row, salt, home, group, before = (_free(n, columns) for n in ("row", "salt", "home", "group", "before"))
    rows = staged(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    part = rows.where(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer than capacity rows
    runs = plan(counts, capacity)
    table = slots(runs)
    lengths, firsts = table["length"].to_numpy(), table["first"].to_numpy()
    places = table[["sequence", "offset"]].to_numpy()
    span = int(max(counts.values(), default=0)) + 1
    shared = pieces.sparkSession.sparkContext.broadcast((lengths * span + firsts, places, span))  # bounded by the plan's runs

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, places, span = shared.value
        ranks = rank.to_numpy()
        at = np.searchsorted(starts, length.to_numpy() * span + ranks, side="right") - 1
        first = starts[at] % span
        return pd.DataFrame({"sequence_id": places[at, 0] + ranks - first, "offset": places[at, 1]})

    together = max(1, min(RANKED, sum(counts.values()) // SHARES))
    salts = F.array(*[F.lit(max(1, -(-counts.get(n, 0) // together))) for n in range(capacity)])
    dealt = part.withColumn(salt, F.pmod(F.xxhash64(row), F.get(salts, F.col("length").cast("int"))))
    groups = dealt.groupBy("length", salt).agg(F.count("*").alias("n"))  # a row for each length, and for each of the shares of its pieces
    so_far = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    told = groups.select(F.col("length").alias(home), F.col(salt).alias(group), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias(before))
    ranked = dealt.withColumn(row, F.row_number().over(Window.partitionBy("length", salt).orderBy(row)) - 1)
    met = ranked.join(told, (F.col("length") == F.col(home)) & (F.col(salt) == F.col(group)))
    placed = met.withColumn(home, place("length", F.col(row) + F.col(before))).select(*columns, f"{home}.sequence_id", f"{home}.offset")
    others = sum(r.count for r in runs)  # their sequences are numbered from 0 on
    full = rows.where(F.col("length") >= capacity).select(*columns, (F.col(row) + others).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def _free(name: str, columns: list[str]) -> str:
    """A column's name that isn't taken."""
    name = f"__{name}"
    while name in columns:
        name += "_"
    return name


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", keep_ids: bool = True, keep_pieces: int = KEEP) -> DataFrame:
    """Tokenized pieces with their place: sequence_id, offset. keep_pieces: of the encoder."""
    return pack(token_pieces(docs, tokenizer_file, capacity, end_id, key, text, keep_ids, keep_pieces), capacity)
