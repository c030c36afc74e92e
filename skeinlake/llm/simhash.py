"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint is the bitwise majority of the XXH64 values (seed 42) of its three-word shingles. Two fingerprints
that differ in at most 3 of 64 bits differ in at most one bit of one of their two halves. So each distinct fingerprint is
indexed under its halves with one bit blanked out, 2 x 32 signatures; fingerprints under the same signature are compared,
and those within 3 bits are linked. Equal halves meet under all 32 signatures and are compared under the first alone.

Copies never multiply: documents with one fingerprint are one row of the index. A signature of more than `BLOCK` fingerprints
gets a group for each pair of its blocks, so that no group holds more than about two blocks.
Each group reports a spanning forest of its links, never all pairs, and components come from the forests.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other; fewer than three words are
one shingle; a very long text is read in portions, whole; repeated rows and keys are one node each; an empty table gives no rows; columns beside key and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, plain_text, slices, staged, texts_sizes

BITS, HALF, DISTANCE, SEED = 64, 32, 3, 42
_GAP = re.compile(rb"[\x20\x09-\x0d]")
#: Fingerprints compared with one another in one go.
BLOCK = 4096


#: Bytes of one text whose words are held at once.
PORTION = 4 << 20


def portions(text: bytes, most: int = PORTION) -> Iterator[bytes]:
    """The text in parts that end before white space."""
    at = 0
    while len(text) - at > most:
        gap = _GAP.search(text, at + most)
        stop = gap.start() if gap else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:]


def fingerprint(text: bytes, size: int = 3, most: int = PORTION) -> int:
    """Of UTF-8. bytes.split() cuts at exactly the blank and the bytes 9 to 13, bytes.lower() changes A-Z alone."""
    total, many = np.zeros(BITS, np.int64), 0
    digest = xxhash.xxh64_intdigest
    words: list[bytes] = []  # the last ones before a portion, which begin shingles that end in it
    for part in portions(text, most):
        words += part.lower().split()
        n = len(words) - size + 1
        if n < 1:
            continue
        ends = list(accumulate([len(w) + 1 for w in words]))
        joined = b" ".join(words)
        hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :], strict=False)), np.uint64, n)
        total += _votes(hashes)
        many += n
        words = words[len(words) - size + 1 :]
    if not many and words:
        many, total = 1, _votes(np.array([digest(b" ".join(words), SEED)], np.uint64))
    return int(np.packbits(total * 2 > many, bitorder="little").view(np.uint64)[0])


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """key, fp: the fingerprint's bits as a long; with digests also __digest, that of the text."""
    rows = plain_text(docs, key, text=text)
    rows = rows.withColumn("__digest", _digest("text")) if digests else rows
    names = [key, "__digest"] if digests else [key]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = [fingerprint(x.encode()) for a, b in slices(texts_sizes(texts)) for x in texts.slice(a, b - a).to_pylist()]
            yield pa.record_batch({n: batch.column(n) for n in names} | {"fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    return rows.mapInArrow(made, ", ".join(f"`{n}` {dict(rows.dtypes)[n]}" for n in names) + ", fp long")


def _digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)


def signatures(distinct: DataFrame) -> DataFrame:
    """fp under each of its one-wildcard signatures: sig (half, place of the blank and the half's other bits in one long), fp."""
    half = F.col("half")
    bits = F.when(half == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", HALF))
    blank = F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("blank")
    both = distinct.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).select("fp", "half", bits.alias("bits")).select("fp", "half", "bits", blank)
    kept = F.expr("bits & ~shiftleft(1L, blank)")
    return both.select(kept.bitwiseOR(F.expr("shiftleft(cast(half * 32 + blank as bigint), 32)")).alias("sig"), "fp")


def _close(a: np.ndarray, b: np.ndarray, first: bool, shift: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints within DISTANCE; unless first, those with equal halves (met elsewhere) stay out."""
    for at in range(0, len(a), 256):
        differ = a[at : at + 256, None] ^ b[None, :]
        near = np.bitwise_count(differ) <= DISTANCE
        if not first:
            near &= (differ >> shift) & np.uint64(0xFFFFFFFF) != 0
        x, y = np.nonzero(near)
        yield a[at + x], b[y]


def links(distinct: DataFrame) -> DataFrame:
    """A spanning forest for each group of fingerprints under one signature: src, dst.

    One shuffle brings each signature's fingerprints together, sorted; groups pass through in a stream. A group of more than
    BLOCK isn't compared there: its rows are passed on, and dealt to a group for each pair of the signature's blocks.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, fp, over = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            new_sig, new_fp = batch.column("sig").to_numpy(), batch.column("fp").to_numpy()
            if over is not None and (more := int(np.searchsorted(new_sig, over, side="right"))):
                yield _rows(new_fp[:more], None, new_sig[:more])
                new_sig, new_fp = new_sig[more:], new_fp[more:]
            if not len(new_sig):
                continue
            sig, fp = np.concatenate([sig, new_sig]), np.concatenate([fp, new_fp])
            last = int(np.searchsorted(sig, sig[-1]))
            yield from _groups(sig[:last], fp[:last])
            sig, fp, over = sig[last:], fp[last:], None
            if len(sig) > BLOCK:
                yield _rows(fp, None, sig)
                sig, fp, over = sig[:0], fp[:0], sig[-1]
        yield from _groups(sig, fp)

    sorted_index = signatures(distinct).repartition("sig").sortWithinPartitions("sig")
    found = staged(sorted_index.mapInArrow(compare, "src long, dst long, sig long"), "links")
    near, large = found.where("sig is null").select("src", "dst"), found.where("sig is not null").select("sig", F.col("src").alias("fp"))
    return near if large.isEmpty() else near.unionByName(_large(large))


def _large(rows: DataFrame) -> DataFrame:
    """Links within signatures of many fingerprints, by pairs of blocks."""
    sizes = rows.groupBy("sig").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, "sig").select("sig", "fp", "blocks", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")

    def compare(group: pa.Table) -> pa.Table:
        sig, lo, hi = (group.column(c)[0].as_py() for c in ("sig", "lo", "hi"))
        own, fp = group.column("own").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
        tree = _tree(fp[own == lo], fp[own == hi], sig)
        return pa.table({"src": pa.array(tree[:, 0]), "dst": pa.array(tree[:, 1])})

    return pairs.groupBy("sig", "lo", "hi").applyInArrow(compare, "src long, dst long")


def _rows(src: np.ndarray, dst: np.ndarray | None, sig: np.ndarray | None) -> pa.RecordBatch:
    nothing = pa.nulls(len(src), pa.int64())
    return pa.record_batch({"src": pa.array(src), "dst": nothing if dst is None else pa.array(dst), "sig": nothing if sig is None else pa.array(sig)})


def _place(sig):
    """The blanked bit, 0 to 63 over both halves, and the shift to its half."""
    place = (sig >> HALF) & 63
    return place % HALF == 0, np.where(place < HALF, 0, HALF).astype(np.uint64)


def _tree(left: np.ndarray, right: np.ndarray, sig: int) -> np.ndarray:
    """A spanning forest of the links between two sets of fingerprints under one signature."""
    first, shift = _place(np.int64(sig))
    found = list(_close(left, right, bool(first), shift)) if len(left) and len(right) else []
    x, y = (np.concatenate([*(f[k] for f in found), np.empty(0, np.uint64)]) for k in (0, 1))
    apart = x != y
    return np.array(forest(x[apart].view(np.int64), y[apart].view(np.int64)), np.int64).reshape(-1, 2)


def _groups(sig: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of whole groups, those of two all at once; groups of more than BLOCK are passed on."""
    if not len(sig):
        return
    cuts = np.flatnonzero(sig[1:] != sig[:-1]) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, len(sig))
    bits = fp.view(np.uint64)
    two = starts[ends - starts == 2]
    differ = bits[two] ^ bits[two + 1]
    first, shift = _place(sig[two])
    near = (np.bitwise_count(differ) <= DISTANCE) & (first | ((differ >> shift) & np.uint64(0xFFFFFFFF) != 0))
    yield _rows(fp[two][near], fp[two + 1][near], None)
    many = ends - starts > 2
    for a, b in zip(starts[many], ends[many], strict=True):
        if b - a > BLOCK:
            yield _rows(fp[a:b], None, sig[a:b])
        elif len(tree := _tree(bits[a:b], bits[a:b], sig[a])):
            yield _rows(tree[:, 0], tree[:, 1], None)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored tables: each row's key and fp (with digests also __digest); each fp's component_id (the least key reachable over links) and least key."""
    prints = staged(fingerprints(docs, key, text, digests), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    groups = connected_components(links(distinct.select("fp")))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints, staged(named.join(smallest, "component").select("fp", "least", "component_id"), "components")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs: key, fingerprint (16 hex digits), component_id."""
    prints, of = classes(docs, key, text)
    return prints.join(of, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near-duplicates one row of docs, all columns: of the rows with its least key the one whose text has the least digest; of
    rows that repeat key and text, one. Texts that share a key are judged each by its own group. Rows without a key are
    kept: they have no name to be a duplicate under."""
    prints, of = classes(docs, key, text, digests=True)
    named = prints.where(F.col(key).isNotNull()).join(of.select("fp", "component_id"), "fp")
    chosen = named.groupBy("component_id").agg(F.min(F.struct(key, "__digest")).alias("first")).select("first.*")
    kept = docs.where(F.col(key).isNotNull()).withColumn("__digest", _digest(text)).join(chosen, [key, "__digest"], "left_semi").dropDuplicates([key, "__digest"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
