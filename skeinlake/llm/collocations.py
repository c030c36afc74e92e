"""Phrase collocations of each language by suffixes (Suffix-sigma).

Every word of a piece of text begins a suffix of up to `most` words. Suffixes, equal ones of a slice of text as one row with
their count, are shuffled once by language and first word, sorted there in reverse lexicographical order, and all their prefixes
are counted in one pass over a stack of open prefixes: a prefix of k words closes where the next suffix differs in its first k words.

No first word is a hot group: what a task gets is a range of the suffixes' order, between bounds drawn from a sample of the
documents, so that a frequent word, or pair of words, is cut into as many ranges as it fills. The sample decides about balance alone: prefixes
that such a bound may cut are reported by either side, whatever their count, and added up. Suffixes travel packed, some kilobytes of one
first word a row. A task holds the rows of one word of one range at a time.

The parts of a phrase are joined afterwards: counts of all frequent phrases are one table, which candidates meet under their first and
their last words. Phrases that a longer one accounts for are found from the longer ones' side.

Defined results: null texts are empty, a null language is ``und``; repeated rows and ids count each; very long texts are read in
portions, whole, and so are very long words; ties are ranked by the phrase's UTF-8 bytes; an empty table, or one without a
phrase that is frequent enough, gives no rows; columns beside text and language are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import lookup, runs, spelled
from .common import slices, staged, texts_sizes

#: Words of a suffix, and so of the longest phrase.
MOST = 4
#: Bytes of text counted at once in the first pass, of packed suffixes in the second, of a row of packed suffixes, and of a bound.
PORTION, HELD, ROOM, BOUND = 2 << 20, 6 << 20, 8 << 10, 256
#: Documents and suffixes of each from which bounds between ranges are drawn; bytes of suffixes of a range, and ranges at most (beyond, they grow).
SAMPLE, EACH, RANGE, RANGES = 20_000, 8, 24 << 20, 20_000

_SEPARATOR, _BLANK = lookup(b".,;:!?\n\x0b\x0c\r"), lookup(b" \t")
_INSIDE = ~(_SEPARATOR | _BLANK)
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")
_AHEAD, _SUFFIX = (re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n-\r]+){0,%d}" % n) for n in (MOST - 1, MOST))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, absorbed: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language among those of 2 to `MOST` words that occur
    `least` times or more. score: 2,000,000 * a / (l + r), rounded down, of the cut into a first part (l) and a rest (r) for which it is
    least. Phrases go that lie in a longer one with at least `absorbed` percent of their count."""
    f = staged(phrase_counts(docs, least, text, lang), "phrases")
    n = f.where("size = 0").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    candidates = f.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "w")
    parts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    known = f.where("size > 0")
    met = parts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    met = met.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = F.expr("cast((2000000BD * cast(a AS decimal(20, 0))) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0))) AS bigint)")
    scored = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.score", "s.l", "s.r")

    longer = candidates.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    longer = longer.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    within = longer.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    own = scored.join(within, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * absorbed))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = own.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrase_counts(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, size (words), f: all phrases of 1 to `MOST` words that occur `least` times or more, and all words of a language
    under the empty phrase (size 0)."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    bounds, parts = _bounds(rows)
    shared = docs.sparkSession.sparkContext.broadcast(bounds)  # at most RANGES short strings
    packed = rows.mapInArrow(lambda batches: _suffixes(batches, shared.value), "part int, lang binary, word binary, rest binary, counts binary")
    dealt = packed.repartitionById(parts, "part").sortWithinPartitions("part", F.desc("lang"), F.desc("word"))
    counted = dealt.mapInArrow(lambda batches: _prefixes(batches, least), "lang string, phrase string, size int, f long")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))


def _chunks(texts: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """The texts, lower-cased (A-Z), in chunks that end in a separator, and how many bytes of each are its own: behind them the words that suffixes of
    its last words go on with."""
    if len(texts) > 1:
        yield (both := b"\n".join(texts).lower() + b"\n"), len(both)
        return
    data, at = texts[0].lower(), 0
    while len(data) - at > PORTION:
        gap = _GAP.search(data, at + PORTION)
        stop = gap.start() if gap else len(data)
        yield data[at : _AHEAD.match(data, stop).end()] + b"\n", stop - at
        at = stop
    yield data[at:] + b"\n", len(data) - at + 1


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int]]:
    """lang, chunk and the bytes of it that are its own."""
    langs, texts = batch.column("lang").dictionary_encode(), batch.column("text")
    for i, name in enumerate(langs.dictionary.to_pylist()):
        own = texts.filter(pc.equal(langs.indices, i))
        for a, b in slices(texts_sizes(own), PORTION):
            for chunk, mine in _chunks(own.slice(a, b - a).cast(pa.binary()).to_pylist()):
                yield name.encode(), chunk, mine


def _words(chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's bytes; start, end and piece of each word."""
    buf = np.frombuffer(chunk, np.uint8)
    starts, ends = runs(_INSIDE[buf])
    return buf, starts, ends, np.cumsum(_SEPARATOR[buf], dtype=np.int32)[starts]


def _bounds(rows: DataFrame) -> tuple[list[tuple[bytes, bytes]], int]:
    """Bounds between ranges of (lang, suffix as bytes, a blank behind each word), ascending, and the number of ranges."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            found: list[tuple[bytes, bytes, int, int]] = []
            for lang, text in zip(langs, batch.column("text").cast(pa.binary()), strict=True):
                data = text.as_py()
                for i in range(EACH):  # places spread evenly, from a gap on
                    gap = _GAP.search(data, at) if (at := len(data) * i // EACH) else None
                    at = gap.end() if gap else 0
                    words = _SUFFIX.match(data[at : at + 4 * BOUND]).group().lower().split()
                    found.append((lang.encode(), b"".join(w + b" " for w in words)[:BOUND], max(len(data) // EACH, 1), len(data) if i == 0 else 0))
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["lang", "at", "weight", "bytes"])

    got = rows.sample(share, seed=13).mapInArrow(draw, "lang binary, at binary, weight long, bytes long").collect()  # of some SAMPLE documents, EACH
    total = sum(r["bytes"] for r in got) / share
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(RANGES, int(MOST * total / RANGE)))
    places = sorted((bytes(r["lang"]), bytes(r["at"]), r["weight"]) for r in got)
    if not places:
        return [], parts
    weights = np.cumsum([w for _, _, w in places])
    cut = np.searchsorted(weights, weights[-1] * np.arange(1, parts) / parts)
    return sorted({places[i][:2] for i in cut}), parts


def _suffixes(batches: Iterator[pa.RecordBatch], bounds: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of packed suffixes of one first word and range: each suffix's other words, a blank behind each, a line end behind the suffix; their
    counts as 32-bit integers."""
    of_lang = {lang: [at for _, at in group] for lang, group in groupby(bounds, lambda b: b[0])}
    for batch in batches:
        for lang, chunk, mine in _by_lang(batch):
            buf, starts, ends, piece = _words(chunk)
            own = int(np.searchsorted(starts, mine))
            if not own:
                continue
            ids, spelling = spelled(buf, starts, ends)
            blanked = pc.binary_join_element_wise(spelling, pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
            order = pc.array_sort_indices(blanked).to_numpy()
            rank = np.empty(len(order), np.uint64)
            rank[order] = np.arange(1, len(order) + 1)
            vocabulary = pa.concat_arrays([pa.array([b""], pa.large_binary()), blanked.take(pa.array(order))])
            rows, counts = _tallied(rank[ids], piece, own)
            part = np.full(len(counts), bisect_left(bounds, (lang, b"")), np.int32)
            for at in of_lang.get(lang, ()):
                part[_first_from(rows, vocabulary, at) :] += 1
            yield _packed(rows, counts, part, lang, vocabulary)


def _tallied(w: np.ndarray, piece: np.ndarray, own: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the first, second, ... word of each distinct suffix (0: none), sorted, and how often each occurs."""
    columns = [w[:own]]
    for k in range(1, MOST):
        behind = np.zeros(own, np.uint64)
        there = w[k : own + k]
        behind[: len(there)] = np.where(piece[k : own + k] == piece[: len(there)], there, np.uint64(0))
        columns.append(behind)
    bits = int(w.max()).bit_length()
    if bits * MOST <= 64:
        key = columns[0].copy()
        for c in columns[1:]:
            key = (key << np.uint64(bits)) | c
        key, counts = np.unique(key, return_counts=True)
        mask = np.uint64((1 << bits) - 1)
        return [(key >> np.uint64(bits * (MOST - 1 - k))) & mask for k in range(MOST)], counts
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(own, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    heads = np.flatnonzero(new)
    return [c[heads] for c in columns], np.diff(heads, append=own)


def _first_from(rows: list[np.ndarray], vocabulary: pa.Array, bound: bytes) -> int:
    """The first of the sorted suffixes that isn't before the bound."""
    lo, hi = 0, len(rows[0])
    for column, word in zip(rows, re.findall(rb"[^ ]* |[^ ]+$", bound), strict=False):
        a, z = 0, len(vocabulary)
        while a < z:  # the vocabulary is sorted behind its first entry, which is empty
            m = (a + z) // 2
            a, z = (m + 1, z) if vocabulary[m].as_py() < word else (a, m)
        if a == len(vocabulary) or vocabulary[a].as_py() != word:
            return lo + int(np.searchsorted(column[lo:hi], a))
        lo, hi = lo + int(np.searchsorted(column[lo:hi], a)), lo + int(np.searchsorted(column[lo:hi], a, side="right"))
    return lo


def _packed(rows: list[np.ndarray], counts: np.ndarray, part: np.ndarray, lang: bytes, vocabulary: pa.Array) -> pa.RecordBatch:
    taken = [vocabulary.take(pa.array(c)) for c in rows[1:]]
    rest = pc.binary_join_element_wise(*taken, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    ends = np.frombuffer(rest.buffers()[1], np.int64)[: len(rest) + 1]
    new = np.ones(len(counts), bool)
    new[1:] = (rows[0][1:] != rows[0][:-1]) | (part[1:] != part[:-1]) | (ends[1:-1] // ROOM != ends[:-2] // ROOM)
    heads = np.flatnonzero(new)
    cuts = np.append(heads, len(counts))
    blobs = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(ends[cuts]), rest.buffers()[2]])
    tallies = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(4 * cuts), pa.py_buffer(counts.astype("<u4"))])
    columns = {"part": pa.array(part[heads]), "lang": pa.array([lang] * len(heads), pa.binary()), "word": vocabulary.take(pa.array(rows[0][heads])).cast(pa.binary()), "rest": blobs.cast(pa.binary()), "counts": tallies.cast(pa.binary())}
    return pa.record_batch(columns)


def _prefixes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts of prefixes; rows come sorted by (part, lang descending, word descending)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in _portions(batches):
        held.append(batch)
        size += batch.column("rest").nbytes
        if size >= HELD:
            table = pa.Table.from_batches(held)
            last = _start_of_last(table)
            if last:
                yield from _closed(table.slice(0, last), least)
            held = table.slice(last).to_batches()
            size = sum(b.column("rest").nbytes for b in held) if last else 0  # a word that fills it all: look again once as much has come
    if held:
        yield from _closed(pa.Table.from_batches(held), least)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in slices of `HELD` bytes: a batch has a fixed number of rows, of up to some kilobytes each."""
    for batch in batches:
        for a, b in slices(np.asarray(pc.binary_length(batch.column("rest"))), HELD):
            yield batch.slice(a, b - a)


def _keys(table: pa.Table) -> list[np.ndarray]:
    coded = [table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "word")]
    return [table.column("part").to_numpy(), *coded]


def _start_of_last(table: pa.Table) -> int:
    """Where the rows of the last (part, lang, word) begin."""
    other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in _keys(table)]))
    return int(other[-1]) + 1 if len(other) else 0


def _closed(table: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    part, lang, word = _keys(table)
    group = np.zeros(len(part), np.int64)
    group[1:] = np.cumsum((part[1:] != part[:-1]) | (lang[1:] != lang[:-1]) | (word[1:] != word[:-1]))
    firsts = np.flatnonzero(np.diff(group, prepend=-1))  # a row of each group
    rest, tallies = (table.column(c).combine_chunks() for c in ("rest", "counts"))
    counts = np.frombuffer(b"".join(tallies.to_pylist()), "<u4").astype(np.int64)
    of = np.repeat(group, np.asarray(pc.binary_length(tallies)) // 4)

    data = np.frombuffer(b"".join(rest.to_pylist()), np.uint8)
    stops = np.flatnonzero((data == 32) | (data == 10)) + 1
    tokens = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(np.concatenate([[0], stops])), pa.py_buffer(data)]).dictionary_encode()
    down = pc.array_sort_indices(tokens.dictionary, order="descending").to_numpy()
    place = np.empty(len(down), np.int64)
    place[down] = np.arange(len(down))
    ids = place[tokens.indices.to_numpy()]
    none = len(down)  # behind all words: a shorter suffix follows those that go on
    ended = np.flatnonzero(data[stops - 1] == 10)
    begun = np.append(0, ended[:-1] + 1)
    columns = [of]
    for k in range(MOST - 1):
        there = begun + k < ended
        columns.append(np.where(there, ids[np.minimum(begun + k, len(ids) - 1)], none))
    width = none.bit_length()
    if width * (MOST - 1) + int(group[-1]).bit_length() <= 63:
        key = columns[0]
        for c in columns[1:]:
            key = (key << width) | c
        order = np.argsort(key)
    else:
        order = np.lexsort(columns[::-1])
    columns, counts = [c[order] for c in columns], counts[order]

    words = tokens.dictionary.take(pa.array(down))
    names = table.column("word").combine_chunks().take(pa.array(firsts)).cast(pa.large_binary())
    langs = table.column("lang").combine_chunks().take(pa.array(firsts))
    part = part[firsts]
    edge = np.zeros(len(counts), bool)  # rows at an edge of a range: what they begin with may go on beyond it
    turn = np.flatnonzero(np.diff(part[columns[0]])) + 1
    edge[np.concatenate([[0], turn, turn - 1, [len(counts) - 1]])] = True

    total = np.zeros(int(group[-1]) + 1, np.int64)
    np.add.at(total, columns[0], counts)
    tongue = langs.dictionary_encode()
    sums = np.bincount(tongue.indices.to_numpy(), total).astype(np.int64)  # below 2^53 in one task
    yield _found(tongue.dictionary, pa.array([""] * len(sums)), 0, sums)
    new = np.zeros(len(counts), bool)
    new[0] = True
    for k, column in enumerate(columns):
        new[1:] |= column[1:] != column[:-1]
        heads = np.flatnonzero(new)
        f = np.add.reduceat(counts, heads)
        cut = np.logical_or.reduceat(edge, heads)
        kept = ((f >= least) | cut) & ((column[heads] < none) if k else True)
        heads, f = heads[kept], f[kept]
        spelling = [names.take(pa.array(columns[0][heads]))] + [words.take(pa.array(c[heads])) for c in columns[1 : k + 1]]
        phrase = pc.binary_join_element_wise(*spelling, pa.scalar(b"", pa.large_binary()))
        trimmed = pc.utf8_slice_codeunits(phrase.cast(pa.large_string()), 0, -1).cast(pa.string())
        yield _found(langs.take(pa.array(columns[0][heads])), trimmed, k + 1, f)


def _found(lang: pa.Array, phrase: pa.Array, size: int, f: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"lang": lang.cast(pa.string()), "phrase": phrase, "size": pa.array(np.full(len(f), size, np.int32)), "f": pa.array(f)})
