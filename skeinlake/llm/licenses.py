"""License scans by an exact set-similarity join of text blocks with templates.

A block is a run of consecutive words, twice as many as the longest template has, and one begins every half block, so that whatever is as long as a template
lies whole in some block. A block contains a template if it has at least the share `threshold` of the template's distinct words (phrases: all). Words are
ordered globally by their frequency in all documents, rarest first, and words that no template has are of no account. A block then can contain a template
only if it has as many such words as must be shared (length filter), if a word is common to the first |T| - needed + 1 words of the template
and the first |B| - needed + 1 of the block (prefix filter), and if from the first such word on enough words are left on both sides (positional filter). What
passes all three is verified. No block that meets the threshold is missed.

Phrases are templates of few words, of which blocks must have all; in the blocks found so, their places are where the words
stand one behind the other. Templates are parameters; those of `MOST_WORDS` distinct words in sum go to all tasks at once, more go in portions, each in a pass
of its own over what the one before returns. The only shuffle adds up frequencies.

Defined results: null and empty texts, and texts without words, have nothing (score 0.0, empty labels, null places); repeated rows and ids are judged each; very long texts
are looked at whole, in portions that overlap by a block; words of equal frequency are in byte order; an empty table gives no rows; columns beside key and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import lookup, runs, spelled
from .common import plain_text, slices, texts_sizes

#: Distinct words of templates that go to a task at once; words of a text that are looked at at once.
MOST_WORDS, PORTION = 200_000, 1 << 20

_INSIDE = lookup(bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    """A label's wording. A phrase counts where its words stand one behind the other."""

    label: str
    wording: str
    phrase: bool = False

    def words(self) -> list[bytes]:
        return _WORD.findall(self.wording.encode().lower())


# The phrases and labels that are asked for.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

# Wordings of public licenses and of the notices that name them.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    Template("mit", "Released under the MIT License."),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)


def block_words(templates: tuple[Template, ...]) -> int:
    """Words from the beginning of one block to that of the next: those of the longest template. A block has twice as many."""
    return max((len(t.words()) for t in templates), default=1)


class Index:
    """Templates over the global order of their words: ranks by frequency, prefixes, and what they must share."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[bytes, int], threshold: float, step: int):
        self.templates, self.step = templates, step
        wordings = [t.words() for t in templates]
        vocabulary = sorted({w for ws in wordings for w in ws}, key=lambda w: (frequency.get(w, 0), w))
        self.vocabulary = pa.array(vocabulary, pa.large_binary())
        rank = {w: i for i, w in enumerate(vocabulary)}
        self.sequences = [np.array([rank[w] for w in ws], np.int64) for ws in wordings]
        sets = [np.unique(s) for s in self.sequences]
        self.sizes = np.array([len(s) for s in sets])
        self.needed = np.array([len(s) if t.phrase else shared(len(s), threshold) for s, t in zip(sets, templates, strict=True)])
        self.members = np.zeros((len(sets), len(vocabulary)), bool)
        entries = []
        for t, s in enumerate(sets):
            self.members[t, s] = True
            entries += [(int(w), t, i) for i, w in enumerate(s[: len(s) - self.needed[t] + 1])]
        entries.sort()
        self.words, self.owners, self.at = (np.array(c, np.int64) for c in (zip(*entries, strict=True) if entries else ((), (), ())))

    def ranks(self, spelling: pa.Array) -> np.ndarray:
        """The rank of each word; -1: in no template."""
        return pc.fill_null(pc.index_in(spelling, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def contained(self, block: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """block, template and number of common words for each pair that meets the threshold, of (block, rank of a word) rows."""
        key = np.unique(block * len(self.vocabulary) + rank)
        block, rank = key // len(self.vocabulary), key % len(self.vocabulary)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        sizes = np.diff(starts, append=len(block))
        own = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(block)) - starts[own]
        lo, hi = np.searchsorted(self.words, rank), np.searchsorted(self.words, rank, side="right")
        many = hi - lo
        row = np.repeat(np.arange(len(block)), many)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + lo[row]
        template, i, j, b = self.owners[entry], self.at[entry], place[row], own[row]
        needed, length = self.needed[template], sizes[b]
        passes = (length >= needed) & (j <= length - needed) & (1 + np.minimum(self.sizes[template] - 1 - i, length - 1 - j) >= needed)
        # later common words of a pair have more behind them counted already: the first one decides
        pair, first = np.unique(b * len(self.templates) + template, return_index=True)
        pair = pair[passes[first]]
        b, template = pair // len(self.templates), pair % len(self.templates)
        rows = np.repeat(starts[b], sizes[b]) + np.arange(int(sizes[b].sum())) - np.repeat(np.cumsum(sizes[b]) - sizes[b], sizes[b])
        common = np.add.reduceat(self.members[np.repeat(template, sizes[b]), rank[rows]].astype(np.int64), np.cumsum(sizes[b]) - sizes[b]) if len(b) else np.zeros(0, np.int64)
        good = common >= self.needed[template]
        return block[starts[b[good]]], template[good], common[good]


def shared(size: int, threshold: float) -> int:
    """The least number of words whose share of `size` is at least the threshold."""
    n = max(1, ceil(threshold * size))
    return n - 1 if n > 1 and (n - 1) / size >= threshold else n


def frequencies(rows: DataFrame, templates: tuple[Template, ...]) -> dict[bytes, int]:
    """How often all texts have each word of the templates."""
    wanted = sorted({w for t in templates for w in t.words()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set, total = pa.array(wanted, pa.large_binary()), np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, buf, starts, ends, *_ in _portions(batch.column("text"), 0):
                ids, spelling = spelled(buf, starts, ends)
                known = pc.index_in(spelling, value_set=value_set).take(pa.array(ids)).drop_null().to_numpy()
                total += np.bincount(known, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch({"word": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})

    got = rows.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # words of templates alone
    return {wanted[r["word"]]: r["n"] for r in got}


def _portions(texts: pa.Array, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Words of slices of the texts: the number of the text that each is of, the slice's bytes, each word's start and end there, and its number in its
    text; and the number from which on blocks are left to the next portion. With a step, portions of a long text begin where a block does and overlap by a block."""
    for a, b in slices(texts_sizes(texts)):
        data = b"\n".join(texts.slice(a, b - a).cast(pa.binary()).to_pylist()).lower() + b"\n"
        buf = np.frombuffer(data, np.uint8)
        starts, ends = runs(_INSIDE[buf])
        if not len(starts):
            continue
        sizes = np.array(texts_sizes(texts.slice(a, b - a)))
        of = np.searchsorted(np.cumsum(sizes + 1), starts, side="right") if b - a > 1 else np.zeros(len(starts), np.int64)
        number = np.arange(len(starts)) - np.searchsorted(of, of)
        stride = PORTION - PORTION % step if step else PORTION
        for lo in range(0, len(starts), stride if b - a == 1 else len(starts)):
            hi = lo + stride + 2 * step if b - a == 1 else len(starts)
            yield of[lo:hi] + a, buf, starts[lo:hi], ends[lo:hi], number[lo:hi], lo + stride if hi < len(starts) else len(starts)


def _found(index: Index, texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The number of words of each text, and (text, template, place, common words): for a phrase the number of its first word, for
    other templates that of the block's."""
    n_words, out = np.zeros(len(texts), np.int64), set()
    step = index.step
    for of, buf, starts, ends, number, end in _portions(texts, step):
        np.maximum.at(n_words, of, number + 1)
        ids, spelling = spelled(buf, starts, ends)
        rank = index.ranks(spelling)[ids]
        known = np.flatnonzero(rank >= 0)
        if not len(known):
            continue
        # blocks of the portion, numbered by text and place; a word is in the block that begins last before it and in the one before that
        base, most = int(of[0]), int(number.max()) // step + 2
        block = (of[known] - base) * most + number[known] // step
        later, sooner = block % most * step < end, number[known] // step > number[0] // step
        sooner &= (block % most - 1) * step < end
        blocks, templates, common = index.contained(np.concatenate([block[later], block[sooner] - 1]), np.concatenate([rank[known[later]], rank[known[sooner]]]))
        for block, t, n in zip(blocks.tolist(), templates.tolist(), common.tolist(), strict=True):
            text, begin = base + block // most, block % most * step
            if not index.templates[t].phrase:
                out.add((text, t, begin, n))
                continue
            lo = int(np.searchsorted(of, text)) + begin - int(number[np.searchsorted(of, text)])
            lo, hi = max(lo, 0), min(max(lo, 0) + 2 * step, int(np.searchsorted(of, text, side="right")))
            words, have = index.sequences[t], rank[lo:hi]
            at = np.flatnonzero(np.logical_and.reduce([have[i : len(have) - len(words) + 1 + i] == w for i, w in enumerate(words)])) if len(have) >= len(words) else ()
            out.update((text, t, int(number[lo + i]), n) for i in at)
    return n_words, sorted(out)


_FOUND = "array<struct<template:int,label:string,phrase:boolean,place:long,containment:double>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = (*PHRASES, *TEMPLATES), threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, found: for each row of docs the templates that it has (number, label, whether it is a phrase), where (the number of a phrase's
    first word, or of the block's) and how much of them (containment)."""
    rows = plain_text(docs, key, text=text)
    step, kind = block_words(templates), dict(rows.dtypes)[key]
    frequency = frequencies(rows, templates)
    out = rows.select(key, "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(_FOUND).alias("found"))
    for part in _parts(templates):
        out = _scanned(out, part, Index(tuple(templates[t] for t in part), frequency, threshold, step), key, kind)
    return out.drop("text")


def _parts(templates: tuple[Template, ...]) -> Iterator[list[int]]:
    """Numbers of templates whose words go to a task at once."""
    own: list[int] = []
    held = 0
    for t, template in enumerate(templates):
        n = len(set(template.words()))
        if own and held + n > MOST_WORDS:
            yield own
            own, held = [], 0
        if n:
            own.append(t)
            held += n
    yield own


def _scanned(rows: DataFrame, numbers: list[int], index: Index, key: str, kind: str) -> DataFrame:
    shared_index = rows.sparkSession.sparkContext.broadcast((index, numbers))  # at most MOST_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, numbers = shared_index.value
        for batch in batches:
            texts, at = batch.column("text"), batch.schema.get_field_index("found")
            n_words, found = _found(index, texts)
            lists: list[list[dict]] = batch.column(at).to_pylist()
            for row, t, place, n in found:
                own = index.templates[t]
                lists[row].append({"template": numbers[t], "label": own.label, "phrase": own.phrase, "place": place, "containment": n / int(index.sizes[t])})
            columns = {key: batch.column(key), "text": texts, "n_words": pa.array(n_words), "found": pa.array(lists, batch.schema.field(at).type)}
            yield pa.record_batch(columns)

    return rows.mapInArrow(run, f"`{key}` {kind}, text string, n_words long, found {_FOUND}")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score of what scan() found."""
    base = F.filter("found", lambda x: x["phrase"])
    places = F.transform(base, lambda x: x["place"])
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return scanned.select(
        key, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0)).alias("score"),
    )


def sql(templates: tuple[Template, ...] = (*PHRASES, *TEMPLATES), threshold: float = 0.8) -> str:
    """DuckDB SQL of the digest of all documents."""
    step = block_words(templates)
    listed = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    texts = [t for t in templates if not t.phrase]
    known = ", ".join(f"('{t.label}', {listed(sorted(set(t.words())))}, {shared(len(set(t.words())), threshold)})" for t in texts)
    phrases = ", ".join(f"('{t.label}', {listed(t.words())})" for t in templates if t.phrase)
    return rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) AS p(label, words)), t AS (SELECT * FROM (VALUES {known}) AS t(label, words, needed)),
b AS (SELECT row, label, i - 1 AS place FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d), p WHERE w[i:i + len(words) - 1] = words),
base AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY row),
k AS (SELECT row, list_distinct(w[i * {step} + 1:i * {step} + {2 * step}]) AS s FROM (SELECT row, w, unnest(range(0, (len(w) - 1) // {step} + 1)) AS i FROM d WHERE len(w) > 0)),
m AS (SELECT row, label, len(list_intersect(s, words)) / len(words)::DOUBLE AS c FROM k, t WHERE len(list_intersect(s, words)) >= needed),
l AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM (SELECT * FROM m UNION ALL SELECT row, label, 1 FROM b) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN base USING (row) LEFT JOIN l USING (row)"""
