"""BPE encoding and decoding by batched numpy merge rounds.

A text is normalised and cut to words as the vocabulary's file says; the symbols of many distinct words lie in one flat
array. In each round every adjacent pair's rank is found by binary search over the sorted pair keys, each word's lowest rank
by a segmented minimum, and the words' pairs of that rank are merged; words without a mergeable pair are done. Each distinct
blank-separated piece of text is encoded once in a worker.

The reference order merges the lowest rank's leftmost pair first and looks again. All of a word's pairs of that rank may be
merged at once if no pair that holds the new symbol ranks below it, which holds for nearly all merges and is looked up;
for the others only the leftmost is merged. Words of more than `LONG` symbols, which would need a round for each of their
many merges, are merged with a heap instead.

Defined results: null and empty texts have no tokens (the hash of the empty string); added tokens are found in the raw text
as whole strings, as the library finds them; equal texts encode alike; repeated rows are encoded each; an empty table gives
no rows; columns beside key and text are not read. Vocabularies must name every byte (no unknown token is made up).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import plain_text, slices, texts_sizes

LONG = 512
#: White space as Unicode's White_Space property has it.
_WHITE = "\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[^{_WHITE}]+")
_ODD = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")


class MergeTable:
    """Sorted pair keys (left id x size + right id) with rank and merged id."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.size = max(vocab.values()) + 1
        left, right, new = (np.array([vocab[f(a, b)] for a, b in merges], np.int64) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a + b))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), new[order]
        # The least rank of the pairs that hold a symbol.
        least = np.full(self.size, len(keys), np.int64)
        np.minimum.at(least, left, np.arange(len(keys)))
        np.minimum.at(least, right, np.arange(len(keys)))
        self.new_by_rank = new
        self.at_once = least[new] > np.arange(len(keys))
        self.none = len(keys)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], self.none)

    def merge_all(self, words: list[list[int]]) -> list[list[int]]:
        """Each word's symbols after all merges."""
        done: list[list[int] | None] = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG:
                done[i] = self.merge_long(w)
            elif len(w) < 2:
                done[i] = w
            else:
                short.append(i)
        number = np.array(short, np.int64)
        symbols = np.array([s for i in short for s in words[i]], np.int64)
        sizes = np.array([len(words[i]) for i in short], np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(symbols), self.none, np.int64)  # of each symbol with the next of its word
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.ranks_of(symbols[inside], symbols[inside + 1])
        while len(number):
            starts = np.append(0, np.cumsum(sizes)[:-1])
            low = np.minimum.reduceat(rank, starts)
            ended = low == self.none
            if ended.any():
                flat, stop = symbols.tolist(), np.append(starts[1:], len(symbols))
                for k, a, b in zip(number[ended].tolist(), starts[ended].tolist(), stop[ended].tolist(), strict=True):
                    done[k] = flat[a:b]
                stay = ~ended
                keep = np.repeat(stay, sizes)
                number, symbols, rank, low, sizes = number[stay], symbols[keep], rank[keep], low[stay], sizes[stay]
                if not len(number):
                    break
                word = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero(rank == low[word])
            new_word = np.append(True, word[hit[1:]] != word[hit[:-1]])
            # In a run of overlapping hits (equal symbols in a row) every second one counts, from the left.
            linked = np.append(False, (hit[1:] == hit[:-1] + 1) & ~new_word[1:])
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(linked, 0, place))
            take = hit[(run % 2 == 0) & (new_word | self.at_once[low[word[hit]]])]
            symbols[take] = self.new_by_rank[rank[take]]
            keep = np.ones(len(symbols), bool)
            keep[take + 1] = False
            sizes = sizes - np.bincount(word[take], minlength=len(sizes))
            at = np.cumsum(keep)[take] - 1
            symbols, rank, word = symbols[keep], rank[keep], word[keep]
            # Only the pairs that hold a new symbol have another rank now.
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed] = self.none
            inner = changed[changed + 1 < len(symbols)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.ranks_of(symbols[inner], symbols[inner + 1])
        return done

    def merge_long(self, word: list[int]) -> list[int]:
        """The same order by a heap of pairs, for one word of any length."""
        sym, n = list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known = self._dict()

        def push(i: int) -> None:
            if 0 <= i and after[i] < n and (got := known.get((sym[i], sym[after[i]]))):
                heapq.heappush(heap, (got[0], i, sym[i], sym[after[i]], got[1]))

        heap: list[tuple[int, int, int, int, int]] = []
        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            if sym[i] != a or after[i] >= n or sym[after[i]] != b:
                continue
            j = after[i]
            sym[i], sym[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [s for s in sym if s >= 0]

    def _dict(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "pairs"):
            self.pairs = {(k // self.size, k % self.size): (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.merged.tolist(), strict=True)}
        return self.pairs


class Bpe:
    """A tokenizer file's BPE with word ends, lower case and byte letters."""

    def __init__(self, tokenizer_file: str, keep: int = 1_200_000):
        with open(tokenizer_file, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        kinds = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        cut = told["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cut] != ["Split", "ByteLevel"] or told["decoder"] or told["post_processor"]:
            raise ValueError("not a file of this kind: NFC, white space, lower case; split, byte letters; BPE with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.word = regex.compile(cut[0]["pattern"]["Regex"])
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        self.table = MergeTable(self.vocab, [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]], self.suffix)
        self.first = [self.vocab[c] for c in byte_letters()]
        self.last = [self.vocab[c + self.suffix] for c in byte_letters()]
        self.keep, self.pieces, self.older, self.tail = keep, {}, {}, {}
        self.learn({".", ","})
        self.tail = {x: self.pieces[x] for x in (".", ",")}

    def _cut(self, piece: str) -> list[str]:
        """The words of a piece without white space."""
        text = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
        # Letter by letter, as the library does: a final sigma has no form of its own.
        text = text.replace("Σ", "σ").lower()
        return self.word.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Ids and names of new pieces: number of tokens, ids joined by a blank, names joined by a blank."""
        if len(self.pieces) * 2 > self.keep:
            self.older, self.pieces = self.pieces, {}
        new = []
        known, older = self.pieces, self.older
        for p in pieces.difference(known):
            # The same in lower case; or a known piece with a stop or comma behind its last letter, which is a word of its own.
            low = p.lower() if p.isascii() else p
            got = older.get(p) or (known.get(low) or older.get(low) if low != p else None)
            if got is None and low[-1] in self.tail and low[-2:-1] in _LETTERS and (base := known.get(low[:-1]) or older.get(low[:-1])):
                n, ids, names = self.tail[low[-1]]
                got = (base[0] + n, f"{base[1]} {ids}", f"{base[2]} {names}")
            if got is None:
                new.append(p)
            else:
                known[p] = got
        cut = [self._cut(p) for p in new]
        words = list({w for ws in cut for w in ws})
        symbols = []
        for w in words:
            b = w.encode()
            symbols.append([self.first[x] for x in b[:-1]] + [self.last[b[-1]]])
        found: dict[str, list[int]] = {}
        for a in range(0, len(words), 50_000):
            found.update(zip(words[a : a + 50_000], self.table.merge_all(symbols[a : a + 50_000]), strict=True))
        names = self.names
        for p, ws in zip(new, cut, strict=True):
            ids = [i for w in ws for i in found[w]]
            self.pieces[p] = (len(ids), " ".join(map(str, ids)), " ".join([names[i] for i in ids]))

    def split(self, text: str) -> tuple[list[str], bool]:
        """The text's pieces in order, added tokens among them as themselves; whether there are any."""
        find = _PIECE.findall if _ODD.search(text) else str.split
        if not self.special.search(text):
            return find(text), False
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*find(text[at : m.start()]), m.group()]
            at = m.end()
        return out + find(text[at:]), True

    def encode_many(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of tokens, ids joined by a blank, decoded text."""
        split = [self.split(t) for t in texts]
        wanted = {p for parts, odd in split for p in parts} if any(odd for _, odd in split) else set().union(*[parts for parts, _ in split])
        self.learn(wanted.difference(self.added))
        known, out = self.pieces, []
        for parts, odd in split:
            got = [(1, str(self.added[p]), p) if p in self.added else known[p] for p in parts] if odd else list(map(known.__getitem__, parts))
            # A piece may have no tokens (a lone control character, say, always has; an empty match never).
            out.append((sum([g[0] for g in got]), " ".join([g[1] for g in got if g[0]]), " ".join([g[2] for g in got if g[0]])))
        return out

    def encode(self, text: str) -> list[int]:
        n, ids, _ = self.encode_many([text])[0]
        return list(map(int, ids.split())) if n else []

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False) of a file without a decoder: the tokens, joined by a blank."""
        return " ".join([self.names[i] for i in ids if i in self.names])


@lru_cache(maxsize=2)
def bpe(tokenizer_file: str) -> Bpe:
    """A worker's own, kept from task to task."""
    return Bpe(tokenizer_file)


def encode_documents(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """Each row of docs: key, n_tokens, ids_sha256 (of the decimal ids joined by a blank), decoded_sha256; with texts also ids
    (that string) and decoded."""
    rows = plain_text(docs, key, text=text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(tokenizer_file)
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(texts_sizes(column)):
                got = own.encode_many(column.slice(a, b - a).to_pylist())
                out = {key: batch.column(key).slice(a, b - a), "n_tokens": pa.array([g[0] for g in got], pa.int64())}
                out |= {f"{name}_sha256": pa.array([hashlib.sha256(g[i].encode()).hexdigest() for g in got], pa.string()) for i, name in ((1, "ids"), (2, "decoded"))}
                yield pa.record_batch(out | ({"ids": pa.array([g[1] for g in got], pa.string()), "decoded": pa.array([g[2] for g in got], pa.string())} if texts else {}))

    return rows.mapInArrow(made, f"`{key}` {dict(rows.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * texts)
