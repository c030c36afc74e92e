"""Token ids of whole texts by the tokenizers library, with each distinct piece of text encoded once in a worker."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: White space as the vocabulary's pattern has it (Unicode's White_Space property).
_WHITE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: White space other than blanks and line feeds.
_OTHER = re.compile(f"[{_WHITE.replace(chr(32), '').replace('\t-\r', '\t\x0b-\r')}]")


_WHITES = frozenset(["", *"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"])
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Letters before this one have been letters in all versions of Unicode that are in use.
_LATIN_END = "\u0250"
#: The characters that byte-level vocabularies write bytes as: printable ones as they are, the others from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Pieces whose ids a worker keeps: about 350 MB at most.
KEEP = 2_000_000


class ChunkEncoder:
    """Encodes whole texts to little-endian ids of 16 or 32 bits.

    A byte-level pattern never lets a word run past white space, and gives the last blank of a run to the word behind it.
    So a text may be cut before each blank that stands between two other characters, and the pieces are encoded alike alone
    and in place; texts with longer runs are cut before each run. The ids of up to `keep` pieces are kept in two
    generations: once the younger holds half, the older goes, and what is used again moves up.
    """

    def __init__(self, tokenizer_file: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether a text holds one of the file's added tokens; those with white space would be cut apart.
        self.added = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
        self.whole = any(_OTHER.search(s) or " " in s or "\n" in s for s in special)
        self.dtype = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.keep, self.known, self.older = keep, {}, {}
        self.tail: dict[str, bytes] = {}
        self.model = self._plain_model(special)
        self.line = self._one("\n")

    def _all(self, pieces: list[str]) -> list[bytes]:
        """The ids of a blank and each piece behind it; new pieces are encoded together."""
        known, older = self.known, self.older
        got = list(map(known.get, pieces))
        if None in got:
            gaps = [i for i, g in enumerate(got) if g is None]
            wanted = {pieces[i] for i in gaps}
            if older:
                known.update([(p, g) for p in wanted if (g := older.get(p)) is not None])
                new = [p for p in wanted if p not in known]
            else:
                new = list(wanted)
            self._learn(new)
            for i in gaps:
                got[i] = known[pieces[i]]
        return got

    def _learn(self, pieces: list[str]) -> None:
        """Adds pieces' ids. Lines, and marks behind a letter at the end, are words of their own: such a piece is put together from
        parts. A part behind a line end stands under its own text with that line end."""
        known, older, ask, late = self.known, self.older, [], []
        for p in pieces:
            if (ids := self._word(p)) is not None:
                known[p] = ids
                continue
            first, end, rest = p.partition("\n")
            if end:
                parts = [first, *(f"\n{r}" for r in rest.split("\n"))] if first and rest and "\n\n" not in p and rest[-1] != "\n" else None
            else:
                word = p.rstrip(_MARKS)
                parts = [word, p[len(word) :]] if word != p and word[-1:] in _LETTERS and not self.added(p) else None
            if parts is None:
                ask.append(p)
            elif end:
                for x in parts:
                    if x not in known and x not in older:
                        if (ids := self._word(x)) is not None:
                            known[x] = ids
                        else:
                            ask.append(x)
                late.append((p, parts))
            elif (ids := known.get(parts[0]) or older.get(parts[0]) or self._word(parts[0])) is not None:
                if (tail := self.tail.get(parts[1])) is None:
                    tail = self._one(parts[1])
                    if len(self.tail) < 10_000:
                        self.tail[parts[1]] = tail
                known[p] = ids + tail
            else:
                ask.append(p)
        texts = [p if p[:1] == "\n" else f" {p}" for p in ask]
        for p, e in zip(ask, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            known[p] = array(self.code, e.ids).tobytes()
        for p, parts in late:
            known[p] = b"".join([known[x] if x in known else older[x] for x in parts])

    def _word(self, piece: str) -> bytes | None:
        """The ids of a blank (or of the line end that is the piece's first character) and Latin letters behind it, which the pattern
        takes as one word: the library's model gets it at once, without pattern and added tokens. None for other pieces."""
        if self.model is None:
            return None
        line = piece[:1] == "\n"
        word = piece[1:] if line else piece
        if word.isascii():
            if not word.isalpha():
                return None
        elif word.isalpha() and max(word) < _LATIN_END:
            word = word.encode().decode("latin-1").translate(_BYTES)
        else:
            return None
        return (self.line if line else b"") + array(self.code, [t.id for t in self.model.tokenize(word if line else f"\u0120{word}")]).tobytes()

    def _plain_model(self, special: list[str]):
        """The library's model, if the file cuts words of letters as byte-level files do, normalizes nothing, and no added token can stand in such a word."""
        cutter = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or cutter is None or any(not (x := s.strip("\n")) or x.isalpha() for s in special):
            return None
        words = [w for w, _ in cutter.pre_tokenize_str("ab \u00e9\u010da\nZz q")]
        return self.tokenizer.model if words == ["ab", "\u0120" + "\u00e9\u010da".encode().decode("latin-1").translate(_BYTES), "\u010a", "Zz", "\u0120q"] else None

    def _one(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if len(self.known) * 2 > self.keep:
            self.older, self.known = self.known, {}
        if self.whole:
            return self._one(text)
        if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or _OTHER.search(text):
            found = _CHUNK.findall(text)
            if found and found[0][0] != " ":
                return self._one(found[0]) + self._careful(found[1:])
            return self._careful(found)
        first, *rest = text.split(" ")
        return self._one(first) + b"".join(self._all(rest))

    def _careful(self, found: list[str]) -> bytes:
        return b"".join([self._all([x[1:]])[0] if x[0] == " " and x[1:2] not in _WHITES else self._one(x) for x in found])


@lru_cache(maxsize=1)
def encoder(tokenizer_file: str, keep: int) -> ChunkEncoder:
    """A worker's own, kept from task to task."""
    return ChunkEncoder(tokenizer_file, keep)


def id_type(vocabulary: int) -> np.dtype:
    """The least unsigned little-endian type that holds the ids."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
