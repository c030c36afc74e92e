"""Numpy passes over the UTF-8 of many texts at once, for the classifiers' features."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.empty(n, np.uint64)
        p[0] = 1
        done = 1
        while done < n:
            step = np.uint64(pow(base, done, 1 << 64))
            more = min(done, n - done)
            p[done : done + more] = p[:more] * step
            done += more
        out.append(p)
    return out[0], out[1]


#: Bytes whose prefix sums are held at once.
BLOCK = 4 << 20


class Hasher:
    """Hashes of any spans of a buffer, from prefix sums of a block of it at a time: equal bytes, equal hash, wherever they stand."""

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        self.sums = self._sums(0, len(buf)) if len(buf) <= BLOCK else None

    def _sums(self, lo: int, hi: int) -> np.ndarray:
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.buf[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(BLOCK + 1)[0][: hi - lo], out=sums[1:])
        return sums

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """starts and ends: both ascending."""
        down = _powers(BLOCK + 1)[1]
        if self.sums is not None:
            h = (self.sums[ends] - self.sums[starts]) * down[starts]
        else:
            h = np.empty(len(starts), np.uint64)
            at = 0
            while at < len(starts):
                lo = int(starts[at])
                stop = int(np.searchsorted(ends[at:], lo + BLOCK, side="right")) + at  # ends ascend as starts do
                if stop == at:
                    h[at] = self._long(lo, int(ends[at]))
                    at += 1
                    continue
                sums = self._sums(lo, int(ends[stop - 1]))
                a, z = starts[at:stop] - lo, ends[at:stop] - lo
                h[at:stop] = (sums[z] - sums[a]) * down[a]
                at = stop
        h ^= h >> np.uint64(29)
        h *= _MIX
        return h

    def _long(self, lo: int, hi: int) -> int:
        """A span that is longer than a block, block by block."""
        total = 0
        for a in range(lo, hi, BLOCK):
            total += int(self._sums(a, min(a + BLOCK, hi))[-1]) * pow(_BASE, a - lo, 1 << 64)
        return total % (1 << 64)


def lookup(members: bytes) -> np.ndarray:
    """A table of 256 truth values."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of words: ASCII letters, digits, the apostrophe, and all of other scripts.
WORD = lookup(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b"'" + bytes(range(128, 256)))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, a newline behind each; where each starts, and the end."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), starts


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words. The buffer ends in a newline."""
    inside = WORD[buf].view(np.int8)
    step = np.diff(inside, prepend=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True. The last value is False."""
    step = np.diff(inside.view(np.int8), prepend=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def spelled(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """An id for each of the buffer's spans (at least one, ascending, apart), the same for the same bytes, and what the ids stand for."""
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    both = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(buf)])  # spans and what lies between
    coded = both.dictionary_encode()
    return coded.indices.to_numpy()[0::2], coded.dictionary
