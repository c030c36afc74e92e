"""Media columns: Matroska files in a binary column, parsed to packet tables.

The parser reads variable-length EBML ids and sizes (unknown sizes too), walks the segment, and lists every packet of simple
blocks and block groups, with track, timestamp, byte range and lacing (none, Xiph, fixed-size, EBML) undone, plus the tracks and
the cue points. Packets are byte ranges of the file: nothing is decoded or copied until asked for.

The writer stores a payload losslessly as 8-bit PCM: one audio track, laced simple blocks in clusters, a cue for each cluster.

Defined results: a null or empty file, or one without an EBML head, has no packets; a file that is cut off or
damaged, or in whose blocks numbers go beyond 64 bits, gives the packets read so far, and `error` says what is wrong; a bad
number in what describes segment, tracks or cues is named there as well, and all packets are read; a null text is an empty text (64 zero bytes of payload); equal
bytes give equal files; a very long text is one file, made and read in one piece (some ten times its bytes at once); repeated
rows are stored each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import plain_text, slices, texts_sizes

#: Fixed values of the format: element ids.
EBML, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, LENGTH, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DEFAULT_DURATION, DEFAULT_SCALE = 0x23E383, 1_000_000
#: Elements of the segment's level, which end a cluster of unknown size.
_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}


class BadMedia(ValueError):
    pass


def read_id(data, at: int) -> tuple[int, int]:
    """The element id at a place, with its marker bits, and where it ends."""
    if at >= len(data):
        raise BadMedia("an id is cut off")
    first = data[at]
    n = 9 - first.bit_length()
    if n > 4 or at + n > len(data):
        raise BadMedia("an id is too long or cut off")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data, at: int) -> tuple[int | None, int]:
    """The number of variable length at a place (None: unknown size), and where it ends."""
    if at >= len(data):
        raise BadMedia("a size is cut off")
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise BadMedia("a size is too long or cut off")
    value = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def sized(value: int, n: int = 0) -> bytes:
    """A number of variable length, in n bytes or as few as hold it."""
    n = n or max(1, -(-(value + 1).bit_length() // 7))
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + sized(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


@dataclass
class Packet:
    track: int
    time_ns: int
    start: int
    size: int
    key: bool
    cluster: int
    lacing: int


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    rate: float = 8000.0
    channels: int = 1
    depth: int = 0
    frame_ns: int = 0


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    tracks: list[Track] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time_ns, track, cluster's first byte
    duration_ns: int = 0
    error: str | None = None


def _children(data, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        ident, at = read_id(data, at)
        size, at = read_size(data, at)
        stop = end if size is None else at + size
        if stop > end:
            raise BadMedia("an element outgrows what holds it")
        yield ident, at, stop
        at = stop


#: The greatest number that a table's column of 64 bits holds.
_MOST = (1 << 63) - 1


def _bounded(value: int) -> int:
    if not -_MOST <= value <= _MOST:
        raise BadMedia("a number is out of range")
    return value


def _uint(data, a: int, b: int) -> int:
    if b - a > 8:
        raise BadMedia("a number is too long")
    return _bounded(int.from_bytes(data[a:b], "big"))


def _float(data, a: int, b: int) -> float:
    value = struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0
    if not math.isfinite(value):
        raise BadMedia("a number isn't finite")
    return value


def _rounded(value: float) -> int:
    if not math.isfinite(value):
        raise BadMedia("a number isn't finite")
    return round(value)


def unlace(data, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames. lacing: 0 none, 1 Xiph, 2 fixed-size, 3 EBML."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise BadMedia("a laced block is empty")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise BadMedia("a lace is cut off")
                step, at = data[at], at + 1
                size += step
                if step < 255:
                    break
            sizes.append(size)
    elif lacing == 3:
        for k in range(n - 1):
            begin = at
            value, at = read_size(data, at)
            if value is None:
                raise BadMedia("a lace has no size")
            # Differences are signed: the middle of the range is zero.
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (at - begin) - 1) - 1))
    else:
        if (end - at) % n:
            raise BadMedia("a fixed-size lace doesn't divide its block")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise BadMedia("a lace outgrows its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _block(data, at: int, end: int, media: Media, base: int, scale: int, cluster: int, simple: bool, key: bool) -> None:
    track, at = read_size(data, at)
    if at + 3 > end:
        raise BadMedia("a block is cut off")
    ticks, flags = struct.unpack(">hB", data[at : at + 3])
    lacing = flags >> 1 & 3
    step = next((t.frame_ns for t in media.tracks if t.number == track), 0)
    for k, (start, size) in enumerate(unlace(data, at + 3, end, lacing)):
        media.packets.append(Packet(track or 0, _bounded((base + ticks) * scale + k * step), start, size, bool(flags & 0x80) if simple else key, cluster, lacing))


def _described(media: Media, ident: int, data, at: int, stop: int, scale: int, segment: int) -> int:
    """Reads what the segment says of itself, its tracks or its cues; the time scale that holds from here on."""
    for i, a, b in _children(data, at, stop):
        if ident == INFO and i == SCALE:
            scale = _uint(data, a, b)
        elif ident == INFO and i == DURATION:
            media.duration_ns = _bounded(_rounded(_float(data, a, b) * scale))
        elif ident == TRACKS and i == ENTRY:
            media.tracks.append(_track(data, a, b))
        elif ident == CUES and i == POINT:
            media.cues += _cue(data, a, b, scale, segment)
    return scale


def parse(data: bytes | None) -> Media:
    """The file's packets, tracks and cues; error: what stopped the reading."""
    media = Media()
    scale, number, clusters, segment = DEFAULT_SCALE, -1, {}, 0
    try:
        if not data or read_id(data, 0)[0] != EBML:
            raise BadMedia("no EBML head")
        levels = [(0, len(data))]
        while levels:
            at, end = levels.pop()
            while at < end:
                begin = at
                ident, at = read_id(data, at)
                size, at = read_size(data, at)
                stop = end if size is None else at + size
                if stop > end:
                    if ident not in (SEGMENT, CLUSTER):
                        raise BadMedia("an element outgrows what holds it")
                    media.error, stop = "the file is cut off", end  # what is there is read
                if ident == SEGMENT:
                    segment = at
                    levels.append((stop, end))
                    end = stop
                    continue
                if ident in (INFO, TRACKS, CUES):
                    try:
                        scale = _described(media, ident, data, at, stop, scale, segment)
                    except BadMedia as e:
                        media.error = str(e)  # the packets can be read without it
                elif ident == CLUSTER:
                    number += 1
                    clusters[begin] = number
                    base, inner = 0, at
                    while inner < stop:
                        i, a = read_id(data, inner)
                        if size is None and i in _TOP:
                            stop = inner
                            break
                        n, a = read_size(data, a)
                        b = stop if n is None else a + n
                        if b > stop:
                            raise BadMedia("an element outgrows its cluster")
                        if i == TIME:
                            base = _uint(data, a, b)
                        elif i == SIMPLE:
                            _block(data, a, b, media, base, scale, number, True, True)
                        elif i == GROUP:
                            parts = list(_children(data, a, b))
                            key = all(x != REFERENCE for x, _, _ in parts)
                            for x, c, d in parts:
                                if x == BLOCK:
                                    _block(data, c, d, media, base, scale, number, False, key)
                        inner = b
                at = stop
        if not segment:
            raise BadMedia("no segment")
    except (BadMedia, struct.error) as e:
        media.error = str(e)
    return media


def _track(data, at: int, end: int) -> Track:
    t = Track()
    for i, a, b in _children(data, at, end):
        if i == NUMBER:
            t.number = _uint(data, a, b)
        elif i == KIND:
            t.kind = _uint(data, a, b)
        elif i == CODEC:
            t.codec = bytes(data[a:b]).decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            t.frame_ns = _uint(data, a, b)
        elif i == AUDIO:
            for j, c, d in _children(data, a, b):
                if j == RATE:
                    t.rate = _float(data, c, d)
                elif j == CHANNELS:
                    t.channels = _uint(data, c, d)
                elif j == DEPTH:
                    t.depth = _uint(data, c, d)
    return t


def _cue(data, at: int, end: int, scale: int, segment: int) -> list[tuple[int, int, int]]:
    time, out = 0, []
    for i, a, b in _children(data, at, end):
        if i == CUE_TIME:
            time = _bounded(_uint(data, a, b) * scale)
        elif i == POSITIONS:
            got = {j: _uint(data, c, d) for j, c, d in _children(data, a, b)}
            out.append((time, got.get(CUE_TRACK, 0), _bounded(segment + got.get(CUE_CLUSTER, 0))))
    return out


#: 8000 samples a second: 8 a millisecond. Frames of 1024 samples, up to 8 to a block, 16 blocks to a cluster.
SAMPLE_RATE, FRAME, LACE, BLOCKS = 8000, 1024, 8, 16
_FRAME_MS = FRAME * 1000 // SAMPLE_RATE
_HEAD = element(EBML, unsigned(0x4286, 1) + unsigned(0x42F7, 1) + unsigned(0x42F2, 4) + unsigned(0x42F3, 8) + element(0x4282, b"matroska") + unsigned(0x4287, 4) + unsigned(0x4285, 2))
_TRACK = element(TRACKS, element(ENTRY, unsigned(NUMBER, 1) + unsigned(UID, 1) + unsigned(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + unsigned(DEFAULT_DURATION, _FRAME_MS * 1_000_000) + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + unsigned(CHANNELS, 1) + unsigned(DEPTH, 8))))


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing and the block's body: fixed-size if frames are equally long, else EBML."""
    if len(frames) == 1:
        return 0, frames[0]
    head = bytes([len(frames) - 1])
    if len({*map(len, frames)}) == 1:
        return 2, head + b"".join(frames)
    sizes = [sized(len(frames[0]))]
    for a, b in zip(frames, frames[1:-1], strict=False):
        n = next(n for n in range(1, 9) if abs(len(b) - len(a)) < 1 << 7 * n - 1)
        sizes.append(sized(len(b) - len(a) + (1 << 7 * n - 1) - 1, n))
    return 3, head + b"".join(sizes) + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file that holds the payload as unsigned 8-bit samples."""
    info = element(INFO, unsigned(SCALE, DEFAULT_SCALE) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(0x4D80, b"skeinlake") + element(0x5741, b"skeinlake"))
    frames = [payload[a : a + FRAME] for a in range(0, len(payload), FRAME)]
    clusters, cues, at = [], [], len(info) + len(_TRACK)
    for c in range(0, len(frames), LACE * BLOCKS):
        base = c * _FRAME_MS
        body = [unsigned(TIME, base)]
        for b in range(c, min(c + LACE * BLOCKS, len(frames)), LACE):
            lacing, data = _laced(frames[b : min(b + LACE, c + LACE * BLOCKS)])
            body.append(element(SIMPLE, sized(1) + struct.pack(">hB", b * _FRAME_MS - base, 0x80 | lacing << 1) + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(POINT, unsigned(CUE_TIME, base) + element(POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        clusters.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, info + _TRACK + b"".join(clusters) + element(CUES, b"".join(cues)))


def demux(data: bytes, media: Media, track: int = 1) -> bytes:
    """The packets' bytes of a track, in the file's order."""
    return b"".join([data[p.start : p.start + p.size] for p in media.packets if p.track == track])


def features(media: Media, samples: np.ndarray) -> str:
    """What the samples and packets are like, as name=value pairs."""
    centred = samples.astype(np.int16) - 128
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    total = int(samples.sum(dtype=np.int64))
    energy = int((centred.astype(np.int64) ** 2).sum())
    seconds = len(samples) / SAMPLE_RATE
    return f"tracks={len(media.tracks)};packets={len(media.packets)};clusters={len({p.cluster for p in media.packets})};cues={len(media.cues)};seconds={seconds:.6f};mean={total / len(samples):.4f};rms={(energy / len(samples)) ** 0.5:.4f};peak={int(np.abs(centred).max())};crossings={crossings}"


def padded(text: bytes) -> bytes:
    """Zero bytes behind, up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def packet_table(media: DataFrame, key: str, content: str) -> DataFrame:
    """A row for each packet of each file: key, track, time_ns, start, size, is_key, cluster, lacing."""
    rows = media.select(key, content)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                own = parse(data.as_py()).packets
                for a in range(0, len(own), 10_000):
                    some = own[a : a + 10_000]
                    columns = {key: pa.array([batch.column(0)[i].as_py()] * len(some), batch.schema.field(0).type), "track": pa.array([p.track for p in some], pa.int64()), "time_ns": pa.array([p.time_ns for p in some], pa.int64()), "start": pa.array([p.start for p in some], pa.int64()), "size": pa.array([p.size for p in some], pa.int64()), "is_key": pa.array([p.key for p in some], pa.bool_()), "cluster": pa.array([p.cluster for p in some], pa.int32()), "lacing": pa.array([p.lacing for p in some], pa.int32())}
                    yield pa.record_batch(columns)

    return rows.mapInArrow(made, f"`{key}` {dict(rows.dtypes)[key]}, track long, time_ns long, start long, size long, is_key boolean, cluster int, lacing int")


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """Each row's text stored as a file and read back from it: key, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, n_packets, and the file itself (media, if kept)."""
    rows = plain_text(docs, key, text=text)
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "media")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    used = len(names) if keep_media else len(names) - 1

    def one(text: bytes) -> tuple:
        stored = mux(padded(text))
        media = parse(stored)
        back = demux(stored, media)
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media, np.frombuffer(back, np.uint8)), len(media.packets), stored

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts_sizes(texts)):
                out = list(zip(*[one(x.encode())[:used] for x in texts.slice(a, b - a).to_pylist()], strict=True))
                yield pa.record_batch({key: batch.column(key).slice(a, b - a)} | {n: pa.array(v, k) for n, v, k in zip(names, out, kinds, strict=False)})

    return rows.mapInArrow(made, f"`{key}` {dict(rows.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long" + ", media binary" * keep_media)
