"""A streaming source of event-stream files that grow: ``spark.readStream.format("event_stream").load(folder)`` after ``register(spark)``.

Columns: file, at (the byte that the frame begins at), id, event, data. A frame ends at a blank line. The offset of a file is the end of its last whole frame, so what is unfinished is read
again, with its rest, by a later batch; however the bytes come, and wherever the stream is stopped and started again, the frames are the same. Long stretches are
read by several tasks, each of which begins at the first frame within its own. Files are only ever added to; those whose names begin with _ or . are left alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a task, and of one read.
STRETCH, BLOCK = 64 << 20, 1 << 20

_END = re.compile(rb"\r?\n\r?\n")


class _Stretch(InputPartition):
    """The frames that begin in [start, stop) of a file that is whole up to end."""

    def __init__(self, file: str, start: int, stop: int, end: int, first: bool):
        self.file, self.start, self.stop, self.end, self.first = file, start, stop, end, first


class EventStreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        fs, base = pafs.FileSystem.from_uri(self.path)
        for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            name = info.base_name
            if info.type == pafs.FileType.File and name[0] not in "_.":
                self.seen[name] = _whole(fs, f"{base}/{name}", self.seen.get(name, 0), info.size)
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        was, now = json.loads(start["files"]), json.loads(end["files"])
        self.seen = {n: max(now[n], self.seen.get(n, 0)) for n in now} | {n: v for n, v in self.seen.items() if n not in now}
        out: list[InputPartition] = []
        for name, stop in sorted(now.items()):
            begin = was.get(name, 0)
            out += [_Stretch(name, at, min(at + STRETCH, stop), stop, at == begin) for at in range(begin, stop, STRETCH)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        p = partition
        fs, base = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(f"{base}/{p.file}") as f:
            # a frame that begins in the stretch may begin right at it: the bytes before say so
            at = p.start if p.first else max(p.start - 4, 0)
            f.seek(at)
            data = b""
            if not p.first:
                while not (m := _END.search(data)) and f.tell() < p.end:
                    data += f.read(min(BLOCK, p.end - f.tell()))
                if not m:
                    return
                while m and at + m.end() < p.start:
                    m = _END.search(data, m.end())
                    while not m and f.tell() < p.end:
                        data += f.read(min(BLOCK, p.end - f.tell()))
                        m = _END.search(data)
                if not m:
                    return
                at, data = at + m.end(), data[m.end() :]
            while at < p.stop:
                m = _END.search(data)
                if not m:
                    if f.tell() >= p.end:
                        return
                    data += f.read(min(BLOCK, p.end - f.tell()))
                    continue
                if (frame := parsed(data[: m.start()].decode(errors="replace"))) is not None:
                    yield (p.file, at, *frame)
                at, data = at + m.end(), data[m.end() :]


def _whole(fs: pafs.FileSystem, path: str, known: int, size: int) -> int:
    """The end of the last whole frame, looked for from the file's end backwards."""
    with fs.open_input_file(path) as f:
        hi, tail = size, b""
        while hi > known:
            lo = max(known, hi - BLOCK)
            f.seek(lo)
            tail = f.read(hi - lo) + tail
            if found := list(_END.finditer(tail)):
                return lo + found[-1].end()
            hi = lo
    return known


def parsed(frame: str) -> tuple[str | None, str, str] | None:
    """id, event and data of a frame; None without data. Lines of data are joined, comments and other fields left out."""
    fields: dict[str, list[str]] = {}
    for line in frame.replace("\r\n", "\n").split("\n"):
        name, _, value = line.partition(":")
        fields.setdefault(name, []).append(value.removeprefix(" "))
    data = "\n".join(fields.get("data", []))
    return (fields.get("id", [None])[-1], fields.get("event", ["message"])[0], data) if data else None


class EventStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_stream"

    def schema(self) -> str:
        return "file string, at long, id string, event string, data string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return EventStreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventStreamSource)
