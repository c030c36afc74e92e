"""Token-ID / binary output: Arrow files of fixed-size-list batches, for zero-copy random access to equal-length sequences and masks.

Documents in ascending order of their key are range-partitioned, into as many partitions as their texts' bytes ask for; each writes
one Arrow file whose record batches hold the same number of sequences (the last may hold fewer). A sequence is a fixed-size list of `length` ids, its mask a
fixed-size list of as many booleans; only a file's last sequence is padded. Beside it lies a small Arrow file of the
documents in it: key, first id, number of ids. Both are written batch by batch: a task holds a record batch, whatever its partition. Sequence k of a file is row k % rows of batch k // rows: a reader maps the
file and takes views, without decoding.

Defined results: null text is an empty text (the end id alone); a null key sorts first; rows with equal keys are ordered by
their text's first letters (`TIE`) and all kept, however many: they may fill many files, and within one they are in order of
their whole texts; a very long text is encoded whole, and may cross record batches; an empty table writes no files and reads back no rows; columns beside key and text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, plain_text, slices, staged, texts_sizes
from .tokens import KEEP, encoder


#: Bytes of text to a file, and the letters of a text that order rows of one key.
FILE_BYTES, TIE = 256 << 20, 16


@dataclass(frozen=True)
class Layout:
    """length: ids in a sequence; rows: sequences in a record batch; end_id: what follows each document."""

    length: int = 1024
    rows: int = 256
    end_id: int = 2


def _open(path: str):
    """A file system and a path on it; any that pyarrow knows by the scheme (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(path)


class _Writer:
    def __init__(self, path: str, dtype: np.dtype, layout: Layout, key: pa.DataType):
        self.uri = path
        self.fs, self.path = _open(path)
        self.fs.create_dir(self.path.rpartition("/")[0])
        self.layout, self.dtype = layout, dtype
        kind = pa.from_numpy_dtype(dtype.newbyteorder("="))
        self.schema = pa.schema([("ids", pa.list_(kind, layout.length)), ("mask", pa.list_(pa.bool_(), layout.length))])
        self.stream = self.fs.open_output_stream(f"{self.path}.writing")
        self.sink = pa.ipc.new_file(self.stream, self.schema)
        self.index_stream = self.fs.open_output_stream(f"{self.path}.docs")
        self.index_schema = pa.schema([("key", key), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.index = pa.ipc.new_file(self.index_stream, self.index_schema)
        self.waiting: list[bytes] = []
        self.held = self.total = self.docs = 0

    def add(self, keys: pa.Array, documents: Iterator[bytes]) -> None:
        """Documents' ids, and their keys."""
        starts, sizes = [], []
        for ids in documents:
            n = len(ids) // self.dtype.itemsize
            starts.append(self.total)
            sizes.append(n)
            self.waiting.append(ids)
            self.held += n
            self.total += n
            if self.held >= self.layout.length * self.layout.rows:
                self._flush(whole=True)
        self.index.write_batch(pa.record_batch([keys, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=self.index_schema))
        self.docs += len(sizes)

    def _flush(self, whole: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.dtype)
        size = self.layout.length * self.layout.rows
        stop = len(ids) // size * size if whole else len(ids)
        for at in range(0, stop, size):
            some = ids[at : min(at + size, stop)]
            rows = -(-len(some) // self.layout.length)
            padded = np.zeros(rows * self.layout.length, some.dtype)
            padded[: len(some)] = some
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.layout.length) for x in (padded, np.arange(len(padded)) < len(some))]
            self.sink.write_batch(pa.record_batch(lists, schema=self.schema))
        self.waiting, self.held = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        """The ids' file gets its name last, so that whoever sees it finds both."""
        self._flush(whole=False)
        for sink in (self.index, self.index_stream, self.sink, self.stream):
            sink.close()
        self.fs.move(f"{self.path}.writing", self.path)


def write_token_files(docs: DataFrame, tokenizer_file: str, layout: Layout = Layout(), key: str = "doc_id", text: str = "text", folder: str | None = None, files: int | None = None) -> DataFrame:
    """Writes the files under folder (by default in the shared folder, until the application ends) and returns their manifest, a row for each file:
    part, file, first (ids in all files before it), n_tokens, n_docs. A task that runs again writes files of new names; the
    manifest lists those of the attempts that counted. files: the number of range partitions (by default one for each
    `FILE_BYTES` of text, and at least Spark's number of shuffle partitions)."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    rows = plain_text(docs, key, text=text).withColumnRenamed(key, "key")
    if files is None:
        told = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-told // FILE_BYTES))
    # Rows of one key go to several partitions by what their texts begin with, and equal rows by where they stand.
    rows = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(files, "key", F.left("text", F.lit(TIE)), "at")
    rows = rows.sortWithinPartitions("key", "text").select("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sink = encoder(tokenizer_file, KEEP), None
        part = TaskContext.get().partitionId()
        end = np.array([layout.end_id], tokens.dtype).tobytes()
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("key")
            for a, b in slices(texts_sizes(texts)):
                sink = sink or _Writer(f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.arrow", tokens.dtype, layout, keys.type)
                sink.add(keys.slice(a, b - a), (tokens.encode(x) + end for x in texts.slice(a, b - a).to_pylist()))
        if sink:
            sink.close()
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "file": [sink.uri], "n_tokens": pa.array([sink.total], pa.int64()), "n_docs": pa.array([sink.docs], pa.int64())})

    found = staged(rows.mapInArrow(write, "part int, file string, n_tokens long, n_docs long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return found.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class TokenFile:
    """Random access to one file: sequence(k) and mask(k) are views of the mapped file."""

    def __init__(self, path: str):
        fs, at = _open(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        with (pa.memory_map(f"{at}.docs") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(f"{at}.docs")) as f:
            self.docs = pa.ipc.open_file(f).read_all()
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def batch_ids(self, i: int) -> np.ndarray:
        """All ids of a record batch, padding included, without a copy."""
        return self.reader.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> np.ndarray:
        return self.batch_ids(k // self.rows)[k % self.rows * self.length :][: self.length]

    def mask(self, k: int) -> pa.Array:
        return self.reader.get_batch(k // self.rows).column(1)[k % self.rows].values

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start on, as views of one batch after the other."""
        size = self.rows * self.length
        while n:
            part = self.batch_ids(start // size)[start % size :][:n]
            yield part
            start, n = start + len(part), n - len(part)


def read_documents(manifest: DataFrame, key_type: str = "long") -> DataFrame:
    """Reads the files back: key, start (ids of all documents before it), n_tokens, ids_crc32 (of ids as 32-bit little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                file = TokenFile(path)
                for docs in file.docs.to_batches(max_chunksize=10_000):
                    crcs = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for part in file.span(start, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        crcs.append(crc)
                    yield pa.record_batch({"key": docs.column("key"), "start": pa.array(np.asarray(docs.column("start")) + first), "n_tokens": docs.column("n_tokens"), "ids_crc32": pa.array(crcs, pa.int64())})

    some = manifest.select("file", "first")
    return some.repartition(max(1, manifest.count()), "file").mapInArrow(read, f"key {key_type}, start long, n_tokens long, ids_crc32 long")
