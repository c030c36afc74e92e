"""Answers of a provider that is slow or costs money, asked once for each text: kept by a hash of model and text, resumed where a run stopped.

Each call's answers are a file of its own as soon as the provider has given them, so that a run that dies loses the calls under way alone. Files of
calls are folded into a table by hash before the next run and after each, whichever comes first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.sources.commits import Table
from skeinlake.sources.tables import _files

_SCHEMA = pa.schema([("hash", pa.string()), ("embedding", pa.list_(pa.float64()))])


class Answers:
    """The store at a path: a URI that executors can write to."""

    def __init__(self, spark: SparkSession, path: str, model: str, buckets: int = 16):
        self.spark, self.path, self.model, self.buckets = spark, path.rstrip("/"), model, buckets
        self.table = Table(spark, f"{self.path}/table")

    def hash(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.model}\x00"), F.coalesce(text, F.lit(""))), 256)

    def known(self) -> DataFrame:
        if self.table.snapshot().version < 0:
            return self.spark.createDataFrame([], "hash string, embedding array<double>")
        return self.table.read().select("hash", "embedding")

    def fold(self) -> None:
        """Files of calls become rows of the table; they go only once it is committed."""
        fs, at = _files(self.spark, f"{self.path}/calls")
        files = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")] if fs.exists(at) else []
        if files:
            calls = self.spark.read.schema("hash string, embedding array<double>").parquet(*[f.toString() for f in files])
            self.table.upsert(calls, "hash", self.buckets)
            for f in files:
                fs.delete(f, False)

    def embedded(self, rows: DataFrame, provider: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 96) -> DataFrame:
        """rows with embedding. Equal texts are asked for once, texts with an answer not at all; null texts are empty."""
        self.fold()
        path, kinds = f"{self.path}/calls", _SCHEMA

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = pafs.FileSystem.from_uri(path)
            fs.create_dir(base)
            for b in batches:
                for at in range(0, b.num_rows, batch):
                    some = b.slice(at, batch)
                    vectors = provider(some.column("text").to_pylist())
                    if len(vectors) != some.num_rows:
                        raise ValueError(f"{len(vectors)} vectors for {some.num_rows} texts")
                    name = uuid.uuid4().hex
                    pq.write_table(pa.table([some.column("hash"), pa.array(vectors, kinds.field("embedding").type)], schema=kinds), f"{base}/.{name}", filesystem=fs)
                    fs.move(f"{base}/.{name}", f"{base}/{name}.parquet")
                    yield pa.record_batch({"n": pa.array([some.num_rows], pa.int64())})

        own = F.coalesce(F.col(text), F.lit(""))
        asked = rows.select(self.hash(own).alias("hash"), own.alias("text")).dropDuplicates(["hash"])
        asked.join(self.known().select("hash"), "hash", "left_anti").mapInArrow(run, "n long").agg(F.sum("n")).collect()
        self.fold()
        return rows.withColumn("__hash", self.hash(own)).join(self.known().withColumnRenamed("hash", "__hash"), "__hash").drop("__hash")
