"""Tables of immutable files behind a log of commits.

A commit is one small file of the log, put under its version's name only if no other has it: writers that meet lose, and begin again from what the winner left.
It lists the files that come and go; every tenth lists all, so that readers begin there. A reader takes the files of one version
and sees all of it or nothing, however many commits follow meanwhile. Files that no commit names (of writers that died) are never read.

The file system must be able to rename without overwriting in one step (HDFS and its like; local ones by a hard link).
Several kinds of rows may share a log, and change by one commit. Files lie in data/part=<of the commit>/kind=<kind>/bucket=<n>.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .tables import _files, staged

#: A commit of a version that this divides lists all files.
EVERY = 10


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Snapshot:
    """What a version holds: paths under the table's data folder, the schema of each kind (as JSON), and what writers noted. Version -1: nothing."""

    version: int = -1
    files: frozenset[str] = frozenset()
    schemas: dict[str, dict] = field(default_factory=dict)
    info: dict = field(default_factory=dict)

    def of(self, kind: str, buckets: set[int] | None = None) -> list[str]:
        """The files of a kind, of some buckets if they are given, in order."""
        return sorted(f for f in self.files if f"/kind={kind}/" in f and (buckets is None or bucket_of(f) in buckets))


def bucket_of(file: str) -> int:
    return int(re.search(r"/bucket=(\d+)/", file)[1])


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Reading

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an older one. An error if that isn't there."""
        fs, at = _files(self.spark, f"{self.path}/_log")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        known = sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{20}\.json", n))
        if version is not None and version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        known = [v for v in known if version is None or v <= version]
        entries = []
        for v in reversed(known):
            entries.append(json.loads(self._text(f"_log/{v:020d}.json")))
            if entries[-1]["all"]:
                break
        files: set[str] = set()
        for e in reversed(entries):
            files = (files - set(e["remove"])) | set(e["add"])
        return Snapshot(known[-1], frozenset(files), entries[0]["schemas"], entries[0]["info"]) if entries else Snapshot()

    def read(self, kind: str = "rows", at: Snapshot | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a kind, with part and bucket of each: of the newest version, or of a snapshot."""
        at = self.snapshot() if at is None else at
        own = Ty.StructType.fromJson(at.schemas[kind])
        schema = Ty.StructType([*own.fields, Ty.StructField("part", Ty.StringType()), Ty.StructField("kind", Ty.StringType()), Ty.StructField("bucket", Ty.IntegerType())])
        files = [f"{self.path}/data/{f}" for f in at.of(kind, buckets)]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*files) if files else self.spark.createDataFrame([], schema)
        return rows.drop("kind")

    # Writing

    def part(self, base: Snapshot) -> str:
        """A name for what a commit upon base adds; names of later versions are greater."""
        return f"{base.version + 1:012d}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, part: str, kind: str = "rows", bucket: Column | None = None, deal: bool = True, order: tuple[str, ...] = ()) -> list[str]:
        """Files with the rows of df, each bucket's apart, counted as they are read back; no reader sees them before a commit names them. deal: a
        task for each bucket; else each task writes what it has. order: of the rows in each file."""
        seen = Observation()
        rows = df.withColumn("bucket", F.lit(0) if bucket is None else bucket)
        rows = rows.repartition("bucket") if deal and bucket is not None else rows
        at = f"{self.path}/data/part={part}/kind={kind}"
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        rows = rows.sortWithinPartitions("bucket", *order) if order else rows  # last, so that the writer doesn't sort once more
        rows.write.partitionBy("bucket").parquet(at)
        files = self._written(at)
        expected = seen.get["n"]
        got = self.spark.read.schema(df.schema).parquet(*[f"{self.path}/data/{f}" for f in files]).count() if files else 0
        if got != expected:
            raise ValueError(f"{at} has {got} rows of {expected}")
        return files

    def commit(self, base: Snapshot, add: list[str], remove: list[str], schemas: dict[str, Ty.StructType], info: dict | None = None) -> Snapshot:
        """The version after base. Conflict, if another writer was first."""
        version = base.version + 1
        files = frozenset((base.files - set(remove)) | set(add))
        kinds = base.schemas | {k: json.loads(s.json()) for k, s in schemas.items()}
        noted = base.info | (info or {})
        whole = version % EVERY == 0
        entry = {"all": whole, "add": sorted(files) if whole else sorted(add), "remove": [] if whole else sorted(remove), "schemas": kinds, "info": noted}
        self._put(f"_log/{version:020d}.json", json.dumps(entry))
        return Snapshot(version, files, kinds, noted)

    def change(self, make: Callable[[Snapshot, str], tuple[list[str], list[str], dict[str, Ty.StructType], dict]], attempts: int = 20) -> Snapshot:
        """Commits what make(snapshot, part) says: files that come and go, schemas, notes. Again from the newest version after a conflict."""
        for _ in range(attempts):
            base = self.snapshot()
            part = self.part(base)
            try:
                return self.commit(base, *make(base, part))
            except Conflict:
                self._drop(f"data/part={part}")
        raise Conflict(f"{self.path}: {attempts} attempts met other writers")

    def replace(self, df: DataFrame, bucket: Column | None = None) -> int:
        """df in place of all rows; df may read the table. Returns the number of rows."""
        rows = staged(df, "replace")
        self.change(lambda base, part: (self.write(rows, part, bucket=bucket), base.of("rows"), {"rows": df.schema}, {}))
        return self.spark.read.parquet(rows._staged_at).count()

    def upsert(self, new: DataFrame, key: str, buckets: int = 64) -> Snapshot:
        """new rows in place of those of the same key: only the files of the buckets that new rows fall into are written anew. The number of buckets is
        the table's from its first upsert on. Of new rows that share a key one stays; rows without a key are kept each."""
        return self._rewrite(new, key, buckets, True)

    def delete(self, keys: DataFrame, key: str, buckets: int = 64) -> Snapshot:
        """Without the rows of these keys."""
        return self._rewrite(keys, key, buckets, False)

    def _rewrite(self, given: DataFrame, key: str, buckets: int, put: bool) -> Snapshot:
        rows = staged(given, "changes")

        def make(base: Snapshot, part: str):
            n = base.info.get("buckets", buckets)
            if base.version >= 0 and "buckets" not in base.info:
                raise ValueError(f"{self.path} isn't in buckets by key")
            own = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
            touched = {r[0] for r in rows.select(own.alias("b")).distinct().collect()}  # n at most
            old = base.of("rows", touched)
            named = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(rows.where(F.col(key).isNull()))
            kept = self.read(at=base, buckets=touched).drop("part", "bucket").join(named.select(key), key, "left_anti") if old else None
            schema = rows.schema if put else Ty.StructType.fromJson(base.schemas["rows"])
            out = kept if not put else named if kept is None else kept.unionByName(named)
            return (self.write(out, part, bucket=own) if out is not None else []), old, {"rows": schema}, {"buckets": n}

        return self.change(make)

    def vacuum(self, versions: int = 2, older: float = 3600) -> int:
        """Deletes data files that none of the last versions names and that are older than so many seconds (younger ones may be of a writer that is still at
        it), and entries that none of them needs. Returns how many data files went."""
        fs, at = _files(self.spark, f"{self.path}/data")
        if not fs.exists(at):
            return 0
        newest = self.snapshot().version
        kept = set().union(*[self.snapshot(v).files for v in range(max(0, newest - versions + 1), newest + 1)])
        now, gone = self.spark._jvm.java.lang.System.currentTimeMillis(), 0
        for f in self._written(f"{self.path}/data"):
            _, file = _files(self.spark, f"{self.path}/data/{f}")
            if f not in kept and now - fs.getFileStatus(file).getModificationTime() >= older * 1000:
                gone += bool(fs.delete(file, False))
        first = (newest - versions + 1) // EVERY * EVERY
        for v in range(first - 1, -1, -1):
            _, entry = _files(self.spark, f"{self.path}/_log/{v:020d}.json")
            if not fs.delete(entry, False):
                break
        return gone

    # Files

    def _written(self, at: str) -> list[str]:
        """Data files below a folder, as paths under the data folder."""
        fs, folder = _files(self.spark, at)
        root = fs.makeQualified(_files(self.spark, f"{self.path}/data")[1]).toString().rstrip("/") + "/"
        found, out = fs.listFiles(folder, True), []
        while found.hasNext():
            name = found.next().getPath().toString()
            if name.endswith(".parquet"):
                out.append(name.removeprefix(root))
        return sorted(out)

    def _text(self, name: str) -> str:
        fs, at = _files(self.spark, f"{self.path}/{name}")
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _drop(self, name: str) -> None:
        fs, at = _files(self.spark, f"{self.path}/{name}")
        fs.delete(at, True)

    def _put(self, name: str, text: str) -> None:
        """A whole file under a name that none has yet. Conflict, if one has."""
        fs, at = _files(self.spark, f"{self.path}/{name}")
        _, beside = _files(self.spark, f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = fs.create(beside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        try:
            if fs.makeQualified(at).toUri().getScheme() == "file":
                path = lambda p: jvm.java.nio.file.Path.of(fs.makeQualified(p).toUri())
                jvm.java.nio.file.Files.createLink(path(at), path(beside))
            else:
                rename = jvm.org.apache.hadoop.fs.Options.Rename
                how = self.spark.sparkContext._gateway.new_array(rename, 1)
                how[0] = rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, at, how)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise Conflict(f"{self.path}/{name} is there already") from None
            raise
        finally:
            fs.delete(beside, False)
