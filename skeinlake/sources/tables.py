"""Sources and sinks: JSON lines, whole JSON, Markdown bodies, event-stream frames, checkpointed and verified tables."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from skeinlake.operators.curation import latest


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if all run on this
    machine (tests), else an error: executors would write where the others can't read."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="skeinlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A place for a table of this application alone; all such tables go when the application ends."""
    home = f"{shared_dir(spark)}/skeinlake/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        fs, at = _files(spark, home)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _HOMES.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


_HOMES: set[str] = set()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing will read again; others stay as they are."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            fs, at = _files(df.sparkSession, path)
            fs.delete(at, True)


def running_total(rows: DataFrame, name: str, *order: Column, amount: Column | None = None) -> DataFrame:
    """rows, stored, with the sum of amount (1: their number) over all rows up to each in order, by ranges: what lies in a range is summed
    there, and ranges are summed by one row each, so that no task gets all rows. Rows that tie in order share a range."""
    part, own = f"__part_{name}", f"__own_{name}"
    keys = [f"__{name}_{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(keys, order, strict=True))).withColumn(own, F.lit(1).cast("long") if amount is None else amount)
    ranged = staged(keyed.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(part).agg(F.sum(own).alias(own))
    before = sums.select(part, (F.sum(own).over(Window.orderBy(part)) - F.col(own)).alias("__before"))  # one row for each range
    inside = F.sum(own).over(Window.partitionBy(part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    total = ranged.withColumn(name, inside).join(before, part).withColumn(name, F.col(name) + F.col("__before"))
    return total.drop(part, own, "__before", *keys)


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt to as many tasks as run at once, if its files make fewer: for small tables whose rows cost much to work on. A
    scan of many files stays as it is; other plans shouldn't come here, as asking for their partitions may run them."""
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(tasks) if scan._jdf.rdd().getNumPartitions() < tasks else scan


def read_jsonl(spark: SparkSession, path: str, schema: Ty.StructType | str) -> DataFrame:
    """One object a line; a line that is none ends the read with an error. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: Ty.StructType | str) -> DataFrame:
    """One object a line; lines that are none are skipped (a writer may still be at the last)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_or_empty(spark: SparkSession, path: str, schema: Ty.StructType) -> DataFrame:
    """A whole file's object; no row if the file is missing, damaged or not an object."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    sound = rows.where(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    return sound.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_list_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a state file, a JSON array of objects; none if the file is missing, damaged or anything else: state fails closed."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    sound = rows.where(F.ltrim("value").startswith("[") & F.try_parse_json("value").isNotNull())
    return sound.select(F.explode(F.from_json("value", f"array<struct<{schema.replace(' ', ':')}>>")).alias("r")).select("r.*")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, of folders below as well: path, body."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.try_url_decode(F.input_file_name()).alias("path"), F.col("value").alias("body"))


def with_bodies(manifest: DataFrame, bodies: DataFrame, root: str) -> DataFrame:
    """manifest (title, metadata: map, source_url, markdown_file) with content: the file's body, if its path stays under root, else
    the title, metadata and source as text."""
    inside = ~F.col("markdown_file").rlike(r"(^|/)\.\.(/|$)") & ~F.col("markdown_file").startswith("/")
    told = F.concat_ws("\n", "title", F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), F.when(F.col("source_url") != "", F.concat(F.lit("source: "), "source_url")))
    key = F.when(inside, F.concat(F.lit(root.rstrip("/") + "/"), "markdown_file"))
    return manifest.withColumn("path", key).join(bodies, "path", "left").withColumn("content", F.coalesce("body", told)).drop("body", "path")


def event_frames(text: DataFrame, column: str = "value", *keys: str) -> DataFrame:
    """keys, pos, event, data of each complete frame of an event stream's text: frames end at a blank line, data lines are joined; an
    unfinished rest is left out."""
    plain = F.replace(F.col(column), F.lit("\r\n"), F.lit("\n"))
    parts = F.split(plain, r"\n\n")
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    frames = text.select(*keys, F.posexplode(whole).alias("pos", "frame"))
    lines = F.split("frame", r"\n")
    of = lambda name: F.transform(F.filter(lines, lambda s: s.startswith(f"{name}:")), lambda s: F.regexp_replace(s, f"^{name}: ?", ""))
    return frames.select(*keys, "pos", F.coalesce(F.get(of("event"), F.lit(0)), F.lit("message")).alias("event"), F.array_join(of("data"), "\n").alias("data")).where("data <> ''")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with new rows in place of those of the same key."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, key, F.desc("__new")).drop("__new")


def write_verified(df: DataFrame, path: str, partition_by: str | None = None) -> int:
    """Replaces the table at path: writes beside it, counts what can be read back, and only then switches names. Raises if rows are
    missing; until the switch, and if it fails, the old table stays. df may read the old one."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    new = f"{path.rstrip('/')}.writing-{mark}"
    writer = counted.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(new)
    expected, got = seen.get["n"], spark.read.schema(df.schema).parquet(new).count()
    if expected != got:
        raise ValueError(f"{path} would have {got} rows of {expected}")
    replace_path(spark, new, path)
    return got


def replace_path(spark: SparkSession, new: str, path: str) -> None:
    """Gives a written file or folder its name; what had it before goes after that, or has it again if the renaming fails."""
    fs, target = _files(spark, path)
    _, source = _files(spark, new)
    _, old = _files(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} can't be set aside")
    if not fs.rename(source, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{new} can't be renamed to {path}")
    if had:
        fs.delete(old, True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A file of text (UTF-8) from the driver, by a file beside it that then gets its name."""
    new = f"{path}.writing-{uuid.uuid4().hex}"
    fs, at = _files(spark, new)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    replace_path(spark, new, path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as JSON that people read: two blanks of indentation, other letters as they are, a line end behind."""
    write_text(spark, json.dumps(report, ensure_ascii=False, indent=2) + "\n", path)


def save_records(records: DataFrame, root: str, name: str = "name", text: str = "text", raw: str = "raw") -> DataFrame:
    """Saves each record's text as root/markdown/<name>.md and its raw JSON as root/raw/<name>.json (null: none), files of tasks, each
    under its name only once it is whole. Returns the manifest: name, markdown_file, raw_file, chars, sha256. Names are relative
    paths; one that leaves the root is an error. Of records that share a name the last one written stays."""
    rows = records.select(F.col(name).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(raw).alias("raw"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)

        def put(path: str, data: bytes) -> str:
            at = f"{base}/{path}"
            fs.create_dir(at.rpartition("/")[0])
            beside = f"{at}.{uuid.uuid4().hex}"
            with fs.open_output_stream(beside) as out:
                out.write(data)
            fs.move(beside, at)
            return path

        for batch in batches:
            made = []
            for n, t, r in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if n.startswith("/") or ".." in n.split("/"):
                    raise ValueError(f"{n} leaves the folder")
                data = t.encode()
                made.append((n, put(f"markdown/{n}.md", data), None if r is None else put(f"raw/{n}.json", r.encode()), len(t), hashlib.sha256(data).hexdigest()))
            columns = list(zip(*made, strict=True)) if made else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "markdown_file", "raw_file", "chars", "sha256"])

    return staged(rows.mapInArrow(save, "name string, markdown_file string, raw_file string, chars long, sha256 string"), "records")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
