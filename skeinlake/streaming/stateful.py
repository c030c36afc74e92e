"""Structured Streaming twins of the keyed folds, and the batch plans they equal.

Progress of a session: a start opens a generation; events of an older generation are fenced off; sequence numbers count up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinlake.operators.learner import GUESS, LEARN, PRIOR, SCORES, SLIP
from skeinlake.sources.tables import fresh_path


def progress(events: DataFrame) -> DataFrame:
    """events (session_id, ts, seq, action: start, update, complete or fail; generation: what the sender believes, null: whatever holds)
    with generation, sequence and accepted."""
    w = Window.partitionBy("session_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    now = F.sum((F.col("action") == "start").cast("long")).over(w)
    fenced = events.withColumn("current", now).withColumn("accepted", F.col("generation").isNull() | (F.col("action") == "start") | (F.col("generation") == F.col("current")))
    each = Window.partitionBy("session_id", "current").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return fenced.withColumn("sequence", F.when(F.col("accepted"), F.sum(F.col("accepted").cast("long")).over(each)))


def latest_progress(events: DataFrame) -> DataFrame:
    """session_id, generation, sequence, state after all events."""
    good = progress(events).where("accepted")
    last = good.groupBy("session_id").agg(F.max_by(F.struct("current", "sequence", "action"), F.struct("ts", "seq")).alias("s"))
    state = F.when(F.col("s.action") == "complete", "completed").when(F.col("s.action") == "fail", "failed").otherwise("active")
    return last.select("session_id", F.col("s.current").alias("generation"), F.col("s.sequence").alias("sequence"), state.alias("state"))


def increasing(events: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    """Events whose value exceeds all before it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(value).over(w)
    return events.withColumn("__b", before).where(F.col("__b").isNull() | (F.col(value) > F.col("__b"))).drop("__b")


def most_recent(events: DataFrame, key: str, capacity: int, *order: str) -> DataFrame:
    """The `capacity` keys touched last: key, last (struct of order)."""
    last = events.groupBy(key).agg(F.max(F.struct(*order)).alias("last"))
    return last.orderBy(F.desc("last"), key).limit(capacity)


def alive(events: DataFrame, key: str, ttl_seconds: int, as_of) -> DataFrame:
    """The last event of each key, unless its time to live is over (or was never positive)."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    last = events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return last.where((F.lit(ttl_seconds) > 0) & (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)) > as_of))


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into a Parquet sink in the shared folder, and returns the sink's rows. The sink's log
    and the checkpoint make each input count once, however often the stream is resumed."""
    path = fresh_path(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def stream_progress(events: DataFrame) -> DataFrame:
    """The streaming twin of progress: emits session_id, generation, sequence, action of each accepted event. Rows of a batch are
    folded in order of (ts, seq)."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, sequence = state.get if state.exists else (0, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples(index=False):
            if r.action == "start":
                generation, sequence = generation + 1, 1
            elif pd.isna(r.generation) or int(r.generation) == generation:
                sequence += 1
            else:
                continue
            out.append((key[0], generation, sequence, r.action, r.seq))
        state.update((generation, sequence))
        yield pd.DataFrame(out, columns=["session_id", "generation", "sequence", "action", "seq"])

    return events.groupBy("session_id").applyInPandasWithState(fold, "session_id long, generation long, sequence long, action string, seq long", "generation long, sequence long", "append", GroupStateTimeout.NoTimeout)


def stream_mastery(observations: DataFrame) -> DataFrame:
    """The streaming twin of the mastery fold: emits each key's mastery after each batch that touches it. A user's concepts are one state, as what a
    group costs besides its rows is most of the time of small ones."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {c: (m, n) for c, m, n in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        touched = {}
        for concept, outcome in zip(rows["concept"].tolist(), rows["outcome"].tolist(), strict=True):
            mastery, n = held.get(concept, (PRIOR, 0))
            if outcome != "reviewed":
                s = SCORES[outcome]
                right = mastery * (1 - SLIP) / max(mastery * (1 - SLIP) + (1 - mastery) * GUESS, 1e-9)
                wrong = mastery * SLIP / max(mastery * SLIP + (1 - mastery) * (1 - GUESS), 1e-9)
                blend = s * right + (1 - s) * wrong
                mastery, n = max(0.01, min(0.995, blend + (1 - blend) * LEARN)), n + 1
            held[concept] = touched[concept] = (mastery, n)
        state.update((list(held), [m for m, _ in held.values()], [n for _, n in held.values()]))
        yield pd.DataFrame([(key[0], c, n, m) for c, (m, n) in touched.items()], columns=["user_id", "concept", "n", "mastery"])

    return observations.groupBy("user_id").applyInPandasWithState(fold, "user_id long, concept string, n long, mastery double", "concepts array<string>, mastery array<double>, n array<long>", "append", GroupStateTimeout.NoTimeout)


def stream_memory(updates: DataFrame) -> DataFrame:
    """The streaming twin of the memory fold: emits each memory's importance and latest time after each batch."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        importance, seq = state.get if state.exists else (0.0, -1)
        f = pd.concat(list(frames))
        importance, seq = max(importance, float(f["importance"].max())), max(seq, int(f["seq"].max()))
        state.update((importance, seq))
        yield pd.DataFrame([(*key, importance, seq)], columns=["session_id", "kind", "norm", "importance", "last_seq"])

    good = updates.where("importance >= 0.55")
    return good.groupBy("session_id", "kind", "norm").applyInPandasWithState(fold, "session_id long, kind string, norm string, importance double, last_seq long", "importance double, seq long", "append", GroupStateTimeout.NoTimeout)


def incremental_index(stream: DataFrame, key: str, make, name: str) -> DataFrame:
    """An index table kept by a stream: each batch's rows, less the keys already there, go through make and are appended under the
    batch's number, so that a batch that runs again replaces its own rows."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    columns = make(spark.createDataFrame([], stream.schema)).schema

    def batch(rows: DataFrame, number: int) -> None:
        there = spark.read.schema(columns).option("recursiveFileLookup", True).parquet(f"{path}/data") if number else None
        new = rows.dropDuplicates([key])
        if there is not None:
            new = new.join(there.select(key), key, "left_anti")
        make(new).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(columns).option("recursiveFileLookup", True).parquet(f"{path}/data")
