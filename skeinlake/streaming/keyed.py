"""Keyed state on running streams: memories with a reset, expiry by timers, context folds behind a watermark, streams that replace and cancel
one another, and the keys touched last over all keys.

The first four are processors of transformWithState: state lies in the state store by key, and each batch touches the keys it has rows of
and those whose timers are due. Each result equals a batch plan over the rows so far, however they are cut into batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skeinlake.functions import text as T
from skeinlake.operators.sessions import LEAST_IMPORTANCE, PROMPT, context_step, normalised
from skeinlake.sources.commits import Table

from .stateful import finished

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession):
    """The state store that processors need, for queries that start meanwhile."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was) if was else spark.conf.unset(_PROVIDER)


def run(stream: DataFrame, name: str) -> DataFrame:
    """The stream over what is there now; the rows that it put out."""
    with rocks(stream.sparkSession):
        return finished(stream, name)


def _due(ts) -> int:
    """The first millisecond that isn't before ts: the time of a timer."""
    return -(-pd.Timestamp(ts).value // 1_000_000)


class _InOrder(StatefulProcessor):
    """Rows that begin with ts and seq wait in the state until the watermark has passed them, and are then folded in that order."""

    waits = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)

    def fold(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).astype(object)
        frame = frame.drop(columns=frame.columns[: len(key)])
        self.waiting.appendList([tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)])
        for due in {_due(ts) for ts in frame["ts"]}:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (pd.Timestamp(r[0]).value, r[1], *map(str, r[2:])))
        ready = [r for r in rows if _due(r[0]) <= now]
        if not ready:  # an earlier timer of this batch has taken them
            return
        if rest := rows[len(ready) :]:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield self.fold(key, ready)


# Memories


class _Memories(_InOrder):
    waits = "ts timestamp, seq long, kind string, norm string, content string, importance double, good boolean, reset boolean"

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.step = handle.getValueState("step", "step long")
        self.held = handle.getMapState("held", "kind string, norm string", "content string, importance double, created timestamp, updated timestamp")

    def fold(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        for ts, _, kind, norm, content, importance, good, reset in rows:
            if reset:
                self.held.clear()
            if good:
                was = self.held.getValue((kind, norm)) or (content, importance, ts, ts)
                self.held.updateValue((kind, norm), (was[0], max(was[1], importance), min(was[2], ts), max(was[3], ts)))
        step = (self.step.get()[0] if self.step.exists() else 0) + 1
        self.step.update((step,))
        found = sorted(((-v[1], -pd.Timestamp(v[3]).value, k[1], k[0], v) for k, v in self.held.iterator()), key=lambda m: m[:4])
        out = []
        for place, (_, _, norm, kind, v) in enumerate(found[: self.cap]):
            ident = "mem_" + sha256(":".join(map(str, (*key, kind, norm))).encode()).hexdigest()[:20]
            out.append((*key, step, place + 1, ident, kind, *v))
        out = out or [(*key, step, 0, *[None] * 6)]  # a reset may leave nothing: that is news too
        return pd.DataFrame(out, columns=["user_id", "session_id", "step", "place", "memory_id", "kind", "content", "importance", "created_at", "updated_at"])


def memories(updates: DataFrame, cap: int = 300, late: str = "0 seconds") -> DataFrame:
    """Of a stream of updates (user_id, session_id, seq, kind, content, importance, ts; reset: a scope begins anew with this one) all memories of
    each scope after every batch that changes it (step), the `cap` most important ones: what memory() makes of the updates since the last
    reset. Updates in any order within `late` wait for the watermark."""
    content = T.strip(F.col("content"))
    good = F.coalesce((F.col("importance") >= LEAST_IMPORTANCE) & (content != ""), F.lit(False))
    rows = updates.select("user_id", "session_id", "ts", F.col("seq").cast("long").alias("seq"), "kind", normalised(F.col("content")).alias("norm"), content.alias("content"), "importance", good.alias("good"), F.coalesce("reset", F.lit(False)).alias("reset"))
    schema = "user_id long, session_id long, step long, place long, memory_id string, kind string, content string, importance double, created_at timestamp, updated_at timestamp"
    return rows.withWatermark("ts", late).groupBy("user_id", "session_id").transformWithStateInPandas(_Memories(cap), schema, "append", "eventTime")


# Expiry


class _Expiry(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"])
        ts, seq = frame["ts"].iloc[-1], int(frame["seq"].iloc[-1])
        if self.last.exists():
            was = self.last.get()
            if (pd.Timestamp(was[0]), was[1]) >= (ts, seq):
                return
            self.handle.deleteTimer(self._due(was[0]))
        due = self._due(ts)
        if self.ttl <= 0 or due <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()  # what was set before is no younger
            return
        self.last.update((ts, seq))
        self.handle.registerTimer(due)
        yield self._row(key, ts, seq, "set")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, seq = self.last.get()
        self.last.clear()
        yield self._row(key, ts, seq, "removed")

    def _due(self, ts) -> int:
        return _due(ts) + self.ttl

    def _row(self, key, ts, seq: int, what: str) -> pd.DataFrame:
        return pd.DataFrame([(*key, ts, seq, what)], columns=["key", "ts", "seq", "what"])


def expiring(events: DataFrame, key: str, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Of a stream of events (key, ts, seq) what is set and what is removed: key, ts, seq, what. An event is set in place of an older one of its key, and removed once the
    watermark reaches its time and time to live: what is then set is what alive() has at the watermark."""
    rows = events.select(F.col(key).cast("long").alias("key"), "ts", F.col("seq").cast("long").alias("seq")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Expiry(ttl_seconds * 1000), "key long, ts timestamp, seq long, what string", "append", "eventTime")


# Context


class _Context(_InOrder):
    waits = "ts timestamp, seq long, role string, tokens long"

    def __init__(self, safe: int, summary_tokens: int, base: int):
        self.fixed = (safe, summary_tokens, base)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "held long, checkpoint long, n long")

    def fold(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        state = tuple(self.state.get()) if self.state.exists() else (0, 0, 0)
        out = []
        for _, seq, role, tokens in rows:
            state, did = context_step(state, role, tokens, *self.fixed)
            out.append((*key, seq, self.fixed[2] + state[0], state[1], did))
        self.state.update(state)
        return pd.DataFrame(out, columns=["session_id", "seq", "context_tokens", "checkpoint", "compacted"])


def still_set(changes: DataFrame) -> DataFrame:
    """key, seq: what is set after all changes that expiring() has put out."""
    last = changes.groupBy("key").agg(F.max(F.struct("ts", "seq", (F.col("what") == "removed").alias("gone"))).alias("s"))
    return last.where("NOT s.gone").select("key", "s.seq")


def contexts(messages: DataFrame, safe: int, summary_tokens: int = 200, base: int = PROMPT, late: str = "0 seconds") -> DataFrame:
    """compaction() of a stream of messages (session_id, ts, seq, role, tokens): those that come in any order within `late` wait for the watermark,
    and are folded in order of (ts, seq) into what is kept of their session: tokens held, the checkpoint, the number of messages."""
    rows = messages.select(F.col("session_id").cast("long").alias("session_id"), "ts", F.col("seq").cast("long").alias("seq"), "role", F.col("tokens").cast("long").alias("tokens")).withWatermark("ts", late)
    schema = "session_id long, seq long, context_tokens long, checkpoint long, compacted string"
    return rows.groupBy("session_id").transformWithStateInPandas(_Context(safe, summary_tokens, base), schema, "append", "eventTime")


# Streams that replace and cancel one another


class _Streams(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "ts timestamp, stream long")
        # One value for all streams of a key, as each call to the store costs more than a row; not ended: cancelled before it began. due: of their timers.
        self.over = handle.getValueState("over", "streams array<long>, ended array<boolean>, due array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        active = tuple(self.active.get()) if self.active.exists() else None
        frame = pd.concat(list(rows))
        newest = frame["ts"].max()
        known = self._known()
        over, ended = {s: done for s, (done, _) in known.items()}, []

        def end(stream: int) -> None:
            if not over.get(stream):
                over[stream] = True
                ended.append(stream)

        for r in frame.itertuples(index=False):
            stream = int(r.stream)
            if r.cancels:
                if active and active[1] == stream:
                    end(stream)  # it stays as the newest: an older start that comes late is replaced all the same
                else:
                    over.setdefault(stream, False)
                continue
            if over.get(stream) or active and active[1] == stream:
                continue
            if over.get(stream) is False:
                end(stream)
            if active is None or (pd.Timestamp(active[0]), active[1]) < (r.ts, stream):
                if active:
                    end(active[1])
                active = (r.ts, stream)
            else:
                end(stream)
        if active:
            self.active.update(active)
        changed = {s: (done, _due(newest)) for s, done in over.items() if s not in known or known[s][0] != done}
        if changed:
            self._keep(known | changed)
            self.handle.registerTimer(_due(newest))
        yield pd.DataFrame([(*key, s) for s in ended], columns=["key", "stream"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self.active.get()[1] if self.active.exists() else None
        now = timerValues.getCurrentWatermarkInMs()
        self._keep({s: v for s, v in self._known().items() if v[1] > now or s == newest})
        return iter(())

    def _known(self) -> dict[int, tuple[bool, int]]:
        return {s: (done, due) for s, done, due in zip(*self.over.get(), strict=True)} if self.over.exists() else {}

    def _keep(self, over: dict[int, tuple[bool, int]]) -> None:
        if over:
            self.over.update((list(over), [done for done, _ in over.values()], [due for _, due in over.values()]))
        else:
            self.over.clear()


def ended_streams(starts: DataFrame, cancels: DataFrame, late: str = "1 day") -> DataFrame:
    """Of two streams, starts and cancels (key, ts, stream), the streams that are over: key, stream, each once. A newer start of the key replaces the one
    before; a cancel ends its stream, also one whose start comes only later. Repeats of either, in any order, change nothing: what is over is remembered until
    the watermark, `late` behind the newest time, has passed it, from when on its repeats are too late to be read. Cancels carry the time of their own."""
    rows = [df.select(F.col("key").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("stream").cast("long").alias("stream"), F.lit(c).alias("cancels")) for df, c in ((starts, False), (cancels, True))]
    both = rows[0].unionByName(rows[1]).withWatermark("ts", late)
    return both.groupBy("key").transformWithStateInPandas(_Streams(), "key long, stream long", "append", "eventTime")


# The keys touched last


def recent_keys(stream: DataFrame, key: str, capacity: int, path: str, checkpoint: str, *order: str, after: Callable[[int], None] | None = None) -> DataFrame:
    """Keeps the `capacity` keys touched last in a table behind a commit log: key and order. Each batch's last touch of each key meets what is kept; every partition
    gives its heads, of which the first are kept. A batch that runs again finds its number committed and changes nothing. after: called
    with the number of each batch."""
    spark = stream.sparkSession
    table = Table(spark, path)
    last = F.max(F.struct(*order)).alias("last")

    def batch(rows: DataFrame, number: int) -> None:
        def make(base, part: str):
            new = rows.groupBy(key).agg(last).select(key, "last.*")
            if base.version >= 0:
                new = new.unionByName(table.read(at=base).select(*new.columns)).groupBy(key).agg(last).select(key, "last.*")
            first: list[Column] = [F.desc(c) for c in order]
            kept = new.orderBy(*first, key).limit(capacity)
            return table.write(kept, part), base.of("rows"), {"rows": kept.schema}, {"batch": number}

        if table.snapshot().info.get("batch", -1) < number:
            table.change(make)
        if after:
            after(number)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read().drop("part", "bucket")
