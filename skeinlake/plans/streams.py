"""Queries: progress, expiry, windows on events, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlake.functions import text as T
from skeinlake.operators.sessions import message_tokens, normalised
from skeinlake.sources import event_stream
from skeinlake.sources.tables import fresh_path
from skeinlake.streaming import keyed as K
from skeinlake.streaming import stateful as St

from . import sqltext as S
from .learner import MASTERY_SQL, OBS_SQL, outcomes
from .registry import Registry, table
from .sessions import COMPACTION_SQL, MEM_SQL, MSG_SQL, UPD_SQL, messages, updates

register = Registry()

#: Events as progress: a signup starts, a purchase completes, an error fails; every seventh believes in the generation before.
PROG_SQL = """ev AS (SELECT user_id AS session_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'update' END AS action, event_id % 7 = 0 AS late FROM events),
cur AS (SELECT *, sum(CASE WHEN action = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, seq) AS current FROM ev),
acc AS (SELECT *, action = 'start' OR NOT late AS accepted FROM cur),
num AS (SELECT *, sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, current ORDER BY ts, seq) AS sequence FROM acc)"""


def progress_events(spark, sf_dir, rows=None):
    rows = table(spark, sf_dir, "events") if rows is None else rows
    kind = F.col("event_type")
    action = F.when(kind == "signup", "start").when(kind == "purchase", "complete").when(kind == "error", "fail").otherwise("update")
    believed = F.when(F.col("event_id") % 7 == 0, F.lit(-1))
    return rows.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), action.alias("action"), believed.cast("long").alias("generation"))


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@register(f"WITH {PROG_SQL} SELECT session_id, current::BIGINT AS generation, sequence::BIGINT AS sequence, CASE action WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'active' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS r FROM num WHERE accepted) WHERE r = 1")
def progress_latest(spark, sf_dir):
    return St.latest_progress(progress_events(spark, sf_dir)).select("session_id", *_long("generation", "sequence"), "state")


@register(f"WITH {PROG_SQL} SELECT session_id, seq, current::BIGINT AS generation FROM num WHERE NOT accepted")
def progress_fenced(spark, sf_dir):
    """Events that are dropped because their generation is over."""
    return St.progress(progress_events(spark, sf_dir)).where("NOT accepted").select("session_id", "seq", F.col("current").cast("long").alias("generation"))


@register("WITH e AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) SELECT user_id, event_id, value FROM e WHERE b IS NULL OR value > b")
def progress_monotone(spark, sf_dir):
    return St.increasing(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id").select("user_id", "event_id", "value")


@register("SELECT user_id, max(struct_pack(ts := ts, event_id := event_id)).event_id AS last_event FROM events GROUP BY user_id ORDER BY max(struct_pack(ts := ts, event_id := event_id)) DESC LIMIT 50")
def lru_active_sessions(spark, sf_dir):
    return St.most_recent(table(spark, sf_dir, "events"), "user_id", 50, "ts", "event_id").select("user_id", F.col("last.event_id").alias("last_event"))


@register("WITH l AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id FROM l WHERE r = 1 AND ts + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-31'")
def ttl_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    return St.alive(rows, "user_id", 86_400, F.lit("2024-01-31").cast("timestamp")).select("user_id", F.col("seq").alias("event_id"))


@register("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def single_active_stream(spark, sf_dir):
    """A key's newest stream replaces those before it."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("l"))
    return last.select("user_id", "event_type", F.col("l.event_id").alias("event_id"))


@register("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_daily(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@register("SELECT time_bucket(INTERVAL 12 HOUR, ts) - to_hours((12 * i)::INT) AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY start")
def sliding_counts(spark, sf_dir):
    """A day's count, every twelve hours."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@register("WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def session_30min(spark, sf_dir):
    """A gap of exactly thirty minutes still joins."""
    rows = table(spark, sf_dir, "events")
    gap = F.session_window(F.col("ts").cast("timestamp"), "1800 seconds 1 microsecond")
    return rows.groupBy("user_id", gap.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def _stream(spark, sf_dir, name):
    """The table as a stream of its files. The pattern matches one name: a plain path would have to be a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


@register("SELECT event_id, user_id FROM events")
def stream_dedup_watermark(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    doubled = rows.select("event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return St.finished(doubled.withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"), "stream-dedup")


@register(f"WITH {PROG_SQL} SELECT session_id, current::BIGINT AS generation, sequence::BIGINT AS sequence, action, seq FROM num WHERE accepted")
def stream_progress(spark, sf_dir):
    return St.finished(St.stream_progress(progress_events(spark, sf_dir, _stream(spark, sf_dir, "events"))), "stream-progress")


@register(f"WITH {OBS_SQL}, {MASTERY_SQL} SELECT user_id, concept, n, round(mastery, 8) AS mastery FROM mast")
def stream_learner(spark, sf_dir):
    """Each key's mastery after the last batch that touched it."""
    got = St.finished(St.stream_mastery(outcomes(_stream(spark, sf_dir, "events")).where("outcome <> 'reviewed'")), "stream-learner")
    return got.groupBy("user_id", "concept").agg(F.max_by(F.struct("n", "mastery"), "n").alias("s")).select("user_id", "concept", "s.n", F.round("s.mastery", 8).alias("mastery"))


@register(f"WITH {MSG_SQL}, {UPD_SQL} SELECT session_id, kind, lower({S.squeeze('content')}) AS norm, max(importance) AS importance, max(seq) AS last_seq FROM upd WHERE importance >= 55e-2 GROUP BY ALL")
def stream_memory(spark, sf_dir):
    """Memory updates as a stream: each memory after the last batch that touched it."""
    own = updates(spark, sf_dir, _stream(spark, sf_dir, "conversations"))
    got = St.finished(St.stream_memory(own.withColumn("norm", normalised(F.col("content")))), "stream-memory")
    return got.groupBy("session_id", "kind", "norm").agg(F.max("importance").alias("importance"), F.max("last_seq").alias("last_seq"))


@register("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_windows(spark, sf_dir):
    """Daily counts with a watermark: windows come out once they are over."""
    rows = _stream(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    got = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    return St.finished(got, "stream-windows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(f"SELECT doc_id, len({S.ranking_tokens('text')})::INT AS n_tokens FROM documents")
def stream_incremental_index(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    return St.incremental_index(docs, "doc_id", lambda d: d.select("doc_id", F.size(T.ranking_tokens(F.col("text"))).alias("n_tokens")), "stream-index")


_RESET = "(session_id + seq) % 5 = 3"


@register(f"WITH {MSG_SQL}, {UPD_SQL.replace('upd AS', 'every_upd AS', 1)}, since AS (SELECT user_id, session_id, max(seq) AS since FROM every_upd WHERE {_RESET} GROUP BY ALL), upd AS (SELECT u.* FROM every_upd u LEFT JOIN since s USING (user_id, session_id) WHERE since IS NULL OR seq >= since), {MEM_SQL} SELECT memory_id, user_id, session_id, kind, content, importance, created_at, updated_at, place FROM mem WHERE place <= 3")
def stream_memory_reset(spark, sf_dir):
    """Memory updates as a stream, some of which begin their scope anew: the three most important memories of each scope after the last batch that touched it."""
    own = updates(spark, sf_dir, _stream(spark, sf_dir, "conversations")).withColumn("reset", F.expr(_RESET))
    got = K.run(K.memories(own, cap=3), "stream-memories")
    last = got.groupBy("user_id", "session_id").agg(F.max("step").alias("step"))
    now = got.join(last, ["user_id", "session_id", "step"]).where("place > 0")
    return now.select("memory_id", "user_id", "session_id", "kind", "content", "importance", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")], "place")


@register("WITH l AS (SELECT user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) = 1) SELECT user_id, event_id FROM l WHERE epoch_ms(ts) + 86400000 > (SELECT epoch_ms(max(ts)) FROM events)")
def stream_expiry(spark, sf_dir):
    """What is set and not removed when the stream has seen all: each key's last event, if it is less than a day older than the newest."""
    rows = _stream(spark, sf_dir, "events").select("user_id", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"))
    got = K.run(K.expiring(rows, "user_id", 86_400), "stream-expiry")
    return K.still_set(got).select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"))


@register(COMPACTION_SQL)
def stream_compaction(spark, sf_dir):
    """The context fold over a stream of messages that wait for the watermark."""
    own = messages(spark, sf_dir, _stream(spark, sf_dir, "conversations"))
    own = own.select("session_id", "ts", "seq", "role", message_tokens(F.col("content")).alias("tokens"))
    return K.run(K.contexts(own, safe=3_900), "stream-context")


@register("SELECT user_id, event_id AS last_event FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY ts DESC, event_id DESC LIMIT 500")
def stream_lru(spark, sf_dir):
    """The 500 keys touched last, kept batch by batch."""
    rows = _stream(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    path = fresh_path(spark, "stream-lru")
    return K.recent_keys(rows, "user_id", 500, f"{path}/table", f"{path}/checkpoint", "ts", "event_id").select("user_id", F.col("event_id").alias("last_event"))


@register("SELECT user_id, event_id AS stream FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r > 1 OR event_id % 3 = 0")
def stream_cancel_replace(spark, sf_dir):
    """Every event starts a stream of its user in place of the one before; every third is cancelled too, twice. Each that is over is told once."""
    starts = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("stream"))
    cancels = _stream(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("stream"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return K.run(K.ended_streams(starts, cancels), "stream-ended").select(F.col("key").alias("user_id"), "stream")


@register("SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 2 = 0 THEN role ELSE 'message' END AS event, text AS data FROM conversations WHERE text <> ''")
def stream_event_source(spark, sf_dir):
    """Conversations as event-stream files, a frame a turn, read by the streaming source."""
    event_stream.register(spark)
    lines = F.concat(F.lit("data: "), F.replace("text", F.lit("\n"), F.lit("\ndata: ")), F.lit("\n"))
    named = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("event: "), "role", F.lit("\n"))).otherwise("")
    path = fresh_path(spark, "event-stream")
    table(spark, sf_dir, "conversations").where("text <> ''").select(F.concat(F.lit("id: "), "conv_id", F.lit("-"), "turn", F.lit("\n"), named, lines)).write.text(path)
    return St.finished(spark.readStream.format("event_stream").load(path), "stream-frames").select("id", "event", "data")
