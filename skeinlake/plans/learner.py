"""Queries: learner models over events as observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlake.operators import folds
from skeinlake.operators import learner as L
from skeinlake.operators import retrieval as R

from .registry import Registry, said, said_sql, table

register = Registry()

OBS_SQL = """obs AS (SELECT user_id, ts, event_id AS seq, 'c' || ((props->>'k')::INT % 12) AS concept,
CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'error' THEN 'incorrect' WHEN 'click' THEN 'hinted' WHEN 'signup' THEN 'solution_viewed' ELSE 'reviewed' END AS outcome,
CASE WHEN value < 15 THEN 'easy' WHEN value < 60 THEN 'medium' ELSE 'hard' END AS difficulty,
CASE event_type WHEN 'purchase' THEN 95e-2 WHEN 'error' THEN 95e-2 WHEN 'click' THEN 88e-2 WHEN 'signup' THEN 9e-1 ELSE 75e-2 END AS confidence FROM events),
o AS (SELECT *, CASE outcome WHEN 'correct' THEN 1e0 WHEN 'incorrect' THEN 0e0 WHEN 'hinted' THEN 35e-2 WHEN 'solution_viewed' THEN 2e-1 ELSE 6e-1 END AS score,
CASE outcome WHEN 'correct' THEN 3 WHEN 'incorrect' THEN 1 WHEN 'hinted' THEN 2 WHEN 'solution_viewed' THEN 1 ELSE 2 END AS rating, CASE difficulty WHEN 'easy' THEN -1e0 WHEN 'hard' THEN 11e-1 ELSE 0e0 END AS b FROM obs)"""
_BKT = "greatest(1e-2, least(995e-3, {p} + (1 - {p}) * 13e-2))".format(p="(s * (m * 9e-1 / greatest(m * 9e-1 + (1 - m) * 2e-1, 1e-9)) + (1 - s) * (m * 1e-1 / greatest(m * 1e-1 + (1 - m) * 8e-1, 1e-9)))")
MASTERY_SQL = f"mast AS (SELECT user_id, concept, count(*) AS n, list_reduce(list(score ORDER BY ts, seq), lambda m, s: {_BKT}, 25e-2) AS mastery FROM o WHERE outcome <> 'reviewed' GROUP BY ALL)"
THETA_SQL = """st AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS i FROM o WHERE outcome <> 'reviewed'),
th AS (SELECT user_id, 0::BIGINT AS i, 0e0 AS theta FROM st GROUP BY user_id UNION ALL
SELECT th.user_id, st.i, greatest(-3e0, least(3e0, theta + 42e-2 * (score - 1e0 / (1e0 + exp(greatest(-30e0, least(30e0, -12e-1 * (theta - b)))))) * confidence)) FROM th JOIN st ON st.user_id = th.user_id AND st.i = th.i + 1),
ability AS (SELECT user_id, max(i) AS n, arg_max(theta, i) AS theta FROM th GROUP BY user_id)"""
FSRS_SQL = """sq AS (SELECT *, row_number() OVER (PARTITION BY user_id, concept ORDER BY ts, seq) AS i FROM o),
fs AS (SELECT user_id, concept, 0::BIGINT AS i, 0e0 AS s, 5e0 AS d, NULL::TIMESTAMP AS last FROM sq GROUP BY ALL UNION ALL
SELECT user_id, concept, i, greatest(4e-1, least(365e0, CASE WHEN s <= 0 THEN CASE rating WHEN 1 THEN 4e-1 WHEN 2 THEN 1e0 WHEN 3 THEN 25e-1 ELSE 5e0 END WHEN rating = 1 THEN greatest(4e-1, s * (25e-2 + 15e-2 * k)) ELSE s * greatest(105e-2, 1 + (11 - nd) * 8e-2 * (rating - 1) * (13e-1 - k)) END)), nd, ts
FROM (SELECT fs.user_id, fs.concept, sq.i, s, sq.rating, sq.ts, greatest(1e0, least(10e0, d - 3e-1 * (sq.rating - 3))) AS nd, pow(9e-1, coalesce(greatest(0e0, (epoch_us(sq.ts) - epoch_us(last)) / 864e8), 0e0) / greatest(s, 1e-1)) AS k FROM fs JOIN sq ON sq.user_id = fs.user_id AND sq.concept = fs.concept AND sq.i = fs.i + 1)),
fsrs AS (SELECT user_id, concept, max(i) AS n, arg_max(s, i) AS stability, arg_max(d, i) AS difficulty, arg_max(last, i) AS last FROM fs GROUP BY ALL)"""


def outcomes(events):
    """Events as observations."""
    kind, value = F.col("event_type"), F.col("value")
    outcome = F.when(kind == "purchase", "correct").when(kind == "error", "incorrect").when(kind == "click", "hinted").when(kind == "signup", "solution_viewed").otherwise("reviewed")
    concept = F.concat(F.lit("c"), F.get_json_object("props", "$.k").cast("int") % 12)
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), concept.alias("concept"), outcome.alias("outcome"), F.when(value < 15, "easy").when(value < 60, "medium").otherwise("hard").alias("difficulty"))
    return rows.withColumn("confidence", L.lookup(L.CONFIDENCE, F.col("outcome")))


def observations(spark, sf_dir):
    return outcomes(table(spark, sf_dir, "events"))


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@register(f"WITH {OBS_SQL}, {MASTERY_SQL} SELECT user_id, concept, n, round(mastery, 8) AS mastery FROM mast")
def bkt_mastery(spark, sf_dir):
    return L.fold_mastery(observations(spark, sf_dir), "user_id", "concept").select("user_id", "concept", *_long("n"), F.round("mastery", 8).alias("mastery"))


@register(f"WITH RECURSIVE {OBS_SQL}, {THETA_SQL} SELECT user_id, n, round(theta, 6) AS theta FROM ability")
def irt_theta(spark, sf_dir):
    return L.fold_ability(observations(spark, sf_dir)).select("user_id", *_long("n"), F.round("theta", 6).alias("theta"))


@register(f"WITH RECURSIVE {OBS_SQL}, {FSRS_SQL} SELECT user_id, concept, n, round(stability, 6) AS stability, round(difficulty, 6) AS difficulty, greatest(1, least(365, round_even(stability, 0)::INT)) AS days, last + to_days(greatest(1, least(365, round_even(stability, 0)::INT))) AS next_review FROM fsrs")
def fsrs_schedule(spark, sf_dir):
    got = L.fold_schedule(observations(spark, sf_dir), "user_id", "concept")
    due = (F.col("last") + F.make_dt_interval(F.col("days"))).cast("timestamp_ntz")
    return got.select("user_id", "concept", *_long("n"), F.round("stability", 6).alias("stability"), F.round("difficulty", 6).alias("difficulty"), "days", due.alias("next_review"))


_PROFILE = f"""prof AS (SELECT fsrs.user_id, fsrs.concept, fsrs.n AS attempts, coalesce(mastery, 25e-2) AS mastery, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last + to_days(greatest(1, least(365, round_even(stability, 0)::INT))))) / 864e8 AS overdue FROM fsrs LEFT JOIN mast USING (user_id, concept)),
pr AS (SELECT *, round((1 - mastery) * 65e-2 + (CASE WHEN overdue >= 0 THEN 1e0 ELSE greatest(0e0, 1e0 + overdue / 30) END) * 25e-2 + 1e0 / sqrt(attempts + 1) * 1e-1, 6) AS priority FROM prof)"""


def profile(spark, sf_dir):
    obs = observations(spark, sf_dir)
    as_of = F.lit("2024-02-01").cast("timestamp")
    due = F.col("last") + F.make_dt_interval(F.col("days"))
    both = L.fold_schedule(obs, "user_id", "concept").join(L.fold_mastery(obs, "user_id", "concept").drop("n"), ["user_id", "concept"], "left")
    rows = both.select("user_id", "concept", F.col("n").cast("long").alias("attempts"), F.coalesce("mastery", F.lit(L.PRIOR)).alias("mastery"), ((F.unix_micros(as_of) - F.unix_micros(due)) / 86_400e6).alias("overdue"))
    return rows.withColumn("priority", L.priority(F.col("mastery"), F.col("attempts"), F.col("overdue")))


@register(f"WITH RECURSIVE {OBS_SQL}, {MASTERY_SQL}, {FSRS_SQL}, {_PROFILE} SELECT user_id, concept, attempts, round(mastery, 6) AS mastery, priority FROM pr")
def learner_profile(spark, sf_dir):
    return profile(spark, sf_dir).select("user_id", "concept", "attempts", F.round("mastery", 6).alias("mastery"), "priority")


@register(f"WITH RECURSIVE {OBS_SQL}, {MASTERY_SQL}, {FSRS_SQL}, {_PROFILE}, r AS (SELECT user_id, concept, priority, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, concept DESC) AS rank FROM pr) SELECT * FROM r WHERE rank <= 3")
def concept_recommendation(spark, sf_dir):
    best = R.ranked(profile(spark, sf_dir), "user_id", F.desc("priority"), F.desc("concept"), limit=3)
    return best.select("user_id", "concept", "priority", *_long("rank"))


@register(f"WITH RECURSIVE {OBS_SQL}, {THETA_SQL} SELECT user_id, CASE WHEN theta < -55e-2 THEN 'easy' WHEN theta < 85e-2 THEN 'medium' ELSE 'hard' END AS target FROM ability")
def target_difficulty(spark, sf_dir):
    return L.fold_ability(observations(spark, sf_dir)).select("user_id", L.target_difficulty(F.col("theta")).alias("target"))


_SAID = ["我刚刚独立做对了一道中等难度的二分查找题，没有看提示。", "打家劫舍没做出来", "滑动窗口题我不会，请先只给我提示。", "解释一下二分查找为什么是 O(log n)。", "复习了 dp 和 KMP", "看了题解，hard heap problem", "adps bfsx"]
_SIG_SQL = {
    "correct": "(regexp_matches(s, '(?i)独立.{0,10}(做对|通过|ac)') OR regexp_matches(s, '(?i)(^|[^没未])(做对了|通过了|ac了|解决了)') OR regexp_matches(s, '(?i)没有.{0,6}(提示|题解).{0,8}(做对|通过)'))",
} | {k: f"regexp_matches(s, '{L.SIGNALS[k]}')" for k in ("incorrect", "hinted", "solution_viewed", "reviewed")}


def _concept_sql(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower(s), '(^|[^a-z0-9]){w}($|[^a-z0-9])')" if w.isascii() and " " not in w else f"contains(lower(s), '{w}')" for w in words) + ")"


_CONCEPTS_SQL = "list_slice(list_filter([" + ", ".join(f"CASE WHEN {_concept_sql(ws)} THEN '{c}' END" for c, ws in L.CONCEPTS.items()) + "], lambda x: x IS NOT NULL), 1, 3)"


@register(f"WITH t AS ({said_sql(_SAID)}) SELECT conv_id, turn, array_to_string({_CONCEPTS_SQL}, ',') AS concepts, CASE WHEN {_SIG_SQL['correct']} AND NOT {_SIG_SQL['incorrect']} THEN 'correct' WHEN {_SIG_SQL['solution_viewed']} THEN 'solution_viewed' WHEN {_SIG_SQL['hinted']} THEN 'hinted' WHEN {_SIG_SQL['incorrect']} THEN 'incorrect' WHEN {_SIG_SQL['reviewed']} THEN 'reviewed' END AS outcome, CASE WHEN regexp_matches(lower(s), '困难|hard|难题') THEN 'hard' WHEN regexp_matches(lower(s), '简单|easy|入门') THEN 'easy' WHEN regexp_matches(lower(s), '中等|medium') THEN 'medium' ELSE 'unknown' END AS difficulty FROM t")
def learning_signal_detect(spark, sf_dir):
    s = F.col("s")
    return said(spark, sf_dir, _SAID).select("conv_id", "turn", F.array_join(L.detect_concepts(s), ",").alias("concepts"), L.detect_outcome(s).alias("outcome"), L.detect_difficulty(s).alias("difficulty"))


PATH_SQL = f"""st AS (SELECT *, row_number() OVER (PARTITION BY user_id, concept ORDER BY ts, seq) AS i FROM o WHERE outcome <> 'reviewed'),
mp AS (SELECT user_id, concept, seq, i, {_BKT} AS m FROM (SELECT *, 25e-2 AS m, score AS s FROM st WHERE i = 1) UNION ALL
SELECT user_id, concept, seq, i, {_BKT} FROM (SELECT st.user_id, st.concept, st.seq, st.i, st.score AS s, mp.m FROM mp JOIN st ON st.user_id = mp.user_id AND st.concept = mp.concept AND st.i = mp.i + 1))"""


@register(f"WITH RECURSIVE {OBS_SQL}, {PATH_SQL} SELECT user_id, concept, seq, round(m, 8) AS mastery FROM mp")
def mastery_path_sql(spark, sf_dir):
    """Mastery after each observation, by a table function in SQL."""
    folds.register(spark)
    seen = observations(spark, sf_dir).where("outcome <> 'reviewed'").withColumn("score", L.lookup(L.SCORES, F.col("outcome")))
    return spark.sql("SELECT user_id, concept, seq, round(mastery, 8) AS mastery FROM mastery_path(TABLE(SELECT * FROM {seen}) PARTITION BY (user_id, concept) ORDER BY (ts, seq))", seen=seen)
