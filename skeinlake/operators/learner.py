"""Learner models from ordered observations: knowledge tracing, item response, spaced repetition; one ordered fold a user.

A user's ability couples all concepts, so the fold is per user; observations are sorted within an array and folded by an
expression, without Python. Users bound the arrays: one user's observations must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the models.
PRIOR, LEARN, GUESS, SLIP = 0.25, 0.13, 0.20, 0.10
DISCRIMINATION, RATE = 1.2, 0.35
SCORES = {"correct": 1.0, "incorrect": 0.0, "hinted": 0.35, "solution_viewed": 0.2, "reviewed": 0.6}
RATINGS = {"correct": 3, "incorrect": 1, "hinted": 2, "solution_viewed": 1, "reviewed": 2}
DIFFICULTY = {"easy": -1.0, "medium": 0.0, "hard": 1.1, "unknown": 0.0}


def lookup(table: dict, key: Column) -> Column:
    out = F.lit(None)
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bkt(prior: Column, score: Column) -> Column:
    """Mastery after one observation: the posteriors of right and wrong, blended by the score; then learning."""
    right = prior * (1 - SLIP) / F.greatest(prior * (1 - SLIP) + (1 - prior) * GUESS, F.lit(1e-9))
    wrong = prior * SLIP / F.greatest(prior * SLIP + (1 - prior) * (1 - GUESS), F.lit(1e-9))
    blend = score * right + (1 - score) * wrong
    return clamp(blend + (1 - blend) * LEARN, 0.01, 0.995)


def irt(theta: Column, difficulty: Column) -> Column:
    return 1.0 / (1.0 + F.exp(clamp(-DISCRIMINATION * (theta - difficulty), -30.0, 30.0)))


def ability(theta: Column, difficulty: Column, score: Column, confidence: Column) -> Column:
    return clamp(theta + RATE * DISCRIMINATION * (score - irt(theta, difficulty)) * confidence, -3.0, 3.0)


def schedule(stability: Column, difficulty: Column, rating: Column, elapsed: Column) -> Column:
    """struct(stability, difficulty, days) after a review."""
    hard = clamp(difficulty - 0.30 * (rating - 3), 1.0, 10.0)
    first = lookup({1: 0.4, 2: 1.0, 3: 2.5, 4: 5.0}, rating)
    kept = F.pow(F.lit(0.9), elapsed / F.greatest(stability, F.lit(0.1)))
    lapse = F.greatest(F.lit(0.4), stability * (0.25 + 0.15 * kept))
    growth = 1 + (11 - hard) * 0.08 * (rating - 1) * (1.3 - kept)
    new = clamp(F.when(stability <= 0, first).when(rating == 1, lapse).otherwise(stability * F.greatest(F.lit(1.05), growth)), 0.4, 365.0)
    return F.struct(new.alias("stability"), hard.alias("difficulty"), F.greatest(F.lit(1), F.least(F.lit(365), F.bround(new).cast("int"))).alias("days"))


def fold_mastery(observations: DataFrame, *by: str) -> DataFrame:
    """Mastery by key; observations: by..., ts, seq, outcome. Reviews change nothing."""
    steps = F.sort_array(F.collect_list(F.struct("ts", "seq", lookup(SCORES, F.col("outcome")).alias("score"))))
    grouped = observations.where("outcome <> 'reviewed'").groupBy(*by).agg(steps.alias("steps"))
    return grouped.select(*by, F.size("steps").alias("n"), F.aggregate("steps", F.lit(PRIOR), lambda m, s: bkt(m, s["score"])).alias("mastery"))


def fold_ability(observations: DataFrame, user: str = "user_id") -> DataFrame:
    """Ability by user; observations: user, ts, seq, outcome, difficulty, confidence."""
    steps = F.sort_array(F.collect_list(F.struct("ts", "seq", lookup(SCORES, F.col("outcome")).alias("score"), lookup(DIFFICULTY, F.col("difficulty")).alias("b"), "confidence")))
    grouped = observations.where("outcome <> 'reviewed'").groupBy(user).agg(steps.alias("steps"))
    return grouped.select(user, F.size("steps").alias("n"), F.aggregate("steps", F.lit(0.0), lambda t, s: ability(t, s["b"], s["score"], s["confidence"])).alias("theta"))


def fold_schedule(observations: DataFrame, *by: str) -> DataFrame:
    """Stability, difficulty and next review (days behind the last) by key; observations: by..., ts, seq, outcome."""
    steps = F.sort_array(F.collect_list(F.struct("ts", "seq", lookup(RATINGS, F.col("outcome")).alias("rating"))))
    zero = F.struct(F.lit(0.0).alias("stability"), F.lit(5.0).alias("difficulty"), F.lit(0).alias("days"), F.lit(None).cast("timestamp").alias("last"))

    def step(s: Column, o: Column) -> Column:
        elapsed = F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(o["ts"]) - F.unix_micros(s["last"])) / 86_400e6), F.lit(0.0))
        new = schedule(s["stability"], s["difficulty"], o["rating"], elapsed)
        return F.struct(new["stability"].alias("stability"), new["difficulty"].alias("difficulty"), new["days"].alias("days"), o["ts"].alias("last"))

    grouped = observations.groupBy(*by).agg(steps.alias("steps"))
    return grouped.select(*by, F.size("steps").alias("n"), F.aggregate("steps", zero, step).alias("s")).select(*by, "n", "s.*")


def priority(mastery: Column, attempts: Column, days_overdue: Column) -> Column:
    """What to learn next: little mastery, due, uncertain. days_overdue: negative before it is due, null if never scheduled."""
    due = F.when(days_overdue.isNull(), 0.0).when(days_overdue >= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 + days_overdue / 30))
    return F.round((1 - mastery) * 0.65 + due * 0.25 + 1.0 / F.sqrt(attempts + 1) * 0.10, 6)


def target_difficulty(theta: Column) -> Column:
    return F.when(theta < -0.55, "easy").when(theta < 0.85, "medium").otherwise("hard")


#: Concepts and the words that name them.
CONCEPTS = {
    "动态规划": ("动态规划", "dp", "背包", "打家劫舍", "最长公共子序列", "最长递增子序列"),
    "二分查找": ("二分查找", "二分答案", "二分"),
    "哈希表": ("哈希表", "哈希", "hash", "两数之和"),
    "滑动窗口": ("滑动窗口",),
    "双指针": ("双指针", "快慢指针"),
    "单调栈": ("单调栈", "下一个更大元素"),
    "拓扑排序": ("拓扑排序",),
    "并查集": ("并查集", "union find", "union-find"),
    "最短路": ("最短路", "dijkstra", "floyd", "bellman-ford"),
    "二叉树": ("二叉树", "树的遍历", "层序遍历"),
    "图搜索": ("深度优先", "广度优先", "dfs", "bfs", "岛屿数量"),
    "图论": ("图论", "邻接表", "邻接矩阵"),
    "回溯": ("回溯", "排列组合", "组合总和"),
    "贪心": ("贪心",),
    "链表": ("链表", "反转链表"),
    "堆与优先队列": ("优先队列", "最小堆", "最大堆", "heap"),
    "栈与队列": ("栈", "队列", "括号匹配"),
    "字符串": ("字符串", "kmp"),
    "数组": ("数组", "前缀和", "差分数组"),
}
#: What a message says of its outcome.
SIGNALS = {
    "correct": r"(?i)独立.{0,10}(做对|通过|ac)|(?<!没)(?<!未)(做对了|通过了|ac了|解决了)|没有.{0,6}(提示|题解).{0,8}(做对|通过)",
    "incorrect": r"(?i)没(有)?做对|没(有)?通过|没做出来|做错|不会|不理解|卡住|wa了|答案错误",
    "hinted": r"(?i)给我.{0,6}提示|只要提示|需要提示|用了.{0,6}提示|看了提示",
    "solution_viewed": r"(?i)看了.{0,6}(答案|题解|完整解法)|直接.{0,6}(答案|完整解法)|告诉我完整答案",
    "reviewed": r"(?i)复习了|刚复习|复习一下|重新复习",
}
CONFIDENCE = {"correct": 0.95, "solution_viewed": 0.9, "hinted": 0.88, "incorrect": 0.95, "reviewed": 0.75}
_DIFFICULT = {"hard": ("困难", "hard", "难题"), "easy": ("简单", "easy", "入门"), "medium": ("中等", "medium")}


def detect_concepts(text: Column) -> Column:
    """At most three concepts, in the table's order; ASCII names count as whole words."""
    low = F.lower(text)
    named = []
    for concept, words in CONCEPTS.items():
        found = F.lit(False)
        for w in words:
            found = found | (low.rlike(rf"(?<![a-z0-9])\Q{w}\E(?![a-z0-9])") if w.isascii() and " " not in w else low.contains(w))
        named.append(F.when(found, concept))
    return F.slice(F.array_compact(F.array(*named)), 1, 3)


def detect_outcome(text: Column) -> Column:
    """correct unless something went wrong; then solution viewed, hint, failure, review; null if nothing is said."""
    says = {k: text.rlike(p) for k, p in SIGNALS.items()}
    out = F.when(says["correct"] & ~says["incorrect"], "correct")
    for k in ("solution_viewed", "hinted", "incorrect", "reviewed"):
        out = out.when(says[k], k)
    return out


def detect_difficulty(text: Column) -> Column:
    low, out = F.lower(text), F
    for name, words in _DIFFICULT.items():
        some = F.lit(False)
        for w in words:
            some = some | low.contains(w)
        out = out.when(some, name)
    return out.otherwise("unknown")
