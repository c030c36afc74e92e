"""Folds in order, for SQL: table functions that take TABLE (...) PARTITION BY ... ORDER BY ... and give its rows with what the fold says of each.

A key's rows come to one task in order, one at a time; what is kept is a few numbers. Null keys are a key, ties in order come in any
order, empty tables give none. Names that the rows have already may not be those that a fold adds: that is an error when the query is analysed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import PySparkValueError
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as Ty
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from skeinlake.operators.learner import GUESS, LEARN, PRIOR, SLIP


def _widened(rows: AnalyzeArgument, needs: tuple[str, ...], *adds: Ty.StructField) -> AnalyzeResult:
    """The rows' own columns and those that a fold adds."""
    own = rows.dataType
    for n in needs:
        if n not in own.names:
            raise PySparkValueError(f"the table has no column {n}")
    for f in adds:
        if f.name in own.names:
            raise PySparkValueError(f"the table has a column {f.name} already")
    return AnalyzeResult(Ty.StructType([*own.fields, *adds]))


@udtf
class TokenBatches:
    """rows (with tokens; null: 0), batch: greedy packing of a key's texts, numbered from 0. A batch ends where it has most_texts texts or the next
    one would make it more than most_tokens; a text of more tokens is a batch of its own."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, most_texts: AnalyzeArgument, most_tokens: AnalyzeArgument) -> AnalyzeResult:
        return _widened(rows, ("tokens",), Ty.StructField("batch", Ty.LongType()))

    def __init__(self):
        self.batch = self.texts = self.tokens = 0

    def eval(self, rows: Row, most_texts: int, most_tokens: int) -> Iterator[tuple]:
        n = rows["tokens"] or 0
        if self.texts and (self.texts >= most_texts or self.tokens + n > most_tokens):
            self.batch, self.texts, self.tokens = self.batch + 1, 0, 0
        self.texts += 1
        self.tokens += n
        yield (*rows, self.batch)


@udtf
class MasteryPath:
    """rows (with score, 0 to 1; null: nothing learned), mastery: knowledge tracing after each observation, where learner.fold_mastery has the last alone."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return _widened(rows, ("score",), Ty.StructField("mastery", Ty.DoubleType()))

    def __init__(self):
        self.mastery = PRIOR

    def eval(self, rows: Row) -> Iterator[tuple]:
        if rows["score"] is not None:
            m, s = self.mastery, float(rows["score"])
            right = m * (1 - SLIP) / max(m * (1 - SLIP) + (1 - m) * GUESS, 1e-9)
            wrong = m * SLIP / max(m * SLIP + (1 - m) * (1 - GUESS), 1e-9)
            blend = s * right + (1 - s) * wrong
            self.mastery = max(0.01, min(0.995, blend + (1 - blend) * LEARN))
        yield (*rows, self.mastery)


def register(spark: SparkSession) -> None:
    """The session's SQL has token_batches and mastery_path from now on."""
    spark.udtf.register("token_batches", TokenBatches)
    spark.udtf.register("mastery_path", MasteryPath)
