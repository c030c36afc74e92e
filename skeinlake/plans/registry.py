"""Registration of queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers the function under its name; sql: for DuckDB, over views of the same tables."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are worked on at length."""
    return spread(table(spark, sf_dir, name))


def said_sql(phrases: list[str], more: str = "") -> str:
    """Messages, each behind one of the phrases by its number, as DuckDB has them: conv_id, turn, role, text, i (the phrase's place), s."""
    listed = ", ".join("'" + p.replace("'", "''") + "'" for p in phrases)
    return f"SELECT *, ([{listed}])[i + 1] || ' ' || text AS s{more} FROM (SELECT *, (conv_id + turn) % {len(phrases)} AS i FROM conversations)"


def said(spark: SparkSession, sf_dir: str, phrases: list[str]) -> DataFrame:
    """The same messages."""
    rows = table(spark, sf_dir, "conversations").withColumn("i", ((F.col("conv_id") + F.col("turn")) % len(phrases)).cast("int"))
    return rows.withColumn("s", F.concat(F.get(F.array(*[F.lit(p) for p in phrases]), F.col("i")), F.lit(" "), "text"))
