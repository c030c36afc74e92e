"""A training corpus from raw documents: quality, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and gives the
table read again to the next stage. All but the last return the columns of docs. Classifiers learn from the labels of the documents they are given.

Defined results, stage by stage. Null texts count as empty: quality and toxicity judge them as such, all documents of null or
empty text are copies of one another, and personal data leaves null null. Null keys and repeated rows are judged each; of
rows that repeat a key and text one stays behind the near-duplicates, and all that have no key. Very long texts are worked on whole. Columns of any
name beside doc_id and text pass through as they are, but for n_chars, which follows the text. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.llm import packing, pii, quality, simhash, toxicity
from skeinlake.llm.common import staged
from skeinlake.sources.tables import discard, spread


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores 0.3 or more."""
    model = quality.train(docs, _labels(spark, sf_dir), toxicity.fold("doc_id", 5) != 0)
    return quality.select(docs, model, lambda p: p >= 0.3)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity scores below 0.7."""
    model = toxicity.train(docs, _labels(spark, sf_dir), toxicity.fold("doc_id", 3) != 1)
    return toxicity.select(docs, model, lambda p: p < 0.7)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of least id."""
    return simhash.representatives(docs)


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced; n_chars, where there is such a column, follows the new text."""
    masked = pii.pseudonymize(docs, counts=False)
    kinds = dict(docs.dtypes)
    return masked.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024. The encoder keeps fewer pieces: its workers have served the stages before."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False, keep_pieces=500_000)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("simhash", one_of_each), ("pii", pseudonymous), ("packing", packed)]

#: The classifiers, XXH64 and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs, before = staged(stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
