"""A training-corpus pipeline over ``documents``: each stage works on all that its predecessor kept, from Parquet files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows
with null ids or texts pass through the filters that can't judge them (the classifier scores an empty text like any other).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, mixing, near_duplicates, quality_classifier, sharding
from millrace.llm.base import cut, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores under 0.5 go."""
    score = quality_classifier.scorer(quality_classifier.fit(docs, read(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) >= 0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: the one with the smallest id."""
    return near_duplicates.one_of_each(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote or reword a benchmark item go."""
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot, in place of columns of these names; copies of a document get places of
    their own. Rows are numbered in a written table, so each is matched with its own place."""
    rows = cut(docs.drop("shard", "slot").withColumn("__row", F.monotonically_increasing_id()))
    placed = sharding.interleaved_shards(rows, tie_col="__row").select(F.col("tie").alias("__row"), "shard", "slot")
    return rows.join(placed, "__row").drop("__row")


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: The classifier, the retrieval and the minima can't be said in SQL. Tests hold the near-duplicate stage against brute force,
#: the other stages against their operators' own rules, and run() whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
