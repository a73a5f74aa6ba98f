"""A training corpus from raw documents; the stages are written and read again one by one.

A stage's result has to be written before the next stage is called: that one drops the
tables which the stages before it have staged, unless its own input reads them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm import line_templates, lsh_forest, packing, robust_quality, source_mix
from gradeloom.llm.common import drop_tables, recorded, small_batches, stage

_tables: list[str] = []


def _stage(function):
    """A stage that first drops what earlier stages have left in the shared folder."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(_tables, docs)
        with recorded(_tables):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return robust_quality.kept_documents(docs)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur in others; ``n_chars`` follows the text."""
    kinds = dict(docs.dtypes)
    cleaned = line_templates.without_recurring_lines(docs)
    size = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(kinds["n_chars"])
    return cleaned.withColumn("n_chars", size).select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return lsh_forest.deduplicated(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights, in the order of the mix."""
    return source_mix.mix(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, 2048)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Tokens and robust estimates are beyond SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        result = function(spark, docs, sf_dir)
        with recorded(_tables):
            docs = stage(result, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
