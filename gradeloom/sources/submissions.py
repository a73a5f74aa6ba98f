"""Scored submissions: scanning, looking up, appending."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.functions.scalars import stamp_to_timestamp


def read_submissions_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int, **options) -> DataFrame:
    """The table of a database, read in parallel by ranges of its id; filters are pushed down."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="id", lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .options(**options)
        .load()
    )


def read_submissions(
    source: DataFrame, version: str, max_time: str | None = None, limit: int | None = None
) -> tuple[DataFrame, str]:
    """Submissions of one model version up to and including ``max_time``, and the time stamp used.

    With a limit, the earliest ones are taken.
    """
    rows = source.filter(F.col("model_version") == version)
    if max_time is not None:
        rows = rows.filter(F.col("created_at") <= stamp_to_timestamp(F.lit(max_time)))
    if limit is not None:
        rows = rows.orderBy("created_at", "id").limit(limit)
    stamp = max_time or datetime.now(timezone.utc).strftime("%Y-%m-%d_%H-%M-%S_UTC")
    return rows, stamp


def get_submissions(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The submissions asked for by (id, user_id); one of another user is not given."""
    return source.join(wanted.select("id", "user_id"), ["id", "user_id"], "left_semi")


def append_submissions(df: DataFrame, path: str) -> None:
    """Append rows whose id is not stored yet; repeating a batch changes nothing.

    A submission keeps its ``created_at``, so only stored rows from the batch's
    own time span are looked at, however long the history is; where the batch has rows
    without a time, stored rows without one are looked at too.
    """
    spark = df.sparkSession
    fresh = df.dropDuplicates(["id"])
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = None  # nothing stored yet
    if stored is not None:
        time = F.col("created_at")
        span = df.agg(F.min(time).alias("a"), F.max(time).alias("b"), F.count_if(time.isNull()).alias("without")).first()
        inside = time.between(span["a"], span["b"]) if span["a"] else F.lit(False)
        known = stored.filter(inside | time.isNull() if span["without"] else inside).select("id")
        fresh = fresh.join(known, "id", "left_anti")
    fresh.write.mode("append").parquet(path)
