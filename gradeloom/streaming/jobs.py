"""Streams over submissions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def submission_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_arrivals(stream: DataFrame, key: str = "id") -> DataFrame:
    """Every submission once, by its id, whenever and with whatever time stamp it is sent again.

    The ids that have arrived are the stream's state, kept by Spark next to its checkpoint
    and spread by id; no stored result is read. A row without an id counts once for each
    different content. On a table it does the same for its rows.
    """
    content = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    own = F.when(F.col(key).isNotNull(), F.concat(F.lit("id:"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("row:"), content))
    return stream.withColumn("_arrival", own).dropDuplicates(["_arrival"]).drop("_arrival")


def start_scoring(
    stream: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    available_now: bool = False,
    key: str = "id",
) -> StreamingQuery:
    """Score each batch into a folder of its own.

    Every submission is scored, however late it comes, and one that is sent again is
    scored once. State and offsets advance together, and a batch that is repeated after a
    failure writes its folder again, so nothing is lost or stored twice. The state
    has an entry for each id; sessions of ``get_session`` keep it in RocksDB, outside of the heap.
    """

    def handle(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = first_arrivals(stream, key).writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rolling_error(
    df: DataFrame,
    label: str,
    prediction: str,
    version: str = "model_version",
    time: str = "created_at",
    window: str = "1 day",
    slide: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """RMSE per time window and model version; works on a stream and on a table.

    On a stream, rows later than ``delay`` behind the newest one are not counted
    and the state of closed windows is dropped. A few sums per window and version
    are all the state there is.
    """
    error = F.col(label) - F.col(prediction)
    rows = df.withWatermark(time, delay) if df.isStreaming else df
    return (
        rows.groupBy(F.window(time, window, slide), version)
        .agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), version, "rmse", "n")
    )


def start_rolling_error(rolling: DataFrame, sink: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the latest numbers: every batch writes the windows it changed, tagged with its number."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = rolling.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_windows(spark: SparkSession, sink: str, version: str = "model_version") -> DataFrame:
    """The newest numbers of each window from what ``start_rolling_error`` wrote."""
    rows = spark.read.parquet(sink)
    return (
        rows.groupBy("start", "end", version)
        .agg(F.max_by(F.struct("rmse", "n"), "batch").alias("last"))
        .select("start", "end", version, "last.rmse", "last.n")
    )
