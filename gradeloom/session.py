"""Session defaults and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Only settings that are right on any cluster; sizes stay with the deployment.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # ids that a stream has seen may be many
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # source files vary from bytes to megabytes, so Python batches are kept short
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_session(app: str = "gradeloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    single-machine session gets a temporary folder; a cluster has to name one,
    since a folder of one machine is not seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    # executors of local-cluster are processes of their own, with folders of their own
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="gradeloom-")
    return _own_folders[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/gradeloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a plan is read more than once and must not be computed again, or
    where values (a physical partition number) have to be frozen. The table sits
    in the shared folder, so losing executors does not lose it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Cut a plain scan whose rows lie in fewer tasks than there are cores into more of them.

    Meant for work that is heavy per row, such as parsing. What counts is where the rows are: a file
    may be read by many tasks of which only those that meet the middle of a row group get rows. A scan
    with its rows in enough tasks, none of which has more than twice its part, is returned as it is and
    not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    if parts >= cores:
        # reads no column: Parquet counts rows by the footers
        rows = df.groupBy(F.spark_partition_id()).count()
        found = rows.agg(F.count(F.lit(1)).alias("tasks"), F.max("count").alias("most"), F.sum("count").alias("all")).first()
        if not found["all"] or (found["tasks"] >= cores and found["most"] * cores <= 2 * found["all"]):
            return df
    return df.repartition(max(4 * cores, parts), key)
