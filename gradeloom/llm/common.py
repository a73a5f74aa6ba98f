"""What the operators of this package share: words, whole texts, Arrow batches, staged tables."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom import session

#: White space of the contracts: space, tab to carriage return. Everything else belongs to words.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, with Arrow batches kept small: texts may be megabytes long."""
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def ensure_shared(spark: SparkSession) -> None:
    """Name a shared folder where the session has none, as in tests on one machine."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gradeloom-llm-"))


_staged: list[str] | None = None  # tables of the job that is being put together, if it keeps account of them


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: a later loss of executors does not reach behind it."""
    ensure_shared(df.sparkSession)
    path = session.scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if _staged is not None:
        _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def recorded(tables: list[str]):
    """Note in ``tables`` what is staged inside, for :func:`drop_tables`; what is left of it counts for the record outside too."""
    global _staged
    outer, _staged = _staged, tables
    try:
        yield
    finally:
        _staged = outer
        if outer is not None and outer is not tables:
            outer.extend(tables)


def forget(*needed: DataFrame) -> None:
    """Delete what the innermost record has noted, but for the tables that ``needed`` read."""
    if _staged is not None:
        drop_tables(_staged, *needed)


def drop_tables(tables: list[str], *needed: DataFrame) -> None:
    """Delete staged tables but those that ``needed`` read, and take them off the list."""
    spark = needed[0].sparkSession
    files = [f for df in needed for f in df.inputFiles()]
    for path in list(tables):
        if any(path.rsplit("/", 1)[1] in f for f in files):
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        tables.remove(path)


def whole_row(df: DataFrame) -> Column:
    """A row as one struct, so that working columns cannot clash with its names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")
