"""Small column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.fixed_values import LOG_FEATURES, PASCAL_CASE, SNAKE_CASE, STAMP_FORMAT


def owner_of(path: Column) -> Column:
    """Text before the first slash; the whole string where there is none."""
    return F.substring_index(path, "/", 1)


def is_snake_case(name: Column) -> Column:
    return name.rlike(SNAKE_CASE)


def is_pascal_case(name: Column) -> Column:
    return name.rlike(PASCAL_CASE)


def stamp_to_timestamp(stamp: Column) -> Column:
    """Parse ``2026-05-17_17-28-38_UTC`` (session time zone must be UTC)."""
    return F.to_timestamp(stamp, STAMP_FORMAT)


def timestamp_to_stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP_FORMAT)


def inverse_log(df: DataFrame, columns: list[str] = LOG_FEATURES) -> DataFrame:
    """Undo log1p on the given columns."""
    return df.withColumns({c: F.expm1(c) for c in columns})


def character_limit(df: DataFrame, column: str = "characters", logged: bool = True) -> DataFrame:
    """One row: the longest file, to whole thousands, halves to even."""
    longest = F.max(column)
    if logged:
        longest = F.expm1(longest)
    return df.agg(F.bround(longest.cast("bigint"), -3).cast("bigint").alias("char_limit"))


def with_over_limit(df: DataFrame, limit: DataFrame, column: str = "characters") -> DataFrame:
    """Flag files above the limit; nothing is dropped. ``limit`` is a one-row table."""
    return df.withColumn("over_limit", F.col(column) > limit.scalar())


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, for comparison and display."""
    cols = [
        F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes
    ]
    return df.select(*cols)
