"""Describing columns: profiles, counts, quantiles, histograms, skewness, correlation."""

from __future__ import annotations

import math

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.operators.ordered import exact_quantiles, null_safe
from gradeloom.session import stage


def _long(df: DataFrame, rows: list[Column]) -> DataFrame:
    """One aggregate row, turned into one row per struct."""
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def column_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, n_rows) from one pass over the table."""
    return _long(
        df,
        [
            F.struct(
                F.lit(name).alias("column"),
                F.lit(dtype).alias("dtype"),
                F.count(name).alias("non_null"),
                F.count(F.lit(1)).alias("n_rows"),
            )
            for name, dtype in df.dtypes
        ],
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): exact quantiles."""
    found = exact_quantiles(df, column, shares)
    return df.sparkSession.createDataFrame(list(zip(shares, found)), "share DOUBLE, value DOUBLE")


def bin_ranges(values: DataFrame, bins: int, group: list[str], column: str = "x") -> DataFrame:
    """(group, start, width): equal bins from the smallest to the largest value; one value alone gets a range of 1."""
    extremes = values.groupBy(*group).agg(F.min(column).alias("a"), F.max(column).alias("b")).filter(F.col("a").isNotNull())
    single = F.col("a") == F.col("b")
    return extremes.select(
        *group,
        F.when(single, F.col("a") - 0.5).otherwise(F.col("a")).alias("start"),
        (F.when(single, F.lit(1.0)).otherwise(F.col("b") - F.col("a")) / bins).alias("width"),
    )


def bin_number(x: Column, start: Column, width: Column, bins: int) -> Column:
    """The bin of a value; the last bin is closed."""
    return F.least(F.floor((x - start) / width), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int, group: list[str] | None = None) -> DataFrame:
    """Equal-width histogram from smallest to largest value, empty bins included.

    With ``group``, every group has its own range; null is a group of its own. Rows
    are counted per bin before anything is shuffled.
    """
    group = group or []
    values = df.select(*group, F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    # written once: it is used twice, and its real size decides between a broadcast and a shuffle
    ranges = stage(bin_ranges(values, bins, group), "ranges")
    if group:
        placed = null_safe(values, ranges, group)
    else:
        range_of = ranges.select(F.struct("start", "width")).scalar()
        placed = values.withColumn("_r", range_of).select("x", "_r.start", "_r.width")
    counted = (
        placed.withColumn("bin", bin_number(F.col("x"), F.col("start"), F.col("width"), bins))
        .groupBy(*group, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return null_safe(frame, counted, [*group, "bin"], "left").select(
        *group,
        "bin",
        (F.col("start") + F.col("bin") * F.col("width")).alias("lo"),
        (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def histogram_by_score(df: DataFrame, column: str, score: str, bins: int) -> DataFrame:
    """Histograms of the rows above the median score and of the others."""
    median = exact_quantiles(df, score, [0.5])[0]
    return histogram(df.withColumn("high_score", F.col(score) > F.lit(median)), column, bins, ["high_score"])


def skewness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, skewness), bias-adjusted, most skewed first; null below three values."""

    def adjusted(c: str) -> Column:
        n = F.count(c).cast("double")
        return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n != 2, n - 2))

    rows = [F.struct(F.lit(c).alias("column"), adjusted(c).alias("skewness")) for c in columns]
    return _long(df, rows).orderBy(F.desc_nulls_last("skewness"), "column")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) for every ordered pair, from one pass over the table."""
    rows = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("correlation"))
        for a, b in combinations_with_replacement(columns, 2)
    ]
    upper = _long(df, rows)
    both = F.when(
        F.col("a") == F.col("b"), F.array(F.struct("a", "b", "correlation"))
    ).otherwise(
        F.array(
            F.struct("a", "b", "correlation"),
            F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "correlation"),
        )
    )
    return upper.select(F.inline(both))


def weight_summary(df: DataFrame, column: str = "weight") -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"))


def submission_totals(df: DataFrame, user: str = "user_id") -> DataFrame:
    return df.agg(F.count_distinct(user).alias("total_users"), F.count(F.lit(1)).alias("total_submissions"))


# --- quantiles from stored sketches ----------------------------------------------------


def sketch_size(rank_error: float) -> int:
    """Size of a KLL sketch whose quantiles are off by at most this share of the rows, with 99 % confidence."""
    return max(8, min(65_535, math.ceil((2.296 / rank_error) ** (1 / 0.9723))))


def quantile_sketches(df: DataFrame, columns: list[str], by: list[str], rank_error: float = 0.005) -> DataFrame:
    """(by, column, n, sketch): a mergeable sketch of each column for each part of the rows, to be stored.

    An opt-in beside the exact quantiles: once the parts of a day are written, quantiles of any
    span of parts come from ``merged_quantiles`` without reading rows again. Nulls are left out.
    """
    size = sketch_size(rank_error)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*by, F.inline(pairs)).filter(F.col("v").isNotNull())
    return long.groupBy(*by, "column").agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", size).alias("sketch"))


def merged_quantiles(sketches: DataFrame, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, column, n, share, value): quantiles of the rows behind all sketches of a column and group."""
    merged = sketches.groupBy(*(by or []), "column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    asked = F.array(*[F.lit(float(p)) for p in shares])
    found = F.arrays_zip(asked.alias("share"), F.kll_sketch_get_quantile_double("sketch", asked).alias("value"))
    return merged.select(*(by or []), "column", "n", F.inline(found))
