"""Ordered computations over groups of any size.

A window over one group runs in one task, whatever the group's size. Here the
rows are range-partitioned on (group, order) first, each range is processed on
its own, and only one summary row per range is combined across ranges. So a
group that holds a third of all rows is spread like any other data.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradeloom.session import stage

ROWS_PER_BLOCK = 1_000_000


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys in which null equals null; the keys are kept once, from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    totals: dict[str, Column],
    following: dict[str, str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add inclusive running sums within each group, in the given order.

    ``totals`` maps new columns to the expression summed; ``following`` maps new
    columns to a column whose value in the next row is wanted. ``order`` must
    identify rows within a group. A null in the group columns is a group like any
    other, and a sum is null until its first value. Rows are cut into ``ranges``,
    as many as the session has shuffle partitions where nothing is said.
    """
    following = following or {}
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prepared = df.withColumns({f"_add_{k}": v for k, v in totals.items()})
    chunked = stage(
        prepared.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()),
        "ordered",
    )
    # one row per (group, range): bounded by ranges + groups, never by rows
    per_range = chunked.groupBy(*group, "_range").agg(
        *[F.sum(f"_add_{k}").alias(f"_sum_{k}") for k in totals],
        *[F.min_by(F.struct(c), F.struct(*order)).alias(f"_first_{k}") for k, c in following.items()],
    )
    across = W.partitionBy(*(group or [F.lit(0)])).orderBy("_range")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    summary = per_range.select(
        *group,
        "_range",
        *[F.sum(f"_sum_{k}").over(before).alias(f"_before_{k}") for k in totals],
        *[F.lead(f"_first_{k}").over(across).alias(f"_next_{k}") for k in following],
    )
    w = W.partitionBy(*group, "_range").orderBy(*order)
    up_to = w.rowsBetween(W.unboundedPreceding, 0)

    def total(name):
        own, earlier = F.sum(f"_add_{name}").over(up_to), F.col(f"_before_{name}")
        return F.when(earlier.isNull(), own).when(own.isNull(), earlier).otherwise(own + earlier)

    def next_value(name, column):
        # a struct tells a last row of its range from a next value that is null
        return F.coalesce(F.lead(F.struct(column)).over(w), F.col(f"_next_{name}"))[column]

    return null_safe(chunked, summary, [*group, "_range"]).select(
        *df.columns,
        *[total(k).alias(k) for k in totals],
        *[next_value(k, c).alias(k) for k, c in following.items()],
    )


def with_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """Row number within the group, for groups of any size."""
    return running_totals(df, group, order, {name: F.lit(1).cast("bigint")}, ranges=ranges)


def _block_size(window: int, rows_per_block: int) -> int:
    return max(rows_per_block, window + 1)


def moving_mean(
    df: DataFrame, group: list[str], value: str, window: int, name: str = "smooth", rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Centred moving mean over consecutive ranks; what lies past the ends counts as zero.

    ``df`` carries ``rank`` from ``with_rank``. Rows are cut into blocks of
    consecutive ranks, and the few rows next to a cut are also sent to the
    neighbouring block, so each block is complete on its own. Adds ``_block``.
    """
    behind, ahead = window // 2, (window - 1) // 2
    reach = max(behind, ahead)
    size = _block_size(window, rows_per_block)
    at = F.col("rank") - 1

    def block(position):
        return F.floor(position / size)

    spread = df.withColumn("_home", block(at)).withColumn(
        "_block",
        F.explode(F.array_distinct(F.array(F.col("_home"), block(F.greatest(at - reach, F.lit(0))), block(at + reach)))),
    )
    w = W.partitionBy(*group, "_block").orderBy("rank").rowsBetween(-behind, ahead)
    return (
        spread.withColumn(name, F.sum(value).over(w) / window)
        .filter(F.col("_block") == F.col("_home"))
        .select(*df.columns, "_block", name)
    )


def widest_positive_runs(
    df: DataFrame, group: list[str], value: str, window: int, smooth: str = "smooth", rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Per group, the run of consecutive ranks with ``smooth >= 0`` that spans most of ``value``.

    Ties go to the earliest run; a group without any run has null bounds. ``df``
    comes from ``moving_mean`` and is sorted by ``value`` in rank order. Runs are
    found inside each block; only pieces that touch a block's edge (two per block
    at most) are put together across blocks.
    """
    size = _block_size(window, rows_per_block)
    positive = F.col(smooth) >= 0
    numbered = df.withColumn("_on", positive).withColumn(
        "_island", F.col("rank") - F.row_number().over(W.partitionBy(*group, "_block", "_on").orderBy("rank"))
    )
    pieces = (
        numbered.groupBy(*group, "_block", "_on", "_island")
        .agg(
            F.min("rank").alias("first"),
            F.max("rank").alias("last"),
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
        )
        .withColumn("_edge", ((F.col("first") - 1) % size == 0) | (F.col("last") % size == 0))
    )
    inner = pieces.filter(~F.col("_edge") | ~F.col("_on")).withColumn("_ok", F.col("_on"))
    edge = pieces.filter(F.col("_edge") & F.col("_on"))
    by_rank = W.partitionBy(*group).orderBy("first")
    joined = (
        edge.withColumn("_new", F.coalesce(F.col("first") != F.lag("last").over(by_rank) + 1, F.lit(True)).cast("int"))
        .withColumn("_run", F.sum("_new").over(by_rank))
        .groupBy(*group, "_run")
        .agg(F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("_ok", F.lit(True))
    )
    columns = [*group, "first", "lo", "hi", "_ok"]
    best = F.max(
        F.when(
            F.col("_ok"),
            F.struct((F.col("hi") - F.col("lo")).alias("width"), (-F.col("first")).alias("early"), "lo", "hi"),
        )
    )
    return (
        inner.select(*columns)
        .unionByName(joined.select(*columns))
        .groupBy(*group)
        .agg(best.alias("_best"))
        .select(*group, F.col("_best.lo").alias("lo"), F.col("_best.hi").alias("hi"))
    )


#: Values that a bracket of a quantile may list, and accuracy of the sketch that brackets it.
LISTED_VALUES, ACCURACY = 100_000, 100_000


def _bracket(values: DataFrame, shares: list[float]) -> tuple[int, list[tuple[float, float]]]:
    """Number of values, and for each share two of them between which its quantile lies."""
    slack = 2.0 / ACCURACY
    near = sorted({min(max(p + d, 0.0), 1.0) for p in shares for d in (-slack, slack)})
    head = values.agg(F.count("v").alias("n"), F.percentile_approx("v", near, ACCURACY).alias("q")).first()
    at = dict(zip(near, head["q"] or []))
    return head["n"], [(at[max(p - slack, 0.0)], at[min(p + slack, 1.0)]) for p in shares] if head["n"] else []


def _listed(values: DataFrame, brackets: list[tuple[float, float]]) -> list[tuple] | None:
    """(rows, smallest, largest) in order: values inside the brackets one by one, those between them together; None if there are too many."""
    merged: list[list[float]] = []
    for lo, hi in sorted(brackets):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    gap = reduce(add, [(F.col("v") > hi).cast("int") for _, hi in merged])
    inside = reduce(or_, [F.col("v").between(lo, hi) for lo, hi in merged])
    cells = values.groupBy(gap.alias("gap"), F.when(inside, F.col("v")).alias("own"))
    rows = cells.agg(F.count("v").alias("rows"), F.min("v").alias("least"), F.max("v").alias("most")).limit(LISTED_VALUES + 1).collect()
    if len(rows) > LISTED_VALUES:
        return None
    return [(r["rows"], r["least"], r["most"]) for r in sorted(rows, key=lambda r: r["least"])]


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation, of a column of any size.

    A sketch brackets each quantile (its error is a guaranteed share of the rows), and one
    pass counts the values inside the brackets one by one and all others together. Where
    the brackets hold too many different values, each is bracketed again among its own. The
    result is a number, so a filter with it reaches the file scan.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n, brackets = _bracket(values, shares)
    if not n:
        return [None] * len(shares)
    while (listed := _listed(values, brackets)) is None:
        narrower = []
        for p, (lo, hi) in zip(shares, brackets):
            below = values.filter(F.col("v") < lo).count()
            inside = values.filter(F.col("v").between(lo, hi))
            size = inside.count()
            ends = [min(max((rank - below) / max(size - 1, 1), 0.0), 1.0) for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]
            _, found = _bracket(inside, ends)
            narrower.append((found[0][0], found[-1][1]))
        brackets = narrower

    def value_at(rank: int) -> float:
        # a rank next to a bracket, as its rounding may have it, is the last or first of what stands between
        upto = 0
        for rows, least, most in listed:
            if upto == rank or (rank < upto + rows and least == most):
                return float(least)
            if rank == upto + rows - 1:
                return float(most)
            upto += rows
        raise AssertionError(f"rank {rank} is in no bracket")

    results = []
    for p in shares:
        position = p * (n - 1)
        a, b = value_at(math.floor(position)), value_at(math.ceil(position))
        results.append(a + (b - a) * (position - math.floor(position)))
    return results
