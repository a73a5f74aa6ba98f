"""Sample weights and training sets that combine old and new data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.fixed_values import HALF_LIFE_DAYS, TEST_SHARE
from gradeloom.operators.split import hash_boundary, within_boundary

MICROS_PER_DAY = 86_400_000_000


def with_decay_weight(
    df: DataFrame,
    cutoff: Column,
    half_life_days: float = HALF_LIFE_DAYS,
    created_at: str = "created_at",
    name: str = "weight",
) -> DataFrame:
    """Weight halves every ``half_life_days`` before the cutoff; fractions of days count.

    A row after the cutoff fails the job. Every row checks itself, so no second
    pass over the data is needed.
    """
    then = F.col(created_at).cast("timestamp")
    days = (F.unix_micros(cutoff) - F.unix_micros(then)) / MICROS_PER_DAY
    late = F.raise_error(F.lit("some rows have created_at after the given cutoff")).cast("double")
    return df.withColumn(name, F.when(then > cutoff, late).otherwise(F.exp(days * (-math.log(2) / half_life_days))))


def combine(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both on the columns they share; ``is_new`` tells them apart."""
    shared = [c for c in old.columns if c in new.columns]
    return (
        old.select(*shared)
        .withColumn("is_new", F.lit(False))
        .unionByName(new.select(*shared).withColumn("is_new", F.lit(True)))
    )


def fill_created_at(df: DataFrame, run_end: Column, created_at: str = "created_at") -> DataFrame:
    """Data from before submissions were stored dates from the end of the run that used it."""
    if created_at not in df.columns:
        return df.withColumn(created_at, run_end)
    return df


def retrain_split(combined: DataFrame, owner: str, test_share: float = TEST_SHARE, seed: int = 0) -> DataFrame:
    """Mark the test rows of a combined set: only owners of new rows are split, old rows all train."""
    boundary = hash_boundary(combined.filter("is_new"), owner, lambda total: math.ceil(test_share * total), seed)
    return combined.withColumn("is_test", F.col("is_new") & within_boundary(F.col(owner), boundary, seed))
