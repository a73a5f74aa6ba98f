"""Monitoring of a model in use: error decline and feature drift."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.fixed_values import (
    DECLINE_THRESHOLD,
    DISTANCE_THRESHOLD,
    DRIFT_SHARE_THRESHOLD,
    FEW_DISTINCT_VALUES,
    LARGE_REFERENCE_ROWS,
    MIN_REFERENCE_STD,
    P_VALUE_THRESHOLD,
)
from gradeloom.operators.ordered import running_totals
from gradeloom.session import stage

EXCEEDED, NOT_EXCEEDED = "exceeded", "did not exceed"


def _verdict(condition: Column) -> Column:
    return F.when(condition, F.lit(EXCEEDED)).otherwise(F.lit(NOT_EXCEEDED))


def performance_decline(
    df: DataFrame, label: str, prediction: str, old_rmse: Column | float, threshold: float = DECLINE_THRESHOLD
) -> DataFrame:
    """One row: stored RMSE, RMSE of the given rows, their difference and the verdict."""
    error = F.col(label) - F.col(prediction)
    old = old_rmse if isinstance(old_rmse, Column) else F.lit(float(old_rmse))
    return (
        df.agg(F.sqrt(F.avg(error * error)).alias("new_rmse"))
        .withColumn("old_rmse", old)
        .withColumn("rmse_diff", F.col("new_rmse") - F.col("old_rmse"))
        .withColumn("rmse_msg", _verdict(F.col("rmse_diff") > threshold * F.col("old_rmse")))
        .select("old_rmse", "new_rmse", "rmse_diff", "rmse_msg")
    )


def value_counts_by_side(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, x, n_ref, n_cur): both samples counted per distinct value.

    Rows are counted before the shuffle, so repeated values cost nothing, however
    many rows share them.
    """

    def side(df: DataFrame, is_ref: int) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
        return df.select(F.explode(pairs).alias("p")).select(
            "p.feature", "p.x", F.lit(is_ref).alias("ref"), F.lit(1 - is_ref).alias("cur")
        )

    return (
        side(reference, 1)
        .unionByName(side(current, 0))
        .filter(F.col("x").isNotNull())
        .groupBy("feature", "x")
        .agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
    )


def distances(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per feature: sizes, distinct values and the distances between the two samples.

    ``wasserstein`` is divided by the reference's standard deviation, ``ks`` is
    the largest gap between the distribution functions, ``jensen_shannon`` uses
    natural logarithms, ``chi_square`` compares observed with expected counts.
    """
    counts = stage(counts, "value-counts")
    # one row per feature; written, so that its real size is known when the join is planned
    sizes = counts.groupBy("feature").agg(
        F.sum("n_ref").alias("ref_rows"),
        F.sum("n_cur").alias("cur_rows"),
        F.count(F.lit(1)).alias("distinct"),
        F.max("x").alias("top"),
        F.sum((F.col("n_ref") > 0).cast("int")).alias("ref_distinct"),
        (F.sum(F.col("x") * F.col("n_ref")) / F.sum("n_ref")).alias("ref_mean"),
    )
    sizes = stage(sizes, "sizes")
    stepped = running_totals(
        counts, ["feature"], ["x"], {"upto_ref": F.col("n_ref"), "upto_cur": F.col("n_cur")}, {"next_x": "x"}, ranges
    )
    p, q = F.col("n_ref") / F.col("ref_rows"), F.col("n_cur") / F.col("cur_rows")
    middle = (p + q) / 2
    gap = F.abs(F.col("upto_ref") / F.col("ref_rows") - F.col("upto_cur") / F.col("cur_rows"))

    def entropy(share: Column) -> Column:
        return F.when(share > 0, share * F.ln(share / middle)).otherwise(0.0)

    expected = p * F.col("cur_rows")
    off = F.col("x") - F.col("ref_mean")
    # one row per feature: the number of features bounds this table
    return (
        stepped.join(sizes, "feature")
        .groupBy("feature")
        .agg(
            F.first("ref_rows").alias("ref_rows"),
            F.first("cur_rows").alias("cur_rows"),
            F.first("distinct").alias("distinct"),
            F.first("ref_distinct").alias("ref_distinct"),
            F.sqrt(F.sum(off * off * F.col("n_ref")) / F.first("ref_rows")).alias("ref_std"),
            F.coalesce(F.sum(gap * (F.col("next_x") - F.col("x"))), F.lit(0.0)).alias("raw_wasserstein"),
            F.max(gap).alias("ks"),
            F.sqrt(F.greatest(F.sum(entropy(p) + entropy(q)) / 2, F.lit(0.0))).alias("jensen_shannon"),
            F.sum((F.col("n_cur") - expected) * (F.col("n_cur") - expected) / F.when(expected > 0, expected)).alias("chi_square"),
            # share of the larger value, for features that have two
            F.sum(F.when(F.col("x") == F.col("top"), p).otherwise(0.0)).alias("ref_share"),
            F.sum(F.when(F.col("x") == F.col("top"), q).otherwise(0.0)).alias("cur_share"),
        )
        .withColumn("wasserstein", F.col("raw_wasserstein") / F.greatest("ref_std", F.lit(MIN_REFERENCE_STD)))
        .drop("raw_wasserstein")
    )


MOST_EXACT_ROWS = 10_000  # of the larger sample; beyond that the limit distribution is as good


def kolmogorov_p_value(gap: float, n: int, m: int) -> float:
    """Two-sided p-value of the two-sample Kolmogorov-Smirnov statistic: exact for samples of up to ``MOST_EXACT_ROWS``."""
    if max(n, m) <= MOST_EXACT_ROWS:
        return exact_kolmogorov_p_value(gap, n, m)
    return limit_kolmogorov_p_value(gap, n, m)


def exact_kolmogorov_p_value(gap: float, n: int, m: int) -> float:
    """Share of the orders of n and m values whose distribution functions are at least ``gap`` apart somewhere.

    An order is a lattice path from (0, 0) to (n, m), and all paths are equally likely. Step
    by step, ``inside`` is the probability that a path has come to a point of the diagonal and
    has never left the band between the bounds. These are probabilities and not counts, so
    none of those that matter is too large or too small for a double.
    """
    n, m = sorted((int(n), int(m)))
    # gaps are multiples of 1 / (n * m); half a step below the given one separates smaller from equal ones
    bound = math.floor(gap * n * m + 1e-7) - 0.5
    if bound < 0:
        return 1.0
    at = np.arange(n + 1)
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    for step in range(1, n + m + 1):
        left = n + m - step + 1
        other = step - at  # how many of the larger sample have come
        moved = inside * np.clip(m - other + 1, 0, None) / left
        moved[1:] += inside[:-1] * (n - at[:-1]) / left
        moved[(other < 0) | (other > m) | (np.abs(at * m - other * n) > bound)] = 0.0
        inside = moved
    return min(1.0, max(0.0, 1.0 - float(inside[n])))


def limit_kolmogorov_p_value(gap: float, n: int, m: int) -> float:
    """The same in the limit of large samples."""
    t = gap * math.sqrt(n * m / (n + m))
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def chi_square_p_value(statistic: float, freedom: int) -> float:
    """Upper tail of the chi-square distribution for a whole number of degrees of freedom."""
    half = statistic / 2
    if freedom % 2 == 0:
        return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(freedom // 2))
    tail = math.erfc(math.sqrt(half))
    return tail + math.exp(-half) * sum(half ** (i + 0.5) / math.gamma(i + 1.5) for i in range((freedom - 1) // 2))


def two_share_p_value(share_a: float, n: int, share_b: float, m: int) -> float:
    """Two-sided z-test for two proportions."""
    pooled = (share_a * n + share_b * m) / (n + m)
    spread = math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    return 1.0 if spread == 0 else math.erfc(abs(share_a - share_b) / spread / math.sqrt(2))


DRIFT_SCHEMA = "feature STRING, method STRING, value DOUBLE, threshold DOUBLE, drifted BOOLEAN"


def drift(
    reference: DataFrame, current: DataFrame, features: list[str], ranges: int | None = None
) -> DataFrame:
    """(feature, method, value, threshold, drifted) with the test that fits the sample.

    Large references (over 1 000 rows) use distances, small ones p-values; a
    distance drifts when it is large, a p-value when it is small. All counting
    is done by Spark; the driver sees one row of numbers per feature.
    """
    measured = distances(value_counts_by_side(reference, current, features), ranges).collect()
    rows = []
    for r in measured:
        few = r["distinct"] <= FEW_DISTINCT_VALUES
        if not r["ref_rows"] or not r["cur_rows"]:
            rows.append((r["feature"], "none", None, None, None))
            continue
        if r["ref_rows"] > LARGE_REFERENCE_ROWS:
            method = "jensen_shannon" if few else "wasserstein"
            value = r[method]
            rows.append((r["feature"], method, value, DISTANCE_THRESHOLD, value >= DISTANCE_THRESHOLD))
            continue
        if not few:
            method, value = "ks", kolmogorov_p_value(r["ks"], r["ref_rows"], r["cur_rows"])
        elif r["distinct"] > 2:
            # a value the reference never has makes the statistic infinite
            unseen = r["distinct"] > r["ref_distinct"]
            method, value = "chi_square", 0.0 if unseen else chi_square_p_value(r["chi_square"], r["distinct"] - 1)
        else:
            method = "z_test"
            value = two_share_p_value(r["ref_share"], r["ref_rows"], r["cur_share"], r["cur_rows"])
        rows.append((r["feature"], method, value, P_VALUE_THRESHOLD, value < P_VALUE_THRESHOLD))
    return reference.sparkSession.createDataFrame(rows, DRIFT_SCHEMA)


def drift_share(drifts: DataFrame, threshold: float = DRIFT_SHARE_THRESHOLD) -> DataFrame:
    """One row: share of drifted features, the verdict and the drifted features with their values."""
    listed = F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.struct("feature", "value"))))
    )
    return drifts.agg(F.avg(F.col("drifted").cast("double")).alias("share"), listed.alias("drifts")).select(
        "share", _verdict(F.col("share") > threshold).alias("drift_msg"), "drifts"
    )


def monitoring_record(decline: DataFrame, shares: DataFrame, version: str, stamp: str) -> DataFrame:
    """One row per report, from the two one-row tables above."""
    parts = shares.select(F.struct("*")).scalar()
    return decline.withColumn("_d", parts).select(
        F.lit(version).alias("model_version"),
        F.lit(stamp).alias("stamp"),
        *decline.columns,
        *[F.col(f"_d.{c}").alias(c) for c in shares.columns],
    )
