"""Regression metrics, residuals and the rows a model does best and worst on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.operators.profile import bin_number, bin_ranges


def _metric_columns(label: Column, prediction: Column) -> list[Column]:
    error = label - prediction
    n = F.count(error)
    squares = F.sum(error * error)
    spread = F.var_pop(F.when(error.isNotNull(), label)) * n
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(squares / F.when(n > 0, n)).alias("rmse"),
        (1 - squares / F.when(spread != 0, spread)).alias("r2"),
    ]


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", group: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R² in one aggregation, over all rows or per group."""
    return df.groupBy(*(group or [])).agg(*_metric_columns(F.col(label).cast("double"), F.col(prediction).cast("double")))


def metrics_as_text(df: DataFrame) -> DataFrame:
    """The metrics with three decimals, as text."""
    return df.withColumns({c: F.format_string("%.3f", F.col(c)) for c in ("mae", "rmse", "r2")})


def mean_baseline(df: DataFrame, label: str, is_test: str = "is_test") -> DataFrame:
    """Metrics of always predicting the training mean, on both sides of a split."""
    mean = df.filter(~F.col(is_test)).agg(F.avg(label)).scalar()
    return metrics(df.withColumn("prediction", mean), label, "prediction", [is_test])


def with_error(df: DataFrame, label: str, prediction: str, name: str = "error") -> DataFrame:
    return df.withColumn(name, F.col(label) - F.col(prediction))


def residual_bins(df: DataFrame, prediction: str, error: str, bins: int = 10) -> DataFrame:
    """Residuals against predictions, binned: count, mean, smallest and largest residual per bin."""
    values = df.select(F.col(prediction).cast("double").alias("x"))
    edges = bin_ranges(values, bins, []).select(F.struct("start", "width")).scalar()
    at = bin_number(F.col(prediction), F.col("_e.start"), F.col("_e.width"), bins)
    return (
        df.withColumn("_e", edges)
        .withColumn("bin", at)
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(error).alias("mean_error"),
            F.min(error).alias("min_error"),
            F.max(error).alias("max_error"),
        )
    )


def top_k(df: DataFrame, error: str, k: int, key: str) -> DataFrame:
    """The ``k`` best, most over-estimated and most under-estimated rows, tagged ``kind``.

    Rows without an error are in none of the lists; ties go to the smaller key. For each
    list a task keeps ``k`` rows at most while it reads, and only those travel.
    """
    kinds = {"top_performing": F.abs(F.col(error)), "over_estimated": F.col(error), "under_estimated": -F.col(error)}
    rows = df.filter(F.col(error).isNotNull())
    lists = [rows.orderBy(rank, key).limit(k).withColumn("kind", F.lit(kind)) for kind, rank in kinds.items()]
    return reduce(DataFrame.unionByName, lists)


def compare_versions(df: DataFrame, label: str, predictions: dict[str, str]) -> DataFrame:
    """Metrics of several models on one test set: ``predictions`` maps version to column."""
    pairs = F.array(*[F.struct(F.lit(v).alias("version"), F.col(c).cast("double").alias("prediction")) for v, c in predictions.items()])
    long = df.select(F.col(label).alias("label"), F.explode(pairs).alias("p")).select("label", "p.*")
    return metrics(long, "label", "prediction", ["version"])
