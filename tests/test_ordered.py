"""Distributed ordered operators against plain pandas/NumPy, with tiny ranges to force the distributed path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import ordered
from gradeloom.operators.ordered import exact_quantiles, moving_mean, running_totals, widest_positive_runs, with_rank


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame(
        {
            "g": np.where(np.arange(n) < 2000, "hot", np.where(np.arange(n) < 2995, "mid", "tiny")),
            "x": np.round(rng.exponential(3, n), 1),
            "s": rng.integers(-20, 21, n).astype(float),
            "k": np.arange(n),
        }
    )
    pdf.loc[pdf.index % 3 == 0, "x"] = 0.0  # one value holds a third of the rows
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("ranges", [None, 1, 18])
def test_running_totals(frame, ranges):
    pdf, df = frame
    got = (
        running_totals(df, ["g"], ["x", "k"], {"upto": F.col("s"), "r": F.lit(1)}, {"next_k": "k"}, ranges=ranges)
        .toPandas()
        .sort_values(["g", "x", "k"])
        .reset_index(drop=True)
    )
    want = pdf.sort_values(["g", "x", "k"]).reset_index(drop=True)
    assert len(got) == len(want)
    assert np.allclose(got["upto"], want.groupby("g")["s"].cumsum())
    assert (got["r"] == want.groupby("g").cumcount() + 1).all()
    assert (got["next_k"].fillna(-1) == want.groupby("g")["k"].shift(-1).fillna(-1)).all()


def runs_by_hand(part, window):
    part = part.sort_values(["x", "k"])
    x, s = part["x"].to_numpy(), part["s"].to_numpy()
    n, best, start = len(x), None, None
    behind, ahead = window // 2, (window - 1) // 2
    smooth = [s[max(0, i - behind) : i + ahead + 1].sum() / window for i in range(n)]
    for i in range(n + 1):
        on = i < n and smooth[i] >= 0
        if on and start is None:
            start = i
        if not on and start is not None:
            if best is None or x[i - 1] - x[start] > best[1] - best[0]:
                best = (x[start], x[i - 1])
            start = None
    return best


@pytest.mark.parametrize("rows", [10**6, 170, 40])
@pytest.mark.parametrize("window", [4, 5])
def test_widest_runs(frame, rows, window):
    pdf, df = frame
    ranked = with_rank(df, ["g"], ["x", "k"], ranges=18)
    smooth = moving_mean(ranked, ["g"], "s", window, rows_per_block=rows)
    got = {r["g"]: (r["lo"], r["hi"]) for r in widest_positive_runs(smooth, ["g"], "x", window, rows_per_block=rows).collect()}
    for g, part in pdf.groupby("g"):
        want = runs_by_hand(part, window)
        assert got[g] == (want or (None, None)), g


@pytest.mark.parametrize("rows", [170, 40])
def test_run_that_spans_every_block(spark, rows):
    df = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("s"), F.col("id").alias("k"))
    ranked = with_rank(df, ["g"], ["x", "k"], ranges=18)
    smooth = moving_mean(ranked, ["g"], "s", 5, rows_per_block=rows)
    row = widest_positive_runs(smooth, ["g"], "x", 5, rows_per_block=rows).first()
    assert (row["lo"], row["hi"]) == (0.0, 999.0)


@pytest.mark.parametrize("listed,accuracy", [(100_000, 100_000), (60, 100_000), (60, 50)])
def test_exact_quantiles(spark, frame, monkeypatch, listed, accuracy):
    """Also where brackets are wide and hold more values than may be listed, so that they are bracketed again."""
    monkeypatch.setattr(ordered, "LISTED_VALUES", listed)
    monkeypatch.setattr(ordered, "ACCURACY", accuracy)
    pdf, df = frame
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, "x", shares)
    assert np.allclose(got, pdf["x"].quantile(shares).to_numpy())
    x = np.random.default_rng(3).normal(size=4000).round(2)
    some = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "x DOUBLE").repartition(3)
    assert np.allclose(exact_quantiles(some, "x", [0.013, 0.5, 0.977]), np.quantile(x, [0.013, 0.5, 0.977]))
    for n in (2, 3, 7, 50, 215, 999):
        assert np.allclose(exact_quantiles(spark.range(n).selectExpr("CAST(id * id AS DOUBLE) AS x"), "x", shares + [0.07, 0.333]), np.quantile(np.arange(n) ** 2, shares + [0.07, 0.333]))
    assert exact_quantiles(some.filter("x IS NULL"), "x", [0.5]) == [None]
    assert exact_quantiles(some.limit(0).union(spark.createDataFrame([(7.5,)], "x DOUBLE")), "x", [0.0, 0.3, 1.0]) == [7.5] * 3
