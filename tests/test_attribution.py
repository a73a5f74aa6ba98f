import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import attribution as at
from gradeloom.operators.forest import fit_forest, predict
from gradeloom.schemas import LEAVES

INF = float("inf")
# two trees over three features: (tree, leaf, value, {feature: (lo, hi)})
TREES = [
    (0, 0, 1.0, {0: (-INF, 5.0)}),
    (0, 1, 4.0, {0: (5.0, INF), 1: (-INF, 2.0)}),
    (0, 2, 9.0, {0: (5.0, INF), 1: (2.0, INF)}),
    (1, 0, -2.0, {2: (-INF, 3.0), 0: (-INF, 7.0)}),
    (1, 1, 6.0, {2: (-INF, 3.0), 0: (7.0, INF), 1: (-INF, 1.0)}),
    (1, 2, 0.5, {2: (-INF, 3.0), 0: (7.0, INF), 1: (1.0, INF)}),
    (1, 3, 3.0, {2: (3.0, INF)}),
]


def value(x):
    return sum(v for _, _, v, box in TREES if all(lo < x[f] <= hi for f, (lo, hi) in box.items())) / 2


def brute_force(x, background):
    n = len(x)
    phi = np.zeros(n)
    for z in background:
        for i in range(n):
            others = [j for j in range(n) if j != i]
            for size in range(n):
                for chosen in itertools.combinations(others, size):
                    mixed = [x[j] if j in chosen else z[j] for j in range(n)]
                    with_i = list(mixed)
                    with_i[i] = x[i]
                    w = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    phi[i] += w * (value(with_i) - value(mixed))
    return phi / len(background)


@pytest.mark.parametrize("limit", [2_000_000, 6])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(at, "MASKS_PER_BLOCK", limit)
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, r)) for i, r in enumerate(rng.integers(0, 11, (25, 3)))]
    back = [(i, *map(float, r)) for i, r in enumerate(rng.integers(0, 11, (17, 3)))]
    cols = ["f0", "f1", "f2"]
    schema = "row_id BIGINT, f0 DOUBLE, f1 DOUBLE, f2 DOUBLE"
    leaves = spark.createDataFrame(
        [(t, leaf, v, f, lo, hi) for t, leaf, v, box in TREES for f, (lo, hi) in box.items()], LEAVES
    )
    got = at.attribute(spark.createDataFrame(rows, schema), spark.createDataFrame(back, schema), leaves, cols).collect()
    found = {(r["row_id"], r["pos"]): r["phi"] for r in got}
    assert len(found) == 75
    for i, *x in rows:
        want = brute_force(x, [b[1:] for b in back])
        assert [found[(i, j)] for j in range(3)] == pytest.approx(want, abs=1e-12)


def test_additive_on_a_fitted_forest(spark, tables):
    cols = ["value", "user_id", "k"]
    df = tables.events.withColumn("k", F.get_json_object("props", "$.k").cast("double")).withColumn(
        "label", F.col("value") * 2 + F.when(F.col("k") > 50, F.col("user_id")).otherwise(0)
    )
    model = fit_forest(df, cols, "label", trees=3, max_depth=5)
    leaves = at.leaf_boxes(at.forest_nodes(spark, model))
    phi = at.attribute(df, df, leaves, cols, "event_id").groupBy("row_id").agg(F.sum("phi").alias("phi"))
    predicted = predict(df, model, cols).select(F.col("event_id").alias("row_id"), "prediction")
    mean = predicted.agg(F.avg("prediction")).first()[0]
    worst = phi.join(predicted, "row_id").agg(F.max(F.abs(F.col("phi") + mean - F.col("prediction")))).first()[0]
    assert worst < 1e-9


def test_forest_without_a_split(spark):
    df = spark.range(5).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"), F.lit(1.0).alias("label"))
    model = fit_forest(df, ["a"], "label", trees=2)
    got = at.attribute_forest(df, df, model, ["a"])
    assert {r["phi"] for r in got.collect()} == {0.0}


def test_products_are_bounded_and_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    width = 12
    leaf = at._Leaf(2.0, np.arange(width), np.zeros(width), np.ones(width))
    ours = np.unique(rng.integers(0, 1 << width, 300))
    masks = np.unique(rng.integers(0, 1 << width, 400))
    background = at._Masks(masks, np.full(len(masks), 1 / len(masks)))
    whole = at._leaf_effect(leaf, ours, background, *at._weights(width))
    sizes = []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: sizes.append(x.size * width) or count(x))
    monkeypatch.setattr(at, "PRODUCTS", 5000)
    assert np.allclose(at._leaf_effect(leaf, ours, background, *at._weights(width)), whole)
    assert max(sizes) <= 5000


def test_missing_values_count_alike_in_rows_and_background(spark):
    leaves = spark.createDataFrame([(0, 0, 1.0, 0, -float("inf"), 0.5), (0, 1, 5.0, 0, 0.5, float("inf"))], at.LEAVES)
    rows = spark.createDataFrame([(1, None), (2, 1.0)], "row_id LONG, x DOUBLE")
    phi = {r.row_id: r.phi for r in at.attribute(rows, rows, leaves, ["x"]).collect()}
    assert phi == {1: -2.0, 2: 2.0}


def test_long_paths_are_refused(spark):
    leaves = spark.createDataFrame([(0, 0, 1.0, f, 0.0, 1.0) for f in range(63)], at.LEAVES)
    rows = spark.createDataFrame([(1, *[0.5] * 63)], "row_id LONG, " + ", ".join(f"f{i} DOUBLE" for i in range(63)))
    with pytest.raises(ValueError):
        at.Explainer(rows, leaves, [f"f{i}" for i in range(63)])


def _random_leaves(rng, n, features):
    leaves, backgrounds = [], []
    for _ in range(n):
        width = int(rng.integers(1, features + 1))
        cuts = np.sort(rng.integers(0, 9, (width, 2)).astype(float), axis=1)
        lo, hi = np.where(cuts[:, 0] == 0, -INF, cuts[:, 0]), np.where(rng.random(width) < 0.3, INF, cuts[:, 1] + 1)
        leaves.append(at._Leaf(float(rng.normal()), np.sort(rng.choice(features, width, replace=False)), lo, hi))
        masks = np.unique(rng.integers(0, 1 << width, 1 + (1 << width) // 2))
        backgrounds.append(at._Masks(masks, rng.random(len(masks)) / len(masks)))
    return leaves, backgrounds


def test_masks_by_interval_are_those_of_comparisons():
    rng = np.random.default_rng(5)
    leaves, _ = _random_leaves(rng, 60, 11)
    x = rng.integers(0, 11, (11, 300)).astype(float)
    x[:, :5], x[:, 5], x[:, 6] = np.nan, INF, -INF
    for leaf, found in zip(leaves, at._Boxes(leaves).masks(x)):
        inside = (x[leaf.features] > leaf.lo[:, None]) & (x[leaf.features] <= leaf.hi[:, None])
        assert (found == (inside.astype(np.int64) << np.arange(len(leaf.features))[:, None]).sum(axis=0)).all()


@pytest.mark.parametrize("room", [10**9, 3000, 0])
def test_tables_of_effects_are_the_products_summed_up(monkeypatch, room):
    """Every leaf whose table may be worked out never compares masks pair by pair, kept or not."""
    rng = np.random.default_rng(6)
    leaves, backgrounds = _random_leaves(rng, 40, 8)
    x = rng.integers(0, 11, (8, 500)).astype(float)
    want = np.zeros_like(x)
    for leaf, background, masks in zip(leaves, backgrounds, at._Boxes(leaves).masks(x)):
        part = at._leaf_effect(leaf, masks.astype(np.int64), background, *at._weights(8))
        want[leaf.features] += part.T
    monkeypatch.setattr(at, "_leaf_effect", None)
    known, twice = at._Effects(leaves, backgrounds, room), np.zeros_like(x)
    known.add_to(twice, x)
    known.add_to(twice, x)
    assert np.allclose(twice, 2 * want, atol=1e-12)
    assert sum(t.size for t in known.tables.values()) <= room


def test_few_rows_and_long_paths_compare_masks(monkeypatch):
    rng = np.random.default_rng(7)
    leaves, backgrounds = _random_leaves(rng, 20, 10)
    x = rng.integers(0, 11, (10, 2)).astype(float)
    whole, pairs = np.zeros_like(x), np.zeros_like(x)
    at._Effects(leaves, backgrounds, 10**9).add_to(whole, x)
    monkeypatch.setattr(at, "WHOLE_TABLE", 0)
    at._Effects(leaves, backgrounds, 10**9).add_to(pairs, x)
    assert np.allclose(whole, pairs, atol=1e-12)
