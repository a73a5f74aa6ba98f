"""Bootstraps, out-of-bag predictions and the guided search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import forest as fo
from gradeloom.plans.checks import properties
from gradeloom.sources.registry import Registry


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(400, 2))
    y = 3 * x[:, 0] + (x[:, 1] > 0.5) + rng.normal(scale=0.1, size=400)
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id LONG, a DOUBLE, b DOUBLE, y DOUBLE").repartition(4).cache()


def test_poisson_weights(spark):
    df = spark.range(40_000).select(*[fo.poisson_weight(F.col("id"), t, 7).alias(f"t{t}") for t in range(3)])
    found = df.toPandas()
    for c in found:
        assert abs(found[c].mean() - 1) < 0.02 and abs(found[c].var() - 1) < 0.04
        assert abs((found[c] == 0).mean() - np.exp(-1)) < 0.01 and found[c].max() >= 5
    assert abs(np.corrcoef(found["t0"], found["t1"])[0, 1]) < 0.02
    assert (df.repartition(7).toPandas().sum() == found.sum()).all()


def test_out_of_bag_means_unseen(spark, rows):
    models = fo.fit_bagged(rows, ["a", "b"], "y", "id", trees=6, seed=2, max_depth=6)
    got = {r["id"]: r for r in fo.out_of_bag_predictions(rows, models, ["a", "b"], "id", seed=2).collect()}
    weights = {r["id"]: [r[f"w{t}"] for t in range(6)] for r in rows.select("id", *[fo.poisson_weight(F.col("id"), t, 2).alias(f"w{t}") for t in range(6)]).collect()}
    parts = [{r["id"]: r["prediction"] for r in fo.predict(rows, m, ["a", "b"]).collect()} for m in models]
    for i, w in weights.items():
        unseen = [p[i] for p, n in zip(parts, w) if n == 0]
        assert got[i]["trees"] == len(unseen)
        assert got[i]["prediction"] == (pytest.approx(np.mean(unseen)) if unseen else None)
    judged = [r for r in got.values() if r["trees"]]
    own = fo.predict(rows, models[0], ["a", "b"]).select(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
    error = np.mean([(r["y"] - r["prediction"]) ** 2 for r in judged])
    assert own < error < 0.25 * np.var([r["y"] for r in judged])


def test_proposals_gather_where_trials_were_good():
    space = {"trees": (1, 1000), "max_depth": (1, 30), "min_leaf": (1, 10), "subset": ["sqrt", "log2", "all"]}
    loss = lambda t: abs(t["trees"] - 800) / 1000 + (t["subset"] != "log2")
    seen = []
    while len(seen) < 60:
        new = fo.propose_trials(seen, 5, seed=1, space=space)
        assert new == fo.propose_trials(seen, 5, seed=1, space=space) and len({tuple(t.values()) for t in new}) == 5
        seen += [t | {"cv_rmse": loss(t)} for t in new]
    assert all(space["trees"][0] <= t["trees"] <= space["trees"][1] and 1 <= t["max_depth"] <= 30 for t in seen)
    early, late = seen[:10], seen[-20:]
    assert np.mean([loss(t) for t in late]) < 0.5 * np.mean([loss(t) for t in early])
    assert fo.propose_trials(seen, 5, seed=2, space=space) != fo.propose_trials(seen, 5, seed=1, space=space)


def test_a_stopped_search_goes_on(spark, rows, tmp_path):
    space = {"trees": (1, 3), "max_depth": (1, 5), "min_leaf": (1, 9), "subset": ["all"]}
    registry = Registry(spark, str(tmp_path))
    search = lambda n, study: fo.guided_search(rows, ["a", "b"], "y", "id", n, 2, 2, seed=3, space=space, registry=registry, study=study)
    search(3, "a")
    _, one, best = search(5, "a")
    _, two, _ = search(4, "b")
    one_rows, two_rows = one.sort("trial").collect(), two.sort("trial").collect()
    assert [tuple(r)[:-1] for r in one_rows[:4]] == [tuple(r)[:-1] for r in two_rows]
    # sums of a fit are added up in the order in which tasks end
    assert [r["cv_rmse"] for r in one_rows[:4]] == pytest.approx([r["cv_rmse"] for r in two_rows])
    assert registry.trials_of("a").count() == 5
    least = min(one.collect(), key=lambda r: (r["cv_rmse"], r["trial"]))
    assert best == {c: least[c] for c in best}


def test_a_search_stores_only_what_fits_read(spark, monkeypatch):
    stored = []
    keep = fo.stage
    monkeypatch.setattr(fo, "stage", lambda df, name: stored.append(df.columns) or keep(df, name))
    rows = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 2.0).alias("y"), F.lit(1.0).alias("w"), F.lit("long").alias("text"))
    trials = [{"trees": 1, "max_depth": 1, "min_leaf": 1, "subset": "all"}]
    fo.search_forest(rows, ["a"], "y", "id", trials, folds=2, weight="w")
    fo.search_forest(rows, ["a"], "y", "id", trials, folds=2)
    assert stored == [["features", "y", "w", "fold"], ["features", "y", "fold"]]


def test_a_guided_search_stores_its_rows_once(spark, monkeypatch):
    """However many rounds there are; and its scores are the errors of models fitted without the fold."""
    stored = []
    keep = fo.stage
    monkeypatch.setattr(fo, "stage", lambda df, name: stored.append(df.columns) or keep(df, name))
    rows = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 2.0).alias("y"), F.lit(1.0).alias("w"), F.lit("long").alias("text"))
    space = {"trees": (1, 1), "max_depth": (0, 0), "min_leaf": (1, 1), "subset": ["all"]}
    _, table, _ = fo.guided_search(rows, ["a"], "y", "id", 3, 1, 2, weight="w", space=space)
    assert stored == [["features", "y", "w", "fold"]]
    folds = fo.with_fold(rows, "id", 2, 0).groupBy("fold").agg(F.avg("y").alias("mean"), F.collect_list("y").alias("ys")).collect()
    # trees without a split that are fitted on a bootstrap lie near the mean of the other fold
    around = np.mean([np.sqrt(np.mean((np.array(one["ys"]) - other["mean"]) ** 2)) for one, other in (folds, folds[::-1])])
    assert all(abs(r["cv_rmse"] - around) < 0.25 * around for r in table.collect())


def test_leaves_that_hold_rows(spark):
    """Against plain comparisons: leaves that overlap, miss rows, or have no bound at all."""
    inf = float("inf")
    leaves = [(0, 1.0, {0: (-inf, 2.0)}), (0, 5.0, {0: (2.0, inf), 1: (0.0, 3.0)}), (1, 7.0, {}), (2, 9.0, {2: (1.0, 4.0)})]
    lo, hi = (np.array([[sides.get(f, (-inf, inf))[i] for f in range(3)] for _, _, sides in leaves]) for i in (0, 1))
    free = np.array([[f not in sides for f in range(3)] for _, _, sides in leaves])
    held = properties._held_by(spark.sparkContext.broadcast((lo, hi, free, np.array([t for t, _, _ in leaves]), np.array([v for _, v, _ in leaves]))))
    rows = [(float(a), float(b), float(c)) for a in (1, 2, 3) for b in (0, 3, 4) for c in (1, 2, 5)]
    for r in spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE").select("a", "b", "c", held("a", "b", "c").alias("h")).collect():
        inside = [(t, v) for t, v, sides in leaves if all(x < r[f] <= y for f, (x, y) in sides.items())]
        assert (r.h.trees, r.h.leaves) == (len({t for t, _ in inside}), len(inside)) and abs(r.h.mean - sum(v for _, v in inside) / len(inside)) < 1e-12


def test_drawn_rows_have_a_weight(spark):
    drawn = spark.range(20_000).select(*[(fo.is_drawn(F.col("id"), t, 3) == (fo.poisson_weight(F.col("id"), t, 3) > 0)).alias(f"t{t}") for t in range(3)])
    assert drawn.filter("not (t0 and t1 and t2)").count() == 0


def test_bagging_stores_only_what_fits_read(spark, monkeypatch):
    stored = []
    keep = fo.stage
    monkeypatch.setattr(fo, "stage", lambda df, name: stored.append(df.columns) or keep(df, name))
    rows = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 2.0).alias("y"), F.lit(1.0).alias("w"), F.lit("long").alias("text"))
    fo.fit_bagged(rows, ["a"], "y", "id", trees=1, max_depth=1)
    fo.fit_bagged(rows, ["a"], "y", "id", trees=1, max_depth=1, weight="w")
    assert stored == [["features", "y", "id"], ["features", "y", "id", "w"]]
