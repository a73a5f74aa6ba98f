"""Properties of fitted models, stored models, and rows with nulls, repeats or late arrival.

Fitted forests, clusters and projections have no SQL, but what must hold for each of their
rows has: the queries return it, the SQL says for which rows it must be true.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gradeloom.operators import attribution as at
from gradeloom.operators import curate, evaluate, profile, vectors
from gradeloom.operators import recommend as rec
from gradeloom.operators.forest import (
    feature_importance,
    fit_bagged,
    fit_forest,
    guided_search,
    out_of_bag_predictions,
    out_of_fold_predictions,
    predict,
    search_forest,
)
from gradeloom.operators.monitor import performance_decline
from gradeloom.operators.ordered import with_rank
from gradeloom.operators.split import NULL_KEY, with_split
from gradeloom.plans.checks.attribution import _fitted
from gradeloom.plans.checks.attribution import COLUMNS as EVENT_COLUMNS
from gradeloom.plans.checks.splits import COLUMNS, LABEL, _lines
from gradeloom.plans.checks.tables import SUBMISSIONS, events, submissions, table
from gradeloom.functions.scalars import owner_of
from gradeloom.session import scratch_path, stage
from gradeloom.sources import published
from gradeloom.sources.registry import Registry
from gradeloom.sources.submissions import read_submissions
from gradeloom.streaming.jobs import start_scoring, submission_stream


# --- fitted models ---------------------------------------------------------------------

PRICE = "net_price"


def _priced(spark, folder):
    """Line items with a label that follows from their features but for a little noise."""
    return _lines(spark, folder).withColumn(PRICE, F.col("l_quantity") * 1000 * (1 - F.col("l_discount")) + F.col(LABEL) / 100)


def forest_beats_mean(spark, folder):
    """On both sides of a split the forest's RMSE is below that of the training mean."""
    marked = stage(with_split(_priced(spark, folder), "l_orderkey", 0.3, 0), "lines")
    model = fit_forest(marked.filter("not is_test"), COLUMNS, PRICE, trees=10, max_depth=8)
    own = evaluate.metrics(predict(marked, model, COLUMNS), PRICE, group=["is_test"]).select("is_test", "rmse")
    base = evaluate.mean_baseline(marked, PRICE).select("is_test", F.col("rmse").alias("base"))
    return own.join(base, "is_test").select("is_test", (F.col("rmse") < F.col("base")).alias("better"))


def zero_weights(spark, folder):
    """Labels of rows without weight move no prediction."""
    rows = stage(events(spark, folder).select("event_id", F.col("user_id").cast("double").alias("user"), "k", "value", (F.col("k") < 30).alias("off")), "rows")
    rows = rows.withColumns({"weight": F.when(F.col("off"), 0.0).otherwise(1.0), "other": F.when(F.col("off"), -1000.0).otherwise(F.col("value"))})
    one, two = (predict(rows, fit_forest(rows, ["user", "k"], y, trees=5, max_depth=5, weight="weight"), ["user", "k"]) for y in ("value", "other"))
    both = one.select("event_id", "prediction").join(two.select("event_id", F.col("prediction").alias("second")), "event_id")
    return both.select("event_id", (F.abs(F.col("prediction") - F.col("second")) < 1e-9).alias("same"))


def best_trial(spark, folder):
    """The chosen trial has the smallest error, and all trials are in the table."""
    trials = [{"trees": 4, "max_depth": d, "min_leaf": m, "subset": "all"} for d, m in ((2, 1), (4, 1), (6, 5))]
    _, scores, best = search_forest(_lines(spark, folder), COLUMNS, LABEL, "row_key", trials, folds=3)
    least = scores.agg(F.min("cv_rmse")).scalar()
    chosen = (F.col("max_depth") == best["max_depth"]) & (F.col("min_leaf") == best["min_leaf"])
    return scores.select("trial", "max_depth", "min_leaf", (chosen == (F.col("cv_rmse") == least)).alias("agrees"))


def held_out_predictions(spark, folder):
    """Every line item is predicted once, and together better than by the mean."""
    oof = stage(out_of_fold_predictions(_priced(spark, folder), COLUMNS, PRICE, "row_key", folds=3, trees=4, max_depth=6), "oof")
    better = oof.agg(F.sum(F.pow(F.col(PRICE) - F.col("prediction"), 2)) < F.var_pop(PRICE) * F.count("*")).scalar()
    return oof.groupBy("l_orderkey", "l_linenumber").agg(F.count("prediction").alias("n")).withColumn("better", better)


def out_of_bag(spark, folder):
    """Every line item is judged by some of the trees, never by all, and together better than by the mean."""
    rows = stage(_priced(spark, folder), "lines")
    models = fit_bagged(rows, COLUMNS, PRICE, "row_key", trees=30, max_depth=6)
    oob = stage(out_of_bag_predictions(rows, models, COLUMNS, "row_key"), "oob")
    better = oob.agg(F.sum(F.pow(F.col(PRICE) - F.col("prediction"), 2)) < F.var_pop(PRICE) * F.count("*")).scalar()
    return oob.select("l_orderkey", "l_linenumber", ((F.col("trees") > 0) & (F.col("trees") < 30)).alias("some"), better.alias("better"))


SMALL_SPACE = {"trees": (2, 5), "max_depth": (2, 6), "min_leaf": (1, 10), "subset": ["sqrt", "all"]}


def guided_trials(spark, folder):
    """A search that is stopped after its first round and goes on has the trials of one that is not."""
    rows, registry = stage(_priced(spark, folder), "lines"), Registry(spark, scratch_path(spark, "studies"))
    search = lambda n, study: guided_search(rows, COLUMNS, PRICE, "row_key", n, 3, 2, space=SMALL_SPACE, registry=registry, study=study)[1:]
    search(3, "stopped")
    one, _ = search(6, "stopped")
    two, best = search(6, "whole")
    both = one.alias("x").join(two.alias("y"), "trial")
    same = reduce(and_, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("trees", "max_depth", "min_leaf", "subset")]) & (F.abs(F.col("x.cv_rmse") - F.col("y.cv_rmse")) < 1e-6)
    least = two.agg(F.min(F.struct("cv_rmse", "trial"))["trial"]).scalar()
    chosen = reduce(and_, [F.col(f"y.{c}") == best[c] for c in best])
    return both.select("trial", same.alias("same"), F.col("x.trees").between(2, 5).alias("inside"), (chosen | (F.col("trial") != least)).alias("best_is_chosen"))


def importance_adds_up(spark, folder):
    """Every feature has its importance, none is negative, and they add up to one."""
    found = stage(feature_importance(spark, fit_forest(_lines(spark, folder), COLUMNS, LABEL, trees=10, max_depth=6), COLUMNS), "importance")
    total = found.agg(F.abs(F.sum("importance") - 1) < 1e-9).scalar()
    return found.select("feature", (F.col("importance") >= 0).alias("positive"), total.alias("adds_up"))


def cluster_sweep(spark, folder):
    """Each k once, with the mean of the silhouettes of its own clustering's rows."""
    rows = table(spark, folder, "embeddings")
    swept = {r["k"]: r["silhouette"] for r in vectors.kmeans_sweep(rows, 4).collect()}  # a row for each k
    parts = []
    for k in sorted(swept):
        data = vectors._as_vector(rows, "embedding")
        model = KMeans(k=k, seed=0, featuresCol="_vector", predictionCol="cluster").fit(stage(data.select("_vector"), "kmeans"))
        clustered = stage(model.transform(data).select("vec_id", "embedding", "cluster"), "clustered")
        mean = vectors.silhouettes(clustered, "cluster").agg(F.avg("silhouette").alias("mean"))
        parts.append(mean.select(F.lit(k).alias("k"), (F.abs(F.col("mean") - swept[k]) < 1e-4).alias("agrees")))
    return parts[0].union(parts[1]).union(parts[2])


def principal_axes(spark, folder):
    """The two axes are uncorrelated and the first varies more."""
    xy = vectors.project_2d(table(spark, folder, "embeddings"))
    return xy.agg(
        F.count("*").alias("n"), (F.abs(F.corr("x", "y")) < 1e-6).alias("uncorrelated"), (F.var_pop("x") >= F.var_pop("y")).alias("in_order")
    )


def neighbours_kept(spark, folder):
    """Of two layouts of the embeddings, the one by neighbours keeps more of them than the principal components do."""
    rows = stage(table(spark, folder, "embeddings").select("vec_id", "embedding"), "vectors")
    graph = vectors.neighbour_graph(rows, "vec_id", "embedding", 10)
    near = stage(vectors.project_neighbours(rows, "vec_id", "embedding", graph=graph), "near")
    flat = stage(vectors.project_2d(rows).select("vec_id", "x", "y"), "flat")
    kept = [vectors.kept_neighbours(layout, "vec_id", graph).scalar() for layout in (near, flat)]
    whole = graph.groupBy("a").agg(F.count("*").alias("n"))
    return near.join(whole, F.col("vec_id") == F.col("a")).select("vec_id", F.col("n").alias("neighbours"), (kept[0] > kept[1]).alias("more_kept"))


def _held_by(leaves: Broadcast):
    """Arrow function over the features of rows: how many trees and leaves of a broadcast (lo, hi, free, trees, values) hold a row, and the mean of the leaves' values."""

    @arrow_udf("STRUCT<trees: BIGINT, leaves: BIGINT, mean: DOUBLE>")
    def held(*columns: pa.Array) -> pa.Array:
        lo, hi, free, trees, values = leaves.value
        inside = np.ones((len(columns[0]), len(values)), bool)
        for f, column in enumerate(columns):
            x = column.to_numpy(zero_copy_only=False)[:, None]
            inside &= free[:, f] | ((x > lo[:, f]) & (x <= hi[:, f]))
        n = inside.sum(1)
        of_tree = np.stack([inside[:, trees == t].any(1) for t in np.unique(trees)], 1)
        mean = pa.array(inside @ values / np.maximum(n, 1), mask=n == 0)
        return pa.StructArray.from_arrays([pa.array(of_tree.sum(1), pa.int64()), pa.array(n, pa.int64()), mean], names=["trees", "leaves", "mean"])

    return held


def leaves_hold_rows(spark, folder):
    """Every event lies in one leaf of each tree, and the mean of their values is its prediction."""
    rows, model = _fitted(spark, folder)
    boxes = at.leaf_boxes(at.forest_nodes(spark, model))
    side = F.struct("feature", "lo", "hi")
    found = boxes.groupBy("tree", "leaf").agg(F.first("value").alias("value"), F.collect_list(side).alias("path")).collect()  # as large as the model
    lo, hi = (np.full((len(found), len(EVENT_COLUMNS)), x) for x in (-np.inf, np.inf))
    free = np.ones(lo.shape, bool)
    for i, leaf in enumerate(found):
        for p in leaf["path"]:
            if p["feature"] is not None:
                lo[i, p["feature"]], hi[i, p["feature"]], free[i, p["feature"]] = p["lo"], p["hi"], False
    held = _held_by(spark.sparkContext.broadcast((lo, hi, free, np.array([r["tree"] for r in found]), np.array([r["value"] for r in found]))))
    inside = predict(rows, model, EVENT_COLUMNS).withColumn("held", held(*[F.col(c) for c in EVENT_COLUMNS]))
    return inside.select(
        "event_id",
        F.col("held.trees").alias("trees"),
        F.col("held.leaves").alias("leaves"),
        (F.abs(F.col("held.mean") - F.col("prediction")) < 1e-9).alias("mean_is_prediction"),
    )


def loaded_model(spark, folder):
    """A model that was stored with its run predicts as it did before."""
    lines = stage(_lines(spark, folder), "lines")
    model = fit_forest(lines, COLUMNS, LABEL, trees=3, max_depth=5)
    registry = Registry(spark, scratch_path(spark, "registry"))
    run = registry.log_run("fit", {}, {}, {}, model=model)
    registry.set_alias("price", "production", registry.register("price", run))
    loaded = registry.load_model("price", alias="production")
    again = predict(predict(lines, model, COLUMNS).withColumnRenamed("prediction", "first"), loaded, COLUMNS)
    return again.select("l_orderkey", "l_linenumber", (F.col("first") == F.col("prediction")).alias("same"))


# --- nulls, repeats, late and empty ------------------------------------------------------


def _orders(spark, folder):
    """Orders by customer, without the customer for every seventh."""
    customer = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))
    return table(spark, folder, "orders").select("o_orderkey", customer.alias("customer"), (F.col("o_totalprice") - 250000).alias("error"))


_ORDERS = "(SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS customer, o_totalprice - 250000 AS error FROM orders)"
_NULL = "chr(0) || 'null'"
assert NULL_KEY == "\x00null"


def sample_nulls_and_repeats(spark, folder):
    """A sample by a key that repeats and is null at times."""
    return curate.sample_rows(_orders(spark, folder).select("o_orderkey", "customer"), 700, "customer", 11)


def split_null_owners(spark, folder):
    return with_split(_orders(spark, folder), "customer", 0.3, 4).select("o_orderkey", "is_test")


def ranks_with_null_group(spark, folder):
    rows = _orders(spark, folder).withColumn("cell", F.col("customer") % 5)
    return with_rank(rows, ["cell"], ["error", "o_orderkey"]).select("o_orderkey", "cell", "rank")


def histogram_null_group(spark, folder):
    rows = _orders(spark, folder).withColumn("cell", F.col("customer") % 5)
    found = profile.histogram(rows, "error", 20, ["cell"])
    return found.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("bins"))


def top_k_null_errors(spark, folder):
    rows = _orders(spark, folder).select("o_orderkey", F.when(F.col("customer").isNotNull(), F.col("error")).alias("error"))
    return evaluate.top_k(rows, "error", 40, "o_orderkey").select("kind", "o_orderkey", "error")


def profile_null_label(spark, folder):
    rows = _orders(spark, folder).select(F.col("o_orderkey").alias("id"), (F.col("customer") % 5).alias("label"), F.col("error").alias("silhouette"))
    return vectors.silhouette_profile(rows, "label", "id").select("id", "label", "position", "cluster_size")


def late_submissions(spark, folder):
    """Submissions arrive newest first, from several writers and some of them again, on other days or without one: each is scored once."""
    rows = submissions(spark, folder).select("id", "created_at", "model_version", "k", F.col("user_id").cast("double").alias("user"), F.col("prediction_output").alias("label"))
    model = fit_forest(stage(rows, "known"), ["user", "k"], "label", trees=3, max_depth=4)
    source, sink = scratch_path(spark, "late-in"), scratch_path(spark, "late-out")
    day = F.col("created_at")
    again = rows.filter("created_at < '2024-01-20'").withColumn("created_at", F.when(F.col("k") % 3 == 0, day + F.expr("INTERVAL 9 DAYS")).when(F.col("k") % 3 == 1, day))
    for part in (rows.filter("created_at >= '2024-01-16'"), rows.filter("created_at < '2024-01-20'"), again):
        part.write.mode("append").parquet(source)
    stream = submission_stream(spark, source, rows.schema, 8)
    scored = lambda batch: predict(batch, model, ["user", "k"])
    start_scoring(stream, scored, sink, scratch_path(spark, "late-checkpoint"), available_now=True).awaitTermination()
    stored = spark.read.parquet(sink).select("id", "model_version", F.col("prediction").alias("streamed"))
    at_once = predict(rows, model, ["user", "k"]).select(F.col("id").alias("own"), "prediction")
    return stored.join(at_once, F.col("id") == F.col("own")).select("id", "model_version", (F.abs(F.col("streamed") - F.col("prediction")) < 1e-9).alias("as_at_once"))


def empty_dependencies(spark, folder):
    """A version without dependencies hands on that it has none."""
    root = scratch_path(spark, "reco")
    effects = rec.effects_table(rec.fixed_effects(spark, {r["event_type"]: "always" for r in events(spark, folder).select("event_type").distinct().collect()}), 1)
    published.publish_reco_data(spark, root, 1, effects, rec.dependencies_table(spark, 1, {}), rec.messages_table(spark, 1))
    published.publish_reco_data(spark, root, 2, messages=rec.messages_table(spark, 2))
    one = published.read_reco_part(spark, root, "effects", 2).select("model_version", "feature")
    none = published.read_reco_part(spark, root, "dependencies", 2).select("model_version", "feature")
    return one.unionByName(none)


def reports_of_all_versions(spark, folder):
    rows, path = submissions(spark, folder), scratch_path(spark, "reports")
    versions = [r["model_version"] for r in rows.select("model_version").distinct().collect()]  # a report for each
    for version in versions:
        record = performance_decline(rows.filter(F.col("model_version") == version), "k", "prediction_output", 50.0)
        published.write_report(record.select(F.lit(version).alias("model_version"), F.lit("all").alias("stamp"), "*"), path, "json")
    schema = "old_rmse DOUBLE, new_rmse DOUBLE, rmse_diff DOUBLE, rmse_msg STRING, model_version STRING, stamp STRING"
    found = published.read_report(spark, path, schema, "json").filter(F.col("new_rmse").isNotNull())
    return found.select("model_version", F.round("new_rmse", 6).alias("new_rmse"), "rmse_msg")


def customers_without_late_orders(spark, folder):
    late = table(spark, folder, "orders").filter("o_orderdate >= '1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").join(late, "c_custkey", "left_anti").select("c_custkey", "c_name")


def owners_of_paths(spark, folder):
    path = F.when(F.col("c_custkey") % 3 != 0, F.concat_ws("/", "c_mktsegment", "c_name", "c_custkey")).otherwise(F.col("c_name"))
    return table(spark, folder, "customer").select("c_custkey", owner_of(path).alias("developer"))


QUERIES = {
    "g6_forest_beats_mean": forest_beats_mean,
    "g7_zero_weights": zero_weights,
    "g8_best_trial": best_trial,
    "g9_held_out_predictions": held_out_predictions,
    "g9_out_of_bag": out_of_bag,
    "g8_guided_trials": guided_trials,
    "f11_importance_adds_up": importance_adds_up,
    "g15_cluster_sweep": cluster_sweep,
    "g18_principal_axes": principal_axes,
    "g18_neighbours_kept": neighbours_kept,
    "h2_leaves_hold_rows": leaves_hold_rows,
    "a10_loaded_model_scores": loaded_model,
    "b12_sample_nulls_and_repeats": sample_nulls_and_repeats,
    "g1_split_null_owners": split_null_owners,
    "f14_ranks_with_null_group": ranks_with_null_group,
    "f4_histogram_null_group": histogram_null_group,
    "f10_top_k_null_errors": top_k_null_errors,
    "g17_profile_null_label": profile_null_label,
    "k1_late_submissions": late_submissions,
    "a9_empty_dependencies": empty_dependencies,
    "a8_reports_of_all_versions": reports_of_all_versions,
    "e3_without_late_orders": customers_without_late_orders,
    "b13_owners_of_paths": owners_of_paths,
}

_TOP = "SELECT o_orderkey, error FROM {0} WHERE customer IS NOT NULL".format(_ORDERS)

ORACLES = {
    "g6_forest_beats_mean": "SELECT * FROM (VALUES (false, true), (true, true)) t(is_test, better)",
    "g7_zero_weights": "SELECT event_id, true AS same FROM events",
    "g8_best_trial": "SELECT CAST(trial AS INTEGER) AS trial, CAST(d AS INTEGER) AS max_depth, CAST(m AS INTEGER) AS min_leaf, true AS agrees FROM (VALUES (0, 2, 1), (1, 4, 1), (2, 6, 5)) t(trial, d, m)",
    "g9_held_out_predictions": "SELECT l_orderkey, l_linenumber, count(*) AS n, true AS better FROM lineitem GROUP BY ALL",
    "g9_out_of_bag": "SELECT l_orderkey, l_linenumber, true AS some, true AS better FROM lineitem",
    "g8_guided_trials": "SELECT CAST(trial AS INTEGER) AS trial, true AS same, true AS inside, true AS best_is_chosen FROM range(6) t(trial)",
    "f11_importance_adds_up": f"SELECT feature, true AS positive, true AS adds_up FROM (VALUES {', '.join(f"('{c}')" for c in COLUMNS)}) t(feature)",
    "g15_cluster_sweep": "SELECT CAST(k AS INTEGER) AS k, true AS agrees FROM range(2, 5) t(k)",
    "g18_principal_axes": "SELECT count(*) AS n, true AS uncorrelated, true AS in_order FROM embeddings",
    "g18_neighbours_kept": "SELECT vec_id, CAST(10 AS BIGINT) AS neighbours, true AS more_kept FROM embeddings",
    "h2_leaves_hold_rows": "SELECT event_id, CAST(3 AS BIGINT) AS trees, CAST(3 AS BIGINT) AS leaves, true AS mean_is_prediction FROM events",
    "a10_loaded_model_scores": "SELECT l_orderkey, l_linenumber, true AS same FROM lineitem",
    "b12_sample_nulls_and_repeats": f"""
        SELECT o_orderkey, customer FROM {_ORDERS}
        ORDER BY md5('11:' || coalesce(CAST(customer AS VARCHAR), {_NULL})) || coalesce(CAST(customer AS VARCHAR), {_NULL})
          || md5('{{"o_orderkey":' || o_orderkey || ',"customer":' || coalesce(CAST(customer AS VARCHAR), 'null') || '}}') LIMIT 700""",
    "g1_split_null_owners": f"""
        WITH k AS (SELECT DISTINCT coalesce(CAST(customer AS VARCHAR), {_NULL}) AS k FROM {_ORDERS}),
        n AS (SELECT k, row_number() OVER (ORDER BY md5('4:' || k), k) <= ceil(0.3 * count(*) OVER ()) AS is_test FROM k)
        SELECT o_orderkey, is_test FROM {_ORDERS} o JOIN n ON coalesce(CAST(customer AS VARCHAR), {_NULL}) = n.k""",
    "f14_ranks_with_null_group": f"""
        SELECT o_orderkey, customer % 5 AS cell, row_number() OVER (PARTITION BY customer % 5 ORDER BY error, o_orderkey) AS rank FROM {_ORDERS}""",
    "f4_histogram_null_group": f"SELECT customer % 5 AS cell, count(*) AS n, CAST(20 AS BIGINT) AS bins FROM {_ORDERS} GROUP BY ALL",
    "f10_top_k_null_errors": f"""
        (SELECT 'top_performing' AS kind, * FROM ({_TOP}) ORDER BY abs(error), o_orderkey LIMIT 40)
        UNION ALL (SELECT 'over_estimated', * FROM ({_TOP}) ORDER BY error, o_orderkey LIMIT 40)
        UNION ALL (SELECT 'under_estimated', * FROM ({_TOP}) ORDER BY error DESC, o_orderkey LIMIT 40)""",
    "g17_profile_null_label": f"""
        SELECT o_orderkey AS id, customer % 5 AS label, row_number() OVER (PARTITION BY customer % 5 ORDER BY error, o_orderkey) AS position,
          count(*) OVER (PARTITION BY customer % 5) AS cluster_size FROM {_ORDERS}""",
    "k1_late_submissions": f"SELECT id, model_version, true AS as_at_once FROM {SUBMISSIONS}",
    "a9_empty_dependencies": "SELECT DISTINCT CAST(2 AS INTEGER) AS model_version, event_type AS feature FROM events",
    "a8_reports_of_all_versions": f"""
        SELECT model_version, round(rmse, 6) AS new_rmse, CASE WHEN rmse - 50.0 > 0.25 * 50.0 THEN 'exceeded' ELSE 'did not exceed' END AS rmse_msg
        FROM (SELECT model_version, sqrt(avg((k - prediction_output) * (k - prediction_output))) AS rmse FROM {SUBMISSIONS} GROUP BY model_version)""",
    "e3_without_late_orders": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')",
    "b13_owners_of_paths": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE c_name END AS developer FROM customer",
}
