"""Splits, weights, retraining sets and forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import evaluate
from gradeloom.operators.forest import feature_importance, fit_forest, out_of_fold_predictions, predict, score_sources, search_forest
from gradeloom.operators.code_facts import with_code_facts
from gradeloom.operators.code_features import transformed_features
from gradeloom.fixed_values import TRANSFORMED_FEATURES
from gradeloom.operators.retraining import combine, fill_created_at, retrain_split, with_decay_weight
from gradeloom.operators.split import count_common_owners, split_by_owner, split_by_row, with_split
from gradeloom.plans.checks.tables import EVENTS, SOURCES, events, sources, table
from gradeloom.session import stage

COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_partkey", "l_linenumber"]
LABEL = "l_extendedprice"
HALF = "2024-01-16 00:00:00"


def owner_split(spark, folder):
    return with_split(table(spark, folder, "documents"), "source", 0.3, 0).select("doc_id", "source", "is_test")


def user_split(spark, folder):
    return with_split(table(spark, folder, "events"), "user_id", 0.3, 0).select("event_id", "is_test")


def row_split(spark, folder):
    return with_split(table(spark, folder, "orders"), "o_orderkey", 0.3, 5, unique=True).select("o_orderkey", "is_test")


def leaked_owners(spark, folder):
    """Owners on both sides of a split by row, and of a split by owner."""
    orders = table(spark, folder, "orders")
    by_row = count_common_owners(*split_by_row(orders, "o_orderkey", 0.3, 5), "o_custkey").withColumn("kind", F.lit("row"))
    by_owner = count_common_owners(*split_by_owner(orders, 0.3, 5, "o_custkey"), "o_custkey").withColumn("kind", F.lit("owner"))
    return by_row.unionByName(by_owner)


def decay_weights(spark, folder):
    cutoff = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return with_decay_weight(events(spark, folder), cutoff, created_at="ts").select("event_id", F.round("weight", 9).alias("weight"))


def retraining_rows(spark, folder):
    """First half of the events as old data without a date, second half as new."""
    rows = events(spark, folder).withColumn("developer", F.col("user_id").cast("string"))
    old = rows.filter(F.col("ts") < HALF).select("event_id", "developer", "value")
    old = fill_created_at(old, F.lit(HALF).cast("timestamp"))
    new = rows.filter(F.col("ts") >= HALF).select("event_id", "developer", "value", "k", F.col("ts").alias("created_at"))
    marked = retrain_split(combine(old, new), "developer", 0.3, 3)
    weighted = with_decay_weight(marked, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return weighted.select("event_id", "is_new", "is_test", F.round("weight", 9).alias("weight"))


def _lines(spark, folder):
    """Line items with a number for every distinct row content."""
    return table(spark, folder, "lineitem").withColumn("row_key", F.xxhash64("*"))


def forest_metrics(spark, folder):
    """Fit on the orders of the training side, judge on the others."""
    marked = stage(with_split(_lines(spark, folder), "l_orderkey", 0.3, 0), "lines")
    model = fit_forest(marked.filter("not is_test"), COLUMNS, LABEL, trees=10, max_depth=8)
    return evaluate.metrics(predict(marked, model, COLUMNS), LABEL, group=["is_test"])


def weighted_forest(spark, folder):
    cutoff = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = stage(with_decay_weight(events(spark, folder), cutoff, created_at="ts").withColumn("user", F.col("user_id").cast("double")), "weighted")
    model = fit_forest(rows, ["user", "k"], "value", trees=10, max_depth=6, weight="weight")
    return predict(rows, model, ["user", "k"]).select("event_id", "value", "prediction")


def search(spark, folder):
    trials = [
        {"trees": 4, "max_depth": 4, "min_leaf": 1, "subset": "all"},
        {"trees": 4, "max_depth": 6, "min_leaf": 5, "subset": "sqrt"},
    ]
    _, trial_table, _ = search_forest(_lines(spark, folder), COLUMNS, LABEL, "row_key", trials, folds=3)
    return trial_table


def out_of_fold(spark, folder):
    oof = out_of_fold_predictions(_lines(spark, folder), COLUMNS, LABEL, "row_key", folds=3, trees=4, max_depth=6)
    return oof.select("l_orderkey", "l_linenumber", LABEL, "prediction")


def importance(spark, folder):
    model = fit_forest(_lines(spark, folder), COLUMNS, LABEL, trees=10, max_depth=6)
    return feature_importance(spark, model, COLUMNS)


def scored_sources(spark, folder):
    """A model of the files' size scores the files; files without valid logic get -1."""
    # files are parsed and measured once: fitting passes over its rows several times, and scoring once more
    measured = transformed_features(with_code_facts(sources(spark, folder)))
    features = F.struct("effective_lines", *TRANSFORMED_FEATURES).alias("measured")
    files = stage(measured.select("file_id", F.struct("facts.has_logic").alias("facts"), features), "files")
    with_features = lambda df: df.select("*", "measured.*")
    valid = with_features(files).filter(F.col("facts.has_logic")).withColumn("label", F.col("func_density") * 10)
    model = fit_forest(valid, TRANSFORMED_FEATURES, "label", trees=5, max_depth=5)
    scored = score_sources(files, model, feature_stage=with_features)
    return scored.select(
        "file_id",
        (F.col("score") == -1).alias("invalid"),
        F.col("score").between(-1, 10).alias("in_range"),
        F.size("extracted_features").cast("bigint").alias("n_features"),
    )


QUERIES = {
    "g1_owner_split": owner_split,
    "g1_user_split": user_split,
    "g2_row_split": row_split,
    "e6_leaked_owners": leaked_owners,
    "g3_decay_weights": decay_weights,
    "g4_retraining_rows": retraining_rows,
    "g6_forest_metrics": forest_metrics,
    "g7_weighted_forest": weighted_forest,
    "g8_forest_search": search,
    "g9_out_of_fold": out_of_fold,
    "f11_feature_importance": importance,
    "g10_scored_sources": scored_sources,
}


def _marked_sql(table_name: str, key: str, seed: int, where: str = "true") -> str:
    """The first share of the keys in hash order."""
    return f"""
        (SELECT CAST(k AS VARCHAR) AS k, row_number() OVER (ORDER BY md5('{seed}:' || k), CAST(k AS VARCHAR)) <=
                ceil(0.3 * count(*) OVER ()) AS is_test FROM (SELECT DISTINCT {key} AS k FROM {table_name} WHERE {where}))"""


ORACLES = {
    "g1_owner_split": f"SELECT doc_id, source, is_test FROM documents JOIN {_marked_sql('documents', 'source', 0)} g ON source = g.k",
    "g1_user_split": f"SELECT event_id, is_test FROM events JOIN {_marked_sql('events', 'user_id', 0)} g ON CAST(user_id AS VARCHAR) = g.k",
    "g2_row_split": f"SELECT o_orderkey, is_test FROM orders JOIN {_marked_sql('orders', 'o_orderkey', 5)} g ON CAST(o_orderkey AS VARCHAR) = g.k",
    "e6_leaked_owners": f"""
        SELECT count(*) AS common_owners, 'row' AS kind FROM (
          SELECT o_custkey FROM orders JOIN {_marked_sql('orders', 'o_orderkey', 5)} g ON CAST(o_orderkey AS VARCHAR) = g.k
          GROUP BY o_custkey HAVING count(DISTINCT is_test) = 2)
        UNION ALL SELECT CAST(0 AS BIGINT), 'owner'""",
    "g3_decay_weights": """
        SELECT event_id, round(exp(-ln(2) / 30 * (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 86400000000.0), 9) AS weight
        FROM events""",
    "g4_retraining_rows": f"""
        SELECT event_id, ts >= TIMESTAMP '{HALF}' AS is_new, coalesce(ts >= TIMESTAMP '{HALF}' AND is_test, false) AS is_test,
               round(exp(-ln(2) / 30 * (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(greatest(ts, TIMESTAMP '{HALF}'))) / 86400000000.0), 9) AS weight
        FROM {EVENTS} LEFT JOIN {_marked_sql('events', 'user_id', 3, f"ts >= TIMESTAMP '{HALF}'")} g ON CAST(user_id AS VARCHAR) = g.k""",
    "g10_scored_sources": f"""
        SELECT file_id, NOT has_logic AS invalid, true AS in_range, CAST(CASE WHEN has_logic THEN 15 ELSE 0 END AS BIGINT) AS n_features
        FROM {SOURCES}""",
}
