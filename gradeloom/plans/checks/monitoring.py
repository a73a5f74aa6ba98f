"""Decline, drift, and the streams with their batch twins."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from gradeloom.fixed_values import TRANSFORMED_FEATURES
from gradeloom.operators import monitor
from gradeloom.operators import recommend as rec
from gradeloom.operators.attribution import forest_nodes, leaf_boxes
from gradeloom.operators.code_facts import keep_executable
from gradeloom.operators.code_facts import with_code_facts
from gradeloom.operators.code_features import transformed_features
from gradeloom.operators.forest import fit_forest
from gradeloom.plans.checks.tables import EVENTS, SOURCES, events, sources, submissions, table
from gradeloom.plans.scoring import Scorer
from gradeloom.session import scratch_path, stage
from gradeloom.streaming.jobs import latest_windows, rolling_error, start_rolling_error, start_scoring, submission_stream

HALF = "2024-01-16 00:00:00"
FEATURES = ["value", "k", "user_id", "kind"]


def decline(spark, folder):
    found = monitor.performance_decline(submissions(spark, folder), "k", "prediction_output", 30.0)
    return found.select("old_rmse", *[F.round(c, 6).alias(c) for c in ("new_rmse", "rmse_diff")], "rmse_msg")


def _halves(spark, folder):
    """Events before and after the middle; a third of the later values is moved, so that there is drift to find."""
    rows = events(spark, folder).withColumn("kind", F.length("event_type"))
    later = rows.filter(F.col("ts") >= HALF)
    moved = later.withColumn("value", F.when(F.col("k") < 33, F.col("value") + 100).otherwise(F.col("value")))
    return rows.filter(F.col("ts") < HALF), moved


def drift(spark, folder):
    return monitor.drift(*_halves(spark, folder), FEATURES).withColumn("value", F.round("value", 6))


def distances(spark, folder):
    """All distances, whichever of them decides."""
    counts = monitor.value_counts_by_side(*_halves(spark, folder), FEATURES)
    return monitor.distances(counts).select(
        "feature", "ref_rows", "cur_rows", "distinct", *[F.round(c, 6).alias(c) for c in ("wasserstein", "ks", "jensen_shannon")]
    )


def small_drift(spark, folder):
    """Suppliers against customers: references of up to 1 000 rows are judged by p-values, one for each of the three tests."""
    nations = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")

    def side(name, prefix):
        rows = table(spark, folder, name).join(nations, F.col(f"{prefix}_nationkey") == F.col("n_nationkey"))
        balance = F.col(f"{prefix}_acctbal")
        return rows.select(balance.alias("balance"), F.col("n_regionkey").alias("region"), (balance < 0).cast("int").alias("in_debt"))

    found = monitor.drift(side("supplier", "s"), side("customer", "c"), ["balance", "region", "in_debt"])
    return found.withColumn("value", F.round("value", 6))


def share(spark, folder):
    found = monitor.drift_share(monitor.drift(*_halves(spark, folder), FEATURES))
    return found.select(F.round("share", 6).alias("share"), "drift_msg", F.array_join(F.map_keys("drifts"), ",").alias("drifted"))


def record(spark, folder):
    current = submissions(spark, folder)
    found = monitor.monitoring_record(
        monitor.performance_decline(current, "k", "prediction_output", 30.0),
        monitor.drift_share(monitor.drift(*_halves(spark, folder), FEATURES)), "3", "2024-02-01_00-00-00_UTC",
    )
    return found.select("model_version", "stamp", F.round("new_rmse", 6).alias("new_rmse"), "rmse_msg", F.round("share", 6).alias("share"), "drift_msg")


def rolling_batch(spark, folder):
    rolling = rolling_error(submissions(spark, folder), "k", "prediction_output")
    return rolling.select(F.unix_timestamp("start").alias("start"), "model_version", F.round("rmse", 6).alias("rmse"), "n")


def rolling_stream(spark, folder):
    """The same numbers from a stream that reads the submissions file by file."""
    rows, source, sink = submissions(spark, folder), scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    rows.repartitionByRange(4, "created_at").write.parquet(source)
    # the files arrive in any order, so the delay covers the whole month
    rolling = rolling_error(submission_stream(spark, source, rows.schema, 2), "k", "prediction_output", delay="40 days")
    start_rolling_error(rolling, sink, scratch_path(spark, "stream-checkpoint"), available_now=True).awaitTermination()
    latest = latest_windows(spark, sink)
    return latest.select(F.unix_timestamp("start").alias("start"), "model_version", F.round("rmse", 6).alias("rmse"), "n")


def _scorer(spark, files):
    featured = keep_executable(files).transform(transformed_features).withColumn("label", F.col("func_density") * 10)
    featured = stage(featured.select(*TRANSFORMED_FEATURES, "label"), "featured")
    model = fit_forest(featured, TRANSFORMED_FEATURES, "label", trees=3, max_depth=4)
    effects = rec.override_effects(
        spark.createDataFrame([("characters", "range", 200.0, 600.0)], "feature STRING, kind STRING, lo DOUBLE, hi DOUBLE"),
        rec.fixed_effects(spark),
    )
    return Scorer(
        model, "1", featured.select(*TRANSFORMED_FEATURES), leaf_boxes(forest_nodes(spark, model)),
        effects, rec.dependencies_table(spark, 1), rec.messages_table(spark, 1),
    )


def scoring_stream(spark, folder):
    """Every derived file arrives as a submission, and arrives twice."""
    files = stage(sources(spark, folder), "files")
    scorer = _scorer(spark, with_code_facts(files))
    source, sink = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    incoming = files.select(
        F.col("file_id").alias("id"), "user_id", F.col("text").alias("raw_code"),
        F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)).alias("created_at"),
    )
    incoming.unionByName(incoming).write.parquet(source)
    stream = submission_stream(spark, source, incoming.schema)
    start_scoring(stream, scorer.score, sink, scratch_path(spark, "stream-checkpoint"), available_now=True).awaitTermination()
    return spark.read.parquet(sink).select(
        "id", "user_id", (F.col("prediction_output") != -1).alias("valid"), F.col("message").startswith("Estimated score").alias("has_score"),
        F.size("extracted_features").cast("bigint").alias("n_features"),
    )


QUERIES = {
    "i1_performance_decline": decline,
    "i2_drift": drift,
    "i2_small_references": small_drift,
    "i2_distances": distances,
    "i3_drift_share": share,
    "i4_monitoring_record": record,
    "k2_rolling_error_batch": rolling_batch,
    "k2_rolling_error_stream": rolling_stream,
    "k1_scoring_stream": scoring_stream,
}

_SIDES = f"""
  (SELECT feature, x, CAST(sum(ref) AS BIGINT) AS n_ref, CAST(sum(1 - ref) AS BIGINT) AS n_cur FROM (
     SELECT CAST(ts < TIMESTAMP '{HALF}' AS INTEGER) AS ref,
            unnest([{{'feature': 'value', 'x': CASE WHEN ts >= TIMESTAMP '{HALF}' AND k < 33 THEN value + 100 ELSE value END}},
                    {{'feature': 'k', 'x': k}}, {{'feature': 'user_id', 'x': CAST(user_id AS DOUBLE)}},
                    {{'feature': 'kind', 'x': CAST(length(event_type) AS DOUBLE)}}], recursive := true)
     FROM {EVENTS}) GROUP BY feature, x)"""
_DISTANCES = f"""
  (WITH c AS (SELECT *, sum(n_ref) OVER f AS refs, sum(n_cur) OVER f AS curs, sum(n_ref) OVER o AS upto_ref, sum(n_cur) OVER o AS upto_cur,
                     lead(x) OVER o AS next_x
              FROM {_SIDES} WINDOW f AS (PARTITION BY feature), o AS (PARTITION BY feature ORDER BY x)),
   p AS (SELECT *, n_ref / refs AS p, n_cur / curs AS q, abs(upto_ref / refs - upto_cur / curs) AS gap FROM c)
   SELECT feature, CAST(max(refs) AS BIGINT) AS ref_rows, CAST(max(curs) AS BIGINT) AS cur_rows, count(*) AS "distinct",
          count(*) FILTER (WHERE n_ref > 0) AS ref_distinct,
          sum(gap * (next_x - x)) / greatest(sqrt(sum(p * x * x) - sum(p * x) * sum(p * x)), 0.001) AS wasserstein, max(gap) AS ks,
          sqrt(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2) AS jensen_shannon
   FROM p GROUP BY feature)"""
_DRIFT = f"""
  (SELECT feature, method, value, CAST(0.1 AS DOUBLE) AS threshold, value >= 0.1 AS drifted FROM (
     SELECT feature, CASE WHEN "distinct" <= 5 THEN 'jensen_shannon' ELSE 'wasserstein' END AS method,
            CASE WHEN "distinct" <= 5 THEN jensen_shannon ELSE wasserstein END AS value FROM {_DISTANCES}))"""
_SMALL = """
  sides AS (
    SELECT true AS ref, CAST(s_acctbal AS DOUBLE) AS balance, n_regionkey AS region, s_acctbal < 0 AS in_debt FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT false, CAST(c_acctbal AS DOUBLE), n_regionkey, c_acctbal < 0 FROM customer JOIN nation ON c_nationkey = n_nationkey),
  sizes AS (SELECT count(*) FILTER (ref) AS n, count(*) FILTER (NOT ref) AS m FROM sides),
  steps AS (SELECT balance, sum(CASE WHEN ref THEN 1 ELSE 0 END) OVER (ORDER BY balance) AS r, sum(CASE WHEN ref THEN 0 ELSE 1 END) OVER (ORDER BY balance) AS c FROM sides),
  gap AS (SELECT max(abs(r * m - c * n)) AS g FROM steps, sizes),
  bound AS (SELECT n, m, (g - 0.5) / (n::DOUBLE * m) AS q FROM gap, sizes),
  paths(i, u) AS (
    SELECT 0, [CASE WHEN j / n::DOUBLE <= q THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR j IN range(n + 1)] FROM bound
    UNION ALL
    SELECT i + 1, [CASE WHEN abs((i + 1) / m::DOUBLE - j / n::DOUBLE) <= q
        THEN coalesce(list_sum([CASE WHEN abs((i + 1) / m::DOUBLE - k / n::DOUBLE) <= q THEN u[k + 1] ELSE 0.0 END FOR k IN range(j + 1)]), 0.0) * (i + 1) / (i + 1 + n)
        ELSE 0.0::DOUBLE END FOR j IN range(n + 1)]
    FROM paths, bound WHERE i < m),
  ks AS (SELECT 1 - u[n + 1] AS p FROM paths, sizes WHERE i = m),
  regions AS (SELECT region, count(*) FILTER (ref) * m::DOUBLE / n AS e, count(*) FILTER (NOT ref) AS o FROM sides, sizes GROUP BY region, n, m),
  chi AS (SELECT sum((o - e) * (o - e) / e) / 2 AS h FROM regions),
  debts AS (SELECT avg(CAST(in_debt AS INTEGER)) FILTER (ref) AS a, avg(CAST(in_debt AS INTEGER)) FILTER (NOT ref) AS b, avg(CAST(in_debt AS INTEGER)) AS s FROM sides),
  z AS (SELECT abs(a - b) / sqrt(s * (1 - s) * (1 / n::DOUBLE + 1 / m::DOUBLE)) / sqrt(2) AS x FROM debts, sizes),
  erf AS (SELECT 2 / sqrt(pi()) * sum(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * pow(x, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))) AS e FROM z, range(80) t(k))"""
_DECLINE = f"(SELECT sqrt(avg((k - value) * (k - value))) AS rmse FROM {EVENTS})"
_ROLLING = f"""
    SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type AS model_version,
           round(sqrt(avg((k - value) * (k - value))), 6) AS rmse, count(*) AS n FROM {EVENTS} GROUP BY ALL"""

ORACLES = {
    "i1_performance_decline": f"""
        SELECT CAST(30 AS DOUBLE) AS old_rmse, round(rmse, 6) AS new_rmse, round(rmse - 30, 6) AS rmse_diff,
               CASE WHEN rmse - 30 > 0.25 * 30 THEN 'exceeded' ELSE 'did not exceed' END AS rmse_msg FROM {_DECLINE}""",
    "i2_drift": f"SELECT feature, method, round(value, 6) AS value, threshold, drifted FROM {_DRIFT}",
    "i2_small_references": f"""
        WITH RECURSIVE {_SMALL},
        judged AS (
          SELECT 'balance' AS feature, 'ks' AS method, p AS value FROM ks
          UNION ALL SELECT 'region', 'chi_square', exp(-h) * (1 + h) FROM chi
          UNION ALL SELECT 'in_debt', 'z_test', 1 - e FROM erf)
        SELECT feature, method, round(value, 6) AS value, CAST(0.05 AS DOUBLE) AS threshold, value < 0.05 AS drifted FROM judged""",
    "i2_distances": f"""
        SELECT feature, ref_rows, cur_rows, "distinct", round(wasserstein, 6) AS wasserstein, round(ks, 6) AS ks, round(jensen_shannon, 6) AS jensen_shannon
        FROM {_DISTANCES}""",
    "i3_drift_share": f"""
        SELECT round(avg(CAST(drifted AS INTEGER)), 6) AS share, CASE WHEN avg(CAST(drifted AS INTEGER)) > 0.2 THEN 'exceeded' ELSE 'did not exceed' END AS drift_msg,
               coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE drifted), '') AS drifted FROM {_DRIFT}""",
    "i4_monitoring_record": f"""
        SELECT '3' AS model_version, '2024-02-01_00-00-00_UTC' AS stamp, round(rmse, 6) AS new_rmse,
               CASE WHEN rmse - 30 > 0.25 * 30 THEN 'exceeded' ELSE 'did not exceed' END AS rmse_msg, round(s, 6) AS share,
               CASE WHEN s > 0.2 THEN 'exceeded' ELSE 'did not exceed' END AS drift_msg
        FROM {_DECLINE}, (SELECT avg(CAST(drifted AS INTEGER)) AS s FROM {_DRIFT})""",
    "k2_rolling_error_batch": _ROLLING,
    "k2_rolling_error_stream": _ROLLING,
    "k1_scoring_stream": f"""
        SELECT file_id AS id, c AS user_id, has_logic AS valid, has_logic AS has_score, CAST(CASE WHEN has_logic THEN 15 ELSE 0 END AS BIGINT) AS n_features
        FROM {SOURCES}""",
}
