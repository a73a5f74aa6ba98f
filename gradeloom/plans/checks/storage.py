"""Sources and sinks: corpora, stages, submissions, registry, published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import recommend as rec
from gradeloom.operators.monitor import performance_decline
from gradeloom.plans.checks.attribution import MINED_SQL, mined_from_events
from gradeloom.plans.checks.tables import EVENTS, SUBMISSIONS, submissions, table
from gradeloom.session import scratch_path
from gradeloom.sources import published
from gradeloom.sources.corpus import read_corpus, read_csv_corpus, read_stage, write_csv_corpus, write_stage
from gradeloom.sources.registry import Registry, newest
from gradeloom.sources.submissions import append_submissions, get_submissions, read_submissions

DOCUMENT_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
UNTIL = "2024-01-20_12-00-00_UTC"


def _digest(df):
    return df.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_DIGEST_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"


def corpus_scan(spark, folder):
    return _digest(read_corpus(spark, f"{folder}/documents.parquet", schema=DOCUMENT_SCHEMA))


def corpus_split(spark, folder):
    path = scratch_path(spark, "corpus")
    table(spark, folder, "documents").withColumn("split", F.col("lang")).write.partitionBy("split").parquet(path)
    return _digest(read_corpus(spark, path, "en", DOCUMENT_SCHEMA))


def csv_round_trip(spark, folder):
    path = scratch_path(spark, "csv")
    write_csv_corpus(table(spark, folder, "documents"), path)
    return _digest(read_csv_corpus(spark, path, DOCUMENT_SCHEMA))


def stage_round_trip(spark, folder):
    return _digest(read_stage(spark, write_stage(table(spark, folder, "documents"), "documents")))


def submissions_until(spark, folder):
    return read_submissions(submissions(spark, folder), "click", UNTIL)[0].select("id", "user_id", "prediction_output", "k")


def first_submissions(spark, folder):
    return read_submissions(submissions(spark, folder), "view", UNTIL, 100)[0].select("id", "user_id", "prediction_output")


def appended(spark, folder):
    """Two overlapping batches; what is in both is stored once."""
    rows, path = submissions(spark, folder), scratch_path(spark, "appended")
    append_submissions(rows.filter("created_at < timestamp'2024-01-20 00:00:00'"), path)
    append_submissions(rows.filter("created_at >= timestamp'2024-01-10 00:00:00'"), path)
    return spark.read.parquet(path).select("id", "user_id", "model_version", "prediction_output")


def owner_lookup(spark, folder):
    """Every submission is asked for once, half of them by the wrong user."""
    rows = submissions(spark, folder)
    wanted = rows.select("id", F.when(F.col("k") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"))
    return get_submissions(rows, wanted).select("id", "user_id", "model_version")


def training_set(spark, folder):
    """Alias to version to run to data set, split again as its tags say."""
    data = table(spark, folder, "documents").withColumnRenamed("source", "developer")
    registry = Registry(spark, scratch_path(spark, "registry"))
    old = registry.log_run("first", {"dataset": "gone", "test_size": 0.5, "random_state": 1}, {}, {"test_rmse": 2.0})
    path = write_stage(data, "training")
    new = registry.log_run("second", {"dataset": path, "test_size": 0.3, "random_state": 7}, {}, {"test_rmse": 1.5})
    registry.set_alias("model", "production", registry.register("model", old))
    registry.set_alias("model", "production", registry.register("model", new))
    rmse, train = registry.training_set("model", registry.resolve_alias("model", "production"))
    return train.select("doc_id", "developer", F.lit(rmse).alias("test_rmse"))


def report_sink(spark, folder):
    rows, path = submissions(spark, folder), scratch_path(spark, "reports")
    for version in ("click", "view"):
        part, stamp = read_submissions(rows, version, UNTIL)
        record = performance_decline(part, "k", "prediction_output", 50.0).select(
            F.lit(version).alias("model_version"), F.lit(stamp).alias("stamp"), "*"
        )
        published.write_report(record, path, "json")
    schema = "old_rmse DOUBLE, new_rmse DOUBLE, rmse_diff DOUBLE, rmse_msg STRING, model_version STRING, stamp STRING"
    return published.read_report(spark, path, schema, "json").select(
        "model_version", "stamp", F.round("new_rmse", 6).alias("new_rmse"), "rmse_msg"
    )


def published_effects(spark, folder):
    """Version 2 brings no effects, so it takes those of version 1."""
    root = scratch_path(spark, "reco")
    published.publish_reco_data(
        spark, root, 1, rec.effects_table(mined_from_events(spark, folder), 1), rec.dependencies_table(spark, 1), rec.messages_table(spark, 1)
    )
    published.publish_reco_data(spark, root, 2, messages=rec.messages_table(spark, 2))
    return published.read_reco_part(spark, root, "effects", 2).select("model_version", "feature", "kind", "lo", "hi")


def newest_runs(spark, folder):
    """Events read as a run log: the newest run of every name."""
    log = submissions(spark, folder).select(F.col("model_version").alias("run_name"), "created_at", F.col("id").alias("run_id"))
    return newest(log, ["run_name"], "created_at", "run_id").select("run_name", "run_id")


def alias_targets(spark, folder):
    """Events read as alias moves: where every alias points now."""
    moves = submissions(spark, folder).select(
        F.col("user_id").alias("alias"), "created_at", "id", F.col("model_version").alias("version")
    )
    return newest(moves, ["alias"], "created_at", "id").select("alias", "version")


QUERIES = {
    "a1_corpus_scan": corpus_scan,
    "a1_corpus_split": corpus_split,
    "a2_csv_round_trip": csv_round_trip,
    "a3_stage_round_trip": stage_round_trip,
    "a4_submissions_until": submissions_until,
    "a4_first_submissions": first_submissions,
    "a5_append_submissions": appended,
    "a6_owner_lookup": owner_lookup,
    "a7_training_set": training_set,
    "a8_report_sink": report_sink,
    "a9_published_effects": published_effects,
    "a10_newest_runs": newest_runs,
    "a10_alias_targets": alias_targets,
}

ORACLES = {
    "a1_corpus_scan": _DIGEST_SQL,
    "a1_corpus_split": f"{_DIGEST_SQL} WHERE lang = 'en'",
    "a2_csv_round_trip": _DIGEST_SQL,
    "a3_stage_round_trip": _DIGEST_SQL,
    "a4_submissions_until": f"""
        SELECT id, user_id, prediction_output, k FROM {SUBMISSIONS}
        WHERE model_version = 'click' AND created_at <= TIMESTAMP '2024-01-20 12:00:00'""",
    "a4_first_submissions": f"""
        SELECT id, user_id, prediction_output FROM {SUBMISSIONS}
        WHERE model_version = 'view' AND created_at <= TIMESTAMP '2024-01-20 12:00:00'
        ORDER BY created_at, id LIMIT 100""",
    "a5_append_submissions": f"SELECT id, user_id, model_version, prediction_output FROM {SUBMISSIONS}",
    "a6_owner_lookup": f"""
        SELECT id, user_id, model_version FROM {SUBMISSIONS} s
        WHERE EXISTS (SELECT 1 FROM {EVENTS} w WHERE w.event_id = s.id
                      AND CASE WHEN w.k % 2 = 0 THEN w.user_id ELSE w.user_id + 1 END = s.user_id)""",
    "a7_training_set": """
        WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('7:' || source), source) AS n FROM (SELECT DISTINCT source FROM documents))
        SELECT doc_id, source AS developer, CAST(1.5 AS DOUBLE) AS test_rmse FROM documents
        WHERE source IN (SELECT source FROM g WHERE n > ceil(0.3 * (SELECT count(*) FROM g)))""",
    "a8_report_sink": f"""
        SELECT model_version, '2024-01-20_12-00-00_UTC' AS stamp, round(rmse, 6) AS new_rmse,
               CASE WHEN rmse - 50.0 > 0.25 * 50.0 THEN 'exceeded' ELSE 'did not exceed' END AS rmse_msg
        FROM (SELECT model_version, sqrt(avg((k - prediction_output) * (k - prediction_output))) AS rmse FROM {SUBMISSIONS}
              WHERE model_version IN ('click', 'view') AND created_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY model_version)""",
    "a9_published_effects": f"SELECT CAST(2 AS INTEGER) AS model_version, feature, kind, lo, hi FROM ({MINED_SQL})",
    "a10_newest_runs": f"""
        SELECT model_version AS run_name, id AS run_id FROM {SUBMISSIONS}
        QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY created_at DESC, id DESC) = 1""",
    "a10_alias_targets": f"""
        SELECT user_id AS alias, model_version AS version FROM {SUBMISSIONS}
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1""",
}
