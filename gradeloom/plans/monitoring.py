"""Check a model in use and fit its successor."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import fixed_values as fixed
from gradeloom.functions.scalars import owner_of, stamp_to_timestamp
from gradeloom.operators import curate
from gradeloom.operators.evaluate import metrics
from gradeloom.operators.forest import guided_search, predict, search_forest
from gradeloom.operators.monitor import drift, drift_share, monitoring_record, performance_decline
from gradeloom.operators.retraining import combine, fill_created_at, retrain_split, with_decay_weight
from gradeloom.session import stage
from gradeloom.sources.corpus import read_stage, write_stage
from gradeloom.sources.registry import Registry
from gradeloom.sources.submissions import read_submissions


def prepared_submissions(
    rows: DataFrame, reports: DataFrame, features: list[str] = fixed.TRANSFORMED_FEATURES, quarantine: str | None = None
) -> DataFrame:
    """Valid submissions with their features as columns and a lint score. ``reports``: (id, pylint_text).

    Submissions without a readable report go to the folder ``quarantine``, if one is named.
    """
    valid = curate.drop_unscored(rows, "prediction_output")
    expanded = curate.for_training(curate.expand_map(valid, "extracted_features", features))
    scored = curate.with_lint_score(reports).select("id", "pylint_text", "pylint_score")
    labelled = expanded.join(scored, "id", "left").withColumn("developer", owner_of(F.col("repo_name")))
    fault = curate.report_fault()
    kept = curate.quarantine(labelled, fault, quarantine)[0] if quarantine else labelled.filter(fault.isNull())
    return curate.drop_unscored(kept, "pylint_score").drop("pylint_text")


def monitoring_report(
    registry: Registry,
    submissions: DataFrame,
    reports: DataFrame,
    model_name: str,
    version: int | None = None,
    max_time: str | None = None,
    features: list[str] = fixed.TRANSFORMED_FEATURES,
    quarantine: str | None = None,
) -> DataFrame:
    """One row: error decline and feature drift of a version against its training data."""
    if version is None:
        version = registry.resolve_alias(model_name, fixed.PRODUCTION_ALIAS)
    old_rmse, train = registry.training_set(model_name, version)
    rows, stamp = read_submissions(submissions, str(version), max_time)
    current = stage(prepared_submissions(rows, reports, features, quarantine), "prepared")
    decline = performance_decline(current, "pylint_score", "prediction_output", old_rmse)
    return monitoring_record(decline, drift_share(drift(train, current, features)), str(version), stamp)


def retrain(
    registry: Registry,
    submissions: DataFrame,
    reports: DataFrame,
    model_name: str,
    version: int,
    stamp: str,
    dataset_root: str,
    features: list[str] = fixed.TRANSFORMED_FEATURES,
    test_share: float = fixed.TEST_SHARE,
    seed: int = 0,
    trials: list[dict] | None = None,
    quarantine: str | None = None,
    study: str | None = None,
):
    """Fit on old and new data with decayed weights; compare old and new model on new owners.

    The old model is loaded by its version. The new one is stored with its run and
    its trials. With the name of a ``study`` the search is guided and goes on where an
    earlier call with that name stopped. Returns (run id, new model, table of metrics by version).
    """
    run = registry.run_of(model_name, version)
    old_model = registry.load_model(model_name, version)
    old = fill_created_at(read_stage(registry.spark, run["tags"]["dataset"]), F.lit(run["end_time"]))
    rows, _ = read_submissions(submissions, str(version), stamp)
    new = prepared_submissions(rows, reports, features, quarantine)
    old_keyed = old.withColumn("row_key", F.concat(F.lit("old-"), F.col("file_id" if "file_id" in old.columns else "row_key").cast("string")))
    new_keyed = new.withColumn("row_key", F.concat(F.lit("new-"), F.col("id").cast("string")))
    path = write_stage(combine(old_keyed, new_keyed), f"grown_set_{version}_{stamp}", dataset_root)
    marked = retrain_split(read_stage(registry.spark, path), "developer", test_share, seed)
    train = with_decay_weight(marked.filter(~F.col("is_test")), stamp_to_timestamp(F.lit(stamp)))
    test = stage(marked.filter("is_test"), "retrain-test")

    if study and trials is None:
        model, table, best = guided_search(train, features, "pylint_score", "row_key", seed=seed, weight="weight", registry=registry, study=study)
    else:
        model, table, best = search_forest(train, features, "pylint_score", "row_key", trials, seed=seed, weight="weight")

    def judged(m, name: str) -> DataFrame:
        return metrics(predict(test, m, features), "pylint_score").withColumn("version", F.lit(name))

    compared = stage(judged(old_model, "old").unionByName(judged(model, "new")), "compared")
    scores = compared.filter("version = 'new'").first()
    run_id = registry.log_run(
        f"refit_{version}_{stamp}",
        tags={"dataset": path, "test_size": test_share, "random_state": seed, "half_life_days": fixed.HALF_LIFE_DAYS},
        params=best,
        metrics={
            "best_cv_rmse": table.agg(F.min("cv_rmse")).first()[0],
            "test_mae": scores["mae"],
            "test_rmse": scores["rmse"],
            "test_r2": scores["r2"],
        },
        model=model,
    )
    registry.log_trials(run_id, table)
    return run_id, model, compared


def deploy(registry: Registry, run_id: str, model_name: str) -> int:
    """Register a run's model and move the production alias to it."""
    version = registry.register(model_name, run_id)
    registry.set_alias(model_name, fixed.PRODUCTION_ALIAS, version)
    return version
