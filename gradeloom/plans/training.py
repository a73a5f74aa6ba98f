"""From a raw corpus to a registered model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import fixed_values as fixed
from gradeloom.functions.scalars import owner_of
from gradeloom.operators import curate
from gradeloom.operators.code_facts import keep_executable, with_code_facts
from gradeloom.operators.code_features import transformed_features
from gradeloom.operators.evaluate import metrics
from gradeloom.operators.forest import fit_bagged, guided_search, out_of_bag_predictions, predict, search_forest
from gradeloom.operators.split import split_by_owner
from gradeloom.session import stage
from gradeloom.sources.corpus import write_stage
from gradeloom.sources.registry import Registry


def curated_corpus(raw: DataFrame) -> DataFrame:
    """License, size and directive filters, cheapest first; files are parsed only after all of them."""
    sized = curate.trim_below_quantile(curate.allow_licenses(curate.format_corpus(raw)))
    return curate.exclude_directives(sized)


def labelled_features(corpus: DataFrame, reports: DataFrame, feature_stage=transformed_features, quarantine: str | None = None) -> DataFrame:
    """Features and score per file. ``reports`` has ``file_id`` and ``pylint_text``.

    The text is dropped before the join, so only numbers and reports are shuffled. Files
    without a report, or with one that cannot be read, go to the folder ``quarantine``
    by the pass that writes the others; without a folder they are left out.
    """
    featured = feature_stage(keep_executable(with_code_facts(corpus))).drop("text", "facts")
    scored = curate.with_lint_score(reports).select("file_id", "pylint_text", "pylint_score")
    labelled = featured.join(scored, "file_id", "left").withColumn("developer", owner_of(F.col("repo_name")))
    fault = curate.report_fault()
    kept = curate.quarantine(labelled, fault, quarantine)[0] if quarantine else labelled.filter(fault.isNull())
    return curate.drop_unscored(kept, "pylint_score").drop("pylint_text")


def train_and_register(
    registry: Registry,
    dataset: DataFrame,
    dataset_root: str,
    dataset_name: str,
    model_name: str,
    run_name: str,
    features: list[str] = fixed.TRANSFORMED_FEATURES,
    label: str = "pylint_score",
    key: str = "file_id",
    test_share: float = fixed.TEST_SHARE,
    seed: int = 0,
    trials: list[dict] | None = None,
    study: str | None = None,
    oob_trees: int = 0,
):
    """Search, refit, evaluate on the held-out owners, store the model with its run and
    trials, register it and point the alias at it.

    The search draws its trials, or takes those given; with the name of a ``study`` it is
    guided by what it has seen, and a call with the same name goes on where the last one
    stopped. With ``oob_trees`` the run also has the out-of-bag error of as many trees with the
    best parameters (``oob_rmse``, over training rows that some tree has not seen).
    """
    path = write_stage(dataset, dataset_name, dataset_root)
    data = dataset.sparkSession.read.parquet(path)
    train, test = split_by_owner(data, test_share, seed)
    if study and trials is None:
        model, table, best = guided_search(train, features, label, key, seed=seed, registry=registry, study=study)
    else:
        model, table, best = search_forest(train, features, label, key, trials, seed=seed)
    unseen = {}
    if oob_trees:
        params = {name: value for name, value in best.items() if name != "trees"}
        bagged = fit_bagged(train, features, label, key, trees=oob_trees, seed=seed, **params)
        judged = out_of_bag_predictions(train, bagged, features, key, seed).filter("trees > 0")
        unseen["oob_rmse"] = metrics(judged, label).first()["rmse"]
    scores = stage(metrics(predict(test, model, features), label), "metrics").first()
    run_id = registry.log_run(
        run_name,
        tags={"dataset": path, "test_size": test_share, "random_state": seed},
        params=best,
        metrics={
            "best_cv_rmse": table.agg(F.min("cv_rmse")).first()[0],
            "test_mae": scores["mae"],
            "test_rmse": scores["rmse"],
            "test_r2": scores["r2"],
            **unseen,
        },
        model=model,
    )
    registry.log_trials(run_id, table)
    version = registry.register(model_name, run_id)
    registry.set_alias(model_name, fixed.PRODUCTION_ALIAS, version)
    return model, version, run_id
