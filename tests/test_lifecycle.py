"""From a raw corpus to training, scoring, monitoring, retraining and streaming, on a small corpus."""

import json
from multiprocessing.pool import ThreadPool
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from gradeloom import fixed_values as fixed, schemas
from gradeloom.operators import recommend as rec
from gradeloom.operators.attribution import forest_nodes, leaf_boxes
from gradeloom.operators.evaluate import metrics
from gradeloom.operators.forest import draw_trials, feature_importance, guided_search, out_of_fold_predictions
from gradeloom.plans.effects import mined_effects, publish_for
from gradeloom.plans.monitoring import deploy, monitoring_report, retrain
from gradeloom.plans.scoring import Scorer
from gradeloom.plans.training import curated_corpus, labelled_features, train_and_register
from gradeloom.schemas import RAW_CORPUS
from gradeloom.sources import published
from gradeloom.sources.corpus import assign_ids, read_corpus, read_csv_corpus, write_csv_corpus
from gradeloom.sources.registry import Registry
from gradeloom.sources.submissions import append_submissions, get_submissions, read_submissions
from gradeloom.streaming.jobs import first_arrivals, latest_windows, rolling_error, start_rolling_error, start_scoring, submission_stream

FEATURES = fixed.TRANSFORMED_FEATURES
TRIALS = [
    {"trees": 4, "max_depth": 4, "min_leaf": 1, "subset": "all"},
    {"trees": 3, "max_depth": 3, "min_leaf": 2, "subset": "sqrt"},
]


def source(i):
    parts = ['"""module doc"""' if i % 2 else "# plain", "import os", "import sys" if i % 3 else "", f"value_{i % 5} = {i}"]
    for j in range(i % 7):
        doc = '    """doc"""\n' if (i + j) % 2 else ""
        parts.append(f"\ndef func_{j}(a, b):\n{doc}    if a > {j}:\n        return b\n    return os.path.join(a, b)\n")
    if i % 4 == 0:
        parts.append("class Thing:\n    def run(self):\n        return 1\n")
    return "\n".join(parts) + "\n"


def score_of(i):
    return round(min(10.0, 3.0 + (i % 7) + (1 if i % 2 else 0)), 2)


def report(score, error=0):
    return json.dumps({"statistics": {"messageTypeCount": {"fatal": 0, "error": error}, "score": score}})


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("life"))
    raw = [(i, source(i), f"dev{i % 23}/repo{i}", "mit" if i % 11 else "gpl-3.0", len(source(i)), "python", 0.5) for i in range(240)]
    spark.createDataFrame(raw, RAW_CORPUS).write.parquet(f"{root}/raw")
    reports = spark.createDataFrame([(i, report(score_of(i), int(i % 29 == 0))) for i in range(240)], "file_id BIGINT, pylint_text STRING")
    dataset = labelled_features(curated_corpus(read_corpus(spark, f"{root}/raw")), reports)
    registry = Registry(spark, f"{root}/registry")
    model, version, run_id = train_and_register(registry, dataset, f"{root}/data", "features_v3", "model", "search", trials=TRIALS)
    return {"root": root, "registry": registry, "model": model, "version": version, "run_id": run_id, "dataset": dataset}


def test_dataset(world):
    rows = world["dataset"].select("file_id", "developer", "pylint_score", *FEATURES).collect()
    assert rows and all(r["file_id"] % 11 and r["file_id"] % 29 for r in rows)
    assert all(v is not None for r in rows for v in r)


def test_registry(world):
    registry = world["registry"]
    assert world["version"] == 1
    assert registry.resolve_alias("model", "production") == 1
    assert registry.find_run("search")["run_id"] == world["run_id"]
    assert registry.find_run("nothing") is None
    rmse, train = registry.training_set("model", 1)
    assert rmse > 0 and 0 < train.count() < world["dataset"].count()
    with pytest.raises(LookupError):
        registry.resolve_alias("model", "staging")


def test_importance_and_folds(spark, world):
    table = feature_importance(spark, world["model"], FEATURES).collect()
    assert len(table) == 15 and abs(sum(r["importance"] for r in table) - 1) < 1e-9
    data = spark.read.parquet(f"{world['root']}/data/features_v3")
    oof = out_of_fold_predictions(data, FEATURES, "pylint_score", "file_id", folds=3, trees=3, max_depth=4)
    assert oof.count() == data.count()
    assert metrics(oof, "pylint_score").first()["rmse"] < 4


def test_trials_stay_in_the_search_space():
    trials = draw_trials(200)
    assert len(trials) == 200
    assert all(100 <= t["trees"] <= 600 and 3 <= t["max_depth"] <= 30 and 1 <= t["min_leaf"] <= 10 for t in trials)
    assert draw_trials(50, 1) == draw_trials(50, 1)


@pytest.fixture(scope="module")
def scorer(spark, world):
    background = spark.read.parquet(f"{world['root']}/data/features_v3").select(*FEATURES).limit(60)
    mined = spark.createDataFrame([("characters", "range", 300.0, 400.0)], "feature STRING, kind STRING, lo DOUBLE, hi DOUBLE")
    effects = rec.override_effects(mined, rec.fixed_effects(spark))
    return Scorer(
        world["model"], "1", background, leaf_boxes(forest_nodes(spark, world["model"])), effects,
        rec.dependencies_table(spark, 1), rec.messages_table(spark, 1),
    )


@pytest.fixture(scope="module")
def incoming(spark):
    rows = [(i, i % 6, source(i) if i % 10 else "# nothing", datetime(2024, 1, 1 + i % 20, tzinfo=timezone.utc)) for i in range(60)]
    return spark.createDataFrame(rows, "id BIGINT, user_id BIGINT, raw_code STRING, created_at TIMESTAMP")


def test_scoring(scorer, incoming):
    rows = {r["id"]: r for r in scorer.score(incoming).collect()}
    assert len(rows) == 60
    assert rows[0]["prediction_output"] == -1 and rows[0]["message"] == fixed.INVALID_MESSAGE and rows[0]["extracted_features"] == {}
    assert 0 <= rows[7]["prediction_output"] <= 10
    assert rows[7]["message"].startswith("Estimated score: ") and set(rows[7]["extracted_features"]) == set(FEATURES)
    assert "Suggested improvements" in rows[7]["message"]


def test_monitor_retrain_deploy(spark, world, scorer, incoming):
    registry, path = world["registry"], f"{world['root']}/submissions"
    append_submissions(scorer.score(incoming), path)
    append_submissions(scorer.score(incoming), path)  # repeated batch
    stored = spark.read.parquet(path)
    assert stored.count() == 60
    reports = spark.createDataFrame([(i, report(score_of(i))) for i in range(60)], "id BIGINT, pylint_text STRING")
    record = monitoring_report(registry, stored, reports, "model", max_time="2024-02-01_00-00-00_UTC").first()
    assert record["model_version"] == "1" and record["new_rmse"] > 0 and 0 <= record["share"] <= 1
    assert record["rmse_msg"] in ("exceeded", "did not exceed")

    run_id, model, compared = retrain(
        registry, stored, reports, "model", 1, "2036-02-01_00-00-00_UTC", f"{world['root']}/data", trials=TRIALS[:1]
    )
    assert {r["version"] for r in compared.collect()} == {"old", "new"}
    assert registry.run_of("model", 1)["run_id"] == world["run_id"]
    assert deploy(registry, run_id, "model") == 2
    assert registry.resolve_alias("model", "production") == 2
    assert registry.training_set("model", 2)[1].count() > 0


def test_scan_and_lookup(spark, incoming):
    rows = incoming.withColumn("model_version", F.lit("1"))
    got, stamp = read_submissions(rows, "1", "2024-01-05_00-00-00_UTC")
    assert stamp == "2024-01-05_00-00-00_UTC" and got.count() == 15  # the last moment is included
    first, _ = read_submissions(rows, "1", limit=4)
    assert [r["id"] for r in first.orderBy("created_at", "id").collect()] == [0, 20, 40, 1]
    assert read_submissions(rows, "2")[0].count() == 0
    wanted = spark.createDataFrame([(1, 1), (2, 5), (99, 1)], "id BIGINT, user_id BIGINT")
    assert [r["id"] for r in get_submissions(rows, wanted).collect()] == [1]


def test_publish_falls_back_to_the_version_before(spark, tmp_path):
    root = str(tmp_path)
    effects = rec.effects_table(rec.fixed_effects(spark), 1)
    published.publish_reco_data(spark, root, 1, effects, rec.dependencies_table(spark, 1), rec.messages_table(spark, 1))
    new = rec.effects_table(rec.fixed_effects(spark, {"characters": "always"}), 2)
    published.publish_reco_data(spark, root, 2, effects=new)
    assert published.read_reco_part(spark, root, "effects", 2).count() == 1
    assert published.read_reco_part(spark, root, "effects", 1).count() == 6
    assert published.read_reco_part(spark, root, "messages", 2).count() == len(fixed.MESSAGES)
    with pytest.raises(LookupError):
        published.publish_reco_data(spark, root, 4)


def test_mined_effects_are_published(spark, world, tmp_path):
    train = spark.read.parquet(f"{world['root']}/data/features_v3")
    effects = mined_effects(world["model"], train)
    publish_for(spark, str(tmp_path), 1, effects, fixed.DEPENDENCIES, fixed.MESSAGES)
    rows = {r["feature"]: r for r in published.read_reco_part(spark, str(tmp_path), "effects", 1).collect()}
    assert set(rows) == set(FEATURES)
    assert rows["long_line"]["kind"] == "never" and rows["has_docstring"]["kind"] == "always"
    for r in rows.values():
        assert r["kind"] in ("never", "always") or r["lo"] <= r["hi"]
    # logged features are mined on their own scale
    assert rows["characters"]["kind"] == "never" or rows["characters"]["hi"] > 50


def test_scoring_does_not_shuffle(scorer, incoming):
    plan = scorer.score(incoming)._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("Subqueries")[0].split("Subquery")[0]
    assert "Join" not in scan and scan.count("Exchange") == 0


def test_csv_round_trip(spark, tables, tmp_path):
    docs = tables.documents
    extra = spark.createDataFrame([(-1, 'a "quoted", text\r\n  with\nlines ', "en", "s", 3)], docs.schema)
    df = docs.unionByName(extra)
    write_csv_corpus(df, str(tmp_path / "csv"))
    back = read_csv_corpus(spark, str(tmp_path / "csv"), "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_ids_are_frozen(spark, tables, tmp_path):
    df = assign_ids(tables.documents.repartition(4), str(tmp_path / "ids"))
    assert df.select("file_id").distinct().count() == tables.documents.count()


def test_scoring_stream_equals_batch(spark, scorer, incoming, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    incoming.repartition(3).write.parquet(src)
    incoming.limit(5).write.mode("append").parquet(src)  # sent twice
    stream = submission_stream(spark, src, incoming.schema, files_per_batch=2)
    start_scoring(stream, scorer.score, sink, str(tmp_path / "cp"), available_now=True).awaitTermination()
    streamed = {r["id"]: (round(r["prediction_output"], 9), r["message"]) for r in spark.read.parquet(sink).collect()}
    batch = {r["id"]: (round(r["prediction_output"], 9), r["message"]) for r in scorer.score(incoming).collect()}
    assert spark.read.parquet(sink).count() == 60 and streamed == batch


def test_rolling_error_stream_equals_batch(spark, tables, tmp_path):
    df = tables.events.select(
        F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("model_version"), "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    src = str(tmp_path / "in")
    df.orderBy("created_at").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(src)
    stream = submission_stream(spark, src, df.schema, files_per_batch=1)
    sink = str(tmp_path / "out")
    start_rolling_error(rolling_error(stream, "value", "k", delay="40 days"), sink, str(tmp_path / "cp"), True).awaitTermination()

    def rows(d):
        return {(r["start"], r["model_version"]): (round(r["rmse"], 9), r["n"]) for r in d.collect()}

    assert rows(latest_windows(spark, sink)) == rows(rolling_error(df, "value", "k"))


def test_late_rows_are_not_counted(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "created_at TIMESTAMP, model_version STRING, y DOUBLE, p DOUBLE"

    def send(*days):
        spark.createDataFrame([(datetime(2024, 1, d, 12, tzinfo=timezone.utc), "1", 1.0, 0.0) for d in days], schema).coalesce(1).write.mode(
            "append"
        ).parquet(src)
        job = rolling_error(submission_stream(spark, src, schema, 1), "y", "p")
        start_rolling_error(job, sink, str(tmp_path / "cp"), True).awaitTermination()

    send(1)
    send(10)
    send(1, 10)  # the first is nine days late
    got = {r["start"].day: r["n"] for r in latest_windows(spark, sink).collect()}
    assert got == {1: 1, 10: 2}


def test_failing_part_publishes_nothing(spark, tmp_path):
    root = str(tmp_path)
    effects = spark.createDataFrame([(1, "a", "always", None, None)], schemas.EFFECTS)
    published.publish_reco_data(spark, root, 1, effects, rec.dependencies_table(spark, 1, {}), rec.messages_table(spark, 1))
    broken = rec.messages_table(spark, 2).withColumn("message", F.raise_error(F.lit("no message")))
    with pytest.raises(Exception, match="no message"):
        published.publish_reco_data(spark, root, 2, effects, None, broken)
    assert published.read_reco_part(spark, root, "effects", 2).count() == 0
    with pytest.raises(LookupError):
        published.publish_reco_data(spark, root, 3, effects)
    published.publish_reco_data(spark, root, 2, messages=rec.messages_table(spark, 2))
    assert published.read_reco_part(spark, root, "effects", 2).count() == 1
    assert published.read_reco_part(spark, root, "dependencies", 2).count() == 0


def test_model_comes_back_in_another_registry(spark, tmp_path, tables):
    from gradeloom.operators.forest import fit_forest, predict
    from gradeloom.sources.registry import Registry

    rows = tables.lineitem.limit(500)
    model = fit_forest(rows, ["l_quantity", "l_tax"], "l_extendedprice", trees=2, max_depth=3)
    registry = Registry(spark, str(tmp_path))
    run = registry.log_run("fit", {}, {}, {}, model=model)
    registry.log_trials(run, spark.createDataFrame([(0, 1.5)], "trial INT, cv_rmse DOUBLE"))
    version = registry.register("price", run)
    other = Registry(spark, str(tmp_path))
    loaded = other.load_model("price", version)
    want = [r.prediction for r in predict(rows, model, ["l_quantity", "l_tax"]).collect()]
    assert [r.prediction for r in predict(rows, loaded, ["l_quantity", "l_tax"]).collect()] == want
    assert other.trials_of(run).first().cv_rmse == 1.5
    with pytest.raises(LookupError):
        other.load_model("price", 7)


def test_submissions_are_stored_however_late(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    for part in ([(1, day(20)), (2, day(20)), (1, day(20))], [(3, day(5)), (2, day(20))], [(3, day(5)), (4, day(1))]):
        spark.createDataFrame(part, "id LONG, created_at TIMESTAMP").coalesce(1).write.mode("append").parquet(source)
        stream = submission_stream(spark, source, "id LONG, created_at TIMESTAMP", 1)
        start_scoring(stream, lambda b: b, sink, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3, 4]


def test_scorer_from_the_registry(spark, world, tmp_path):
    effects = rec.effects_table(rec.fixed_effects(spark), 1)
    for version in (1, 2):  # another test may have deployed a second version
        published.publish_reco_data(spark, str(tmp_path), version, effects, rec.dependencies_table(spark, version), rec.messages_table(spark, version))
    scorer = Scorer.from_registry(world["registry"], str(tmp_path), "model")
    rows = spark.createDataFrame([(1, 7, source(3), datetime(2024, 1, 1, tzinfo=timezone.utc)), (2, 7, "def (", datetime(2024, 1, 1, tzinfo=timezone.utc))], "id LONG, user_id LONG, raw_code STRING, created_at TIMESTAMP")
    got = {r.id: r for r in scorer.score(rows).collect()}
    assert got[1].prediction_output > 0 and got[1].message.startswith("Estimated score") and got[2].prediction_output == -1
    assert world["registry"].trials_of(world["run_id"]).count() == len(TRIALS)


def test_submissions_without_an_id_or_a_time_count_once(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    schema = "id LONG, created_at TIMESTAMP, code STRING"
    for part in ([(1, None, "a"), (None, day(1), "b"), (None, day(1), "b")], [(1, day(9), "a"), (None, day(1), "c"), (None, day(1), "b")], [(1, None, "z"), (2, None, "b")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        stream = submission_stream(spark, source, schema, 2)
        start_scoring(stream, lambda b: b, sink, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted((r.id or 0, r.code) for r in spark.read.parquet(sink).collect()) == [(0, "b"), (0, "c"), (1, "a"), (2, "b")]


def test_first_arrivals_read_no_sink(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, "a")], "id LONG, x STRING")
    assert sorted((r.id or 0) for r in first_arrivals(df).collect()) == [0, 1]


def test_concurrent_writers_get_numbers_of_their_own(spark, tmp_path):
    registries = [Registry(spark, str(tmp_path)) for _ in range(6)]
    with ThreadPool(6) as pool:
        numbers = pool.map(lambda i: registries[i].register("price/1", f"run{i}"), range(6))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    assert {r.version: r.run_id for r in registries[0].versions.collect()} == {n: f"run{i}" for i, n in enumerate(numbers)}
    assert registries[1].register("other", "x") == 1 and registries[2].register("price/1", "y") == 7


def test_the_last_move_of_an_alias_holds_whatever_the_clock(spark, tmp_path, monkeypatch):
    registry = Registry(spark, str(tmp_path))
    registry.set_alias("price", "production", 4)

    class Behind:
        now = staticmethod(lambda zone: datetime(2001, 1, 1, tzinfo=zone))

    monkeypatch.setattr("gradeloom.sources.registry.datetime", Behind)
    registry.set_alias("price", "production", 3)
    assert registry.resolve_alias("price", "production") == 3


def test_files_without_a_readable_report_are_quarantined(spark, world, tmp_path):
    corpus = spark.createDataFrame([(1, source(1), "a/x"), (2, source(2), "b/x"), (3, source(3), "c/x")], "file_id LONG, text STRING, repo_name STRING")
    good = json.dumps({"statistics": {"messageTypeCount": {"fatal": 0, "error": 0}, "score": 5.0}})
    reports = spark.createDataFrame([(1, good), (2, "{")], "file_id LONG, pylint_text STRING")
    kept = labelled_features(corpus, reports, quarantine=str(tmp_path / "q"))
    plain = labelled_features(corpus, reports)
    assert kept.columns == plain.columns and [r.file_id for r in kept.collect()] == [r.file_id for r in plain.collect()] == [1]
    bad = spark.read.parquet(str(tmp_path / "q")).filter("sink = 'quarantined'").collect()
    assert {r.file_id: r.fault for r in bad} == {2: "unreadable report", 3: "missing report"}


def test_appended_submissions_without_a_time_are_found_again(spark, tmp_path):
    path, day = str(tmp_path / "s"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = spark.createDataFrame([(1, None), (2, day), (3, None)], "id LONG, created_at TIMESTAMP")
    for part in (rows, rows, rows.filter("id = 1"), rows.filter("id = 2"), spark.createDataFrame([(4, None), (3, None)], rows.schema)):
        append_submissions(part, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]


def test_training_by_a_study_logs_the_out_of_bag_error(spark, world, tmp_path, monkeypatch):
    calls = []

    def short(*args, **kwargs):
        calls.append(kwargs["study"])
        return guided_search(*args, **kwargs, trials=3, round_size=2, folds=2, space={"trees": (2, 4), "max_depth": (2, 5), "min_leaf": (1, 4), "subset": ["all"]})

    monkeypatch.setattr("gradeloom.plans.training.guided_search", short)
    registry = Registry(spark, str(tmp_path / "registry"))
    _, version, run_id = train_and_register(registry, world["dataset"], str(tmp_path), "set", "model", "fit", study="first", oob_trees=12)
    run = registry.run_of("model", version)
    assert calls == ["first"] and registry.trials_of("first").count() == 3 and run["run_id"] == run_id
    assert 0 < run["metrics"]["oob_rmse"] < 10
