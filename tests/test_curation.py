import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import curate, profile
from gradeloom.operators.monitor import chi_square_p_value, drift, drift_share, kolmogorov_p_value, limit_kolmogorov_p_value, two_share_p_value
from gradeloom.operators.retraining import combine, retrain_split, with_decay_weight
from gradeloom.operators.split import count_common_owners, split_by_owner, split_by_row, with_split


def test_lint_report(spark):
    def report(fatal, error, score):
        return json.dumps({"statistics": {"messageTypeCount": {"fatal": fatal, "error": error, "warning": 3}, "score": score}})

    rows = [(1, report(0, 0, 7.5)), (2, report(1, 0, 7.5)), (3, report(0, 2, 7.5)), (4, "{not json"), (5, None)]
    df = curate.with_lint_score(spark.createDataFrame(rows, "file_id BIGINT, pylint_text STRING"))
    got = {r["file_id"]: r["pylint_score"] for r in df.collect()}
    assert got == {1: 7.5, 2: -1.0, 3: -1.0, 4: None, 5: None}
    assert {r["file_id"] for r in curate.unreadable_reports(df).collect()} == {4, 5}


def test_licenses_and_directives(spark):
    rows = [(1, "mit", "x = 1"), (2, "MIT", "x"), (3, None, "x"), (4, "isc", "# pylint: skip-file"), (5, "gpl-3.0", "x"), (6, "isc", None)]
    df = spark.createDataFrame(rows, "file_id BIGINT, license STRING, text STRING")
    kept = curate.exclude_directives(curate.allow_licenses(df))
    assert [r["file_id"] for r in kept.collect()] == [1]


def test_json_schema_and_expansion(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"b": 2.5}'), (3, "broken")], "id BIGINT, j STRING")
    schema = curate.json_schema_of(df, "j")
    got = {r["id"]: (r["a"], r["b"]) for r in curate.expand_json(df, "j", schema).collect()}
    assert got[1][0] == 1 and got[2][1] is not None and got[3] == (None, None)


def test_sample(tables):
    a = curate.sample_rows(tables.orders, 50, "o_orderkey", 3)
    b = curate.sample_rows(tables.orders.repartition(5), 50, "o_orderkey", 3)
    keys = {r["o_orderkey"] for r in a.collect()}
    assert len(keys) == 50 and keys == {r["o_orderkey"] for r in b.collect()}


def test_quantile_filter_reaches_the_scan(tables):
    df = curate.trim_below_quantile(tables.documents, "n_chars", 0.99)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(n_chars" in plan


def test_owner_split(tables):
    df = tables.documents.withColumnRenamed("source", "developer")
    train, test = split_by_owner(df, 0.3)
    assert train.count() + test.count() == df.count()
    assert count_common_owners(train, test, "developer").first()[0] == 0
    assert test.select("developer").distinct().count() == math.ceil(0.3 * df.select("developer").distinct().count())
    again = split_by_owner(df.repartition(7), 0.3)[1]
    assert {r[0] for r in test.select("doc_id").collect()} == {r[0] for r in again.select("doc_id").collect()}


def test_split_does_not_shuffle_the_rows(tables):
    plan = with_split(tables.events, "user_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_row_split_leaks(tables):
    train, test = split_by_row(tables.orders, "o_orderkey", 0.3)
    assert test.count() == math.ceil(0.3 * tables.orders.count())
    assert count_common_owners(train, test, "o_custkey").first()[0] > 0


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_split_ends(tables, share):
    n = with_split(tables.events, "user_id", share).filter("is_test").count()
    assert n == (0 if share == 0 else tables.events.count())


def test_decay(spark):
    df = spark.sql("select timestamp'2024-01-31 00:00:00' as created_at union all select timestamp'2024-01-01 00:00:00'")
    cutoff = F.lit("2024-01-31 00:00:00").cast("timestamp")
    got = sorted(r["weight"] for r in with_decay_weight(df, cutoff).collect())
    assert got == pytest.approx([0.5, 1.0])
    with pytest.raises(Exception, match="after the given cutoff"):
        with_decay_weight(df, F.lit("2024-01-30 00:00:00").cast("timestamp")).collect()


def test_retrain_split(spark):
    old = spark.createDataFrame([(f"o{i % 5}", float(i), 1) for i in range(50)], "developer STRING, y DOUBLE, only_old INT")
    new = spark.createDataFrame([(f"n{i % 10}", float(i)) for i in range(100)], "developer STRING, y DOUBLE")
    marked = retrain_split(combine(old, new), "developer", 0.3)
    assert "only_old" not in marked.columns
    assert marked.filter("is_test and not is_new").count() == 0
    assert marked.filter("is_test").select("developer").distinct().count() == 3


def test_p_values():
    assert kolmogorov_p_value(0.0, 100, 100) == 1.0
    assert limit_kolmogorov_p_value(1.358 * math.sqrt(2 / 1000), 1000, 1000) == pytest.approx(0.05, abs=1e-3)
    assert chi_square_p_value(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi_square_p_value(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert chi_square_p_value(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert two_share_p_value(0.5, 100, 0.5, 100) == 1.0


def test_drift_small_and_large(spark):
    def frame(n, shift):
        return spark.range(n).select(
            ((F.col("id") * 37) % 101 + shift).cast("double").alias("num"),
            ((F.col("id") + shift) % 2 == 0).cast("double").alias("flag"),
            (F.col("id") % 3).cast("double").alias("three"),
        )

    cols = ["num", "flag", "three"]
    same = {r["feature"]: r for r in drift(frame(606, 0), frame(606, 0), cols).collect()}
    assert not any(r["drifted"] for r in same.values())
    assert same["num"]["method"] == "ks" and same["flag"]["method"] == "z_test" and same["three"]["method"] == "chi_square"
    moved = {r["feature"]: r for r in drift(frame(2020, 0), frame(2020, 40), cols).collect()}
    assert moved["num"]["method"] == "wasserstein" and moved["num"]["drifted"]
    assert moved["three"]["method"] == "jensen_shannon" and not moved["three"]["drifted"]
    share = drift_share(drift(frame(2020, 0), frame(2020, 40), cols)).first()
    assert share["share"] == pytest.approx(1 / 3) and share["drift_msg"] == "exceeded" and set(share["drifts"]) == {"num"}


def test_drift_distributed_path_agrees(tables):
    e = tables.events
    a, b = e.filter("ts < '2024-01-15'"), e.filter("ts >= '2024-01-15'")
    one = {r["feature"]: r["value"] for r in drift(a, b, ["value", "user_id"]).collect()}
    many = {r["feature"]: r["value"] for r in drift(a, b, ["value", "user_id"], ranges=7).collect()}
    for k in one:
        assert many[k] == pytest.approx(one[k], rel=1e-9)


@pytest.mark.parametrize("n", [0, 1, 40, 99, 100, 500])
def test_samples_have_their_size_with_nulls_and_repeats(spark, n):
    rows = [(None if i % 4 == 0 else i % 7, i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "k LONG, v LONG")
    got = curate.sample_rows(df, n, "k", 1).collect()
    assert len(got) == min(n, 100)
    left = list(rows)
    for r in got:
        left.remove((r.k, r.v))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, curate.sample_rows(df.repartition(9), n, "k", 1).collect()), key=str)


def test_small_cells_are_descended_to(spark, monkeypatch):
    from gradeloom.operators import split

    df = spark.range(500).selectExpr("id AS k")
    want = split.hash_boundary(df, "k", lambda n: 123, 0)
    monkeypatch.setattr(split, "CELL", 2)
    monkeypatch.setattr(split, "PREFIX_DIGITS", 1)
    assert split.hash_boundary(df, "k", lambda n: 123, 0) == want


def test_rows_without_owner_are_on_one_side(spark):
    from gradeloom.operators.split import split_by_owner

    df = spark.createDataFrame([(None if i % 5 == 0 else f"o{i % 9}", i) for i in range(100)], "developer STRING, i INT")
    train, test = split_by_owner(df)
    assert train.count() + test.count() == 100
    assert 0 in (train.filter("developer IS NULL").count(), test.filter("developer IS NULL").count())


def test_trees_too_deep_are_refused(spark):
    from gradeloom.operators.forest import draw_trials, forest

    with pytest.raises(ValueError):
        forest("y", max_depth=31)
    depths = [t["max_depth"] for t in draw_trials(2000)]
    assert (min(depths), max(depths)) == (3, 30) and depths.count(30) < 200


def test_quarantine_is_one_pass(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            reads.add(len(r))
            yield r

    good = json.dumps({"statistics": {"messageTypeCount": {"fatal": 0, "error": 0}, "score": 5.0}})
    df = spark.createDataFrame([(1, good), (2, None), (3, "{"), (4, good)], "id INT, pylint_text STRING").mapInPandas(seen, "id INT, pylint_text STRING")
    kept, bad, counts = curate.quarantine(curate.with_lint_score(df), curate.report_fault(), str(tmp_path / "q"))
    assert reads.value == 4 and counts == {"read": 4, "kept": 2, "quarantined": 2}
    assert sorted(r.id for r in kept.collect()) == [1, 4] and kept.columns == ["id", "pylint_text", "pylint_score"]
    assert {r.id: r.fault for r in bad.collect()} == {2: "missing report", 3: "unreadable report"}
    kept, bad, counts = curate.quarantine(curate.with_lint_score(df.filter("id = 1")), curate.report_fault(), str(tmp_path / "q"))
    assert (kept.count(), bad.count(), counts["quarantined"]) == (1, 0, 0)


@pytest.mark.parametrize("error", [0.01, 0.002])
def test_sketches_merge_within_their_error(spark, error):
    rng = np.random.default_rng(2)
    x = np.round(rng.lognormal(3, 2, 30_000), 1)
    df = spark.createDataFrame([(i % 7, float(v)) for i, v in enumerate(x)] + [(0, None)], "day INT, x DOUBLE").repartition(5)
    parts = profile.quantile_sketches(df, ["x"], ["day"], error).cache()
    assert parts.count() == 7
    for rows, span in ((parts, x), (parts.filter("day < 2"), x[np.arange(len(x)) % 7 < 2])):
        for r in profile.merged_quantiles(rows, [0.0, 0.05, 0.5, 0.999, 1.0]).collect():
            assert r["n"] == len(span)
            assert (span < r["value"]).mean() <= r["share"] + error and (span <= r["value"]).mean() >= r["share"] - error
    assert len(profile.merged_quantiles(parts, [0.5], ["day"]).collect()) == 7
