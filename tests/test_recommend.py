import pytest
from pyspark.sql import functions as F

from gradeloom import fixed_values as fixed
from gradeloom.operators import recommend as rec
from gradeloom.schemas import ATTRIBUTION

EFFECTS = [
    ("characters", "range", 100.0, 1000.0),
    ("code_compactness", "range", 0.5, 0.9),
    ("avg_class_methods", "range", 2.0, 5.0),
    ("long_line", "never", None, None),
    ("has_docstring", "always", None, None),
    ("comment_ratio", "range", 0.1, 0.3),
]
NEEDS = {"code_compactness": {"effective_lines": 10}, "avg_class_methods": {"class_density": 0, "func_density": 0}}


def run(spark, score, features, phis, effective_lines, logs=()):
    scored = spark.createDataFrame(
        [(1, float(score), features, effective_lines)],
        "row_id BIGINT, score DOUBLE, extracted_features MAP<STRING,DOUBLE>, effective_lines INT",
    )
    names = [e[0] for e in EFFECTS]
    rows = [(1, f, names.index(f), features[f], p) for f, p in phis.items()]
    out = rec.recommend(
        scored,
        spark.createDataFrame(rows, ATTRIBUTION),
        spark.createDataFrame(EFFECTS, "feature STRING, kind STRING, lo DOUBLE, hi DOUBLE"),
        rec.dependencies_table(spark, 1, NEEDS),
        log_features=list(logs),
    )
    out = rec.with_message(out, rec.messages_table(spark, 1)).first()
    return [(r["feature"], r["direction"]) for r in out["recommendations"]], out["message"]


BASE = {
    "characters": 50.0, "code_compactness": 0.2, "avg_class_methods": 1.0, "long_line": 1.0,
    "has_docstring": 0.0, "comment_ratio": 0.9, "class_density": 0.0, "func_density": 0.0,
}


def test_no_advice_at_the_ends(spark):
    phis = {"long_line": -1.0}
    assert run(spark, -1, BASE, phis, 5) == ([], fixed.INVALID_MESSAGE)
    assert run(spark, 10, BASE, phis, 5) == ([], "Estimated score: 10.00\n\nCode is perfect! No suggestions\n\n")


def test_order_and_stop_after_three(spark):
    phis = {"comment_ratio": -3.0, "long_line": -2.0, "has_docstring": -1.0, "characters": 0.5}
    got, message = run(spark, 5, BASE, phis, 5)
    assert got == [("comment_ratio", "decrease"), ("long_line", "decrease"), ("has_docstring", "increase")]
    texts = {(f, d): t for f, d, t in fixed.MESSAGES}
    assert message == "Estimated score: 5.00\n\nSuggested improvements:\n\n" + "".join(texts[x] + "\n\n" for x in got)


def test_positive_attributions_are_visited_too(spark):
    got, _ = run(spark, 5, BASE, {"comment_ratio": 3.0, "long_line": 2.0}, 5)
    assert got == [("long_line", "decrease"), ("comment_ratio", "decrease")]


def test_unmet_dependency_replaces_characters(spark):
    got, _ = run(spark, 5, BASE, {"characters": -3.0, "code_compactness": -2.0}, 5)
    assert got == [("effective_lines", "increase")]


def test_met_dependency(spark):
    got, _ = run(spark, 5, BASE, {"code_compactness": -2.0}, 50)
    assert got == [("code_compactness", "increase")]


def test_several_dependencies_can_pass_three(spark):
    phis = {"long_line": -4.0, "has_docstring": -3.0, "avg_class_methods": -2.0, "comment_ratio": -1.0}
    got, _ = run(spark, 5, BASE, phis, 50)
    assert got == [("long_line", "decrease"), ("has_docstring", "increase"), ("class_density", "increase"), ("func_density", "increase")]


def test_one_met_one_unmet(spark):
    features = {**BASE, "class_density": 0.2}
    got, _ = run(spark, 5, features, {"avg_class_methods": -2.0}, 50)
    assert got == [("avg_class_methods", "increase"), ("func_density", "increase")]


def test_logged_values_are_compared_on_their_scale(spark):
    import math

    features = {**BASE, "characters": math.log1p(500.0)}
    assert run(spark, 5, features, {"characters": -1.0}, 50, ["characters"])[0] == []
    features = {**BASE, "characters": math.log1p(5000.0)}
    assert run(spark, 5, features, {"characters": -1.0}, 50, ["characters"])[0] == [("characters", "decrease")]


def test_fixed_effects_win(spark):
    mined = spark.createDataFrame(
        [("long_line", "range", 0.0, 1.0), ("characters", "range", 1.0, 2.0)], "feature STRING, kind STRING, lo DOUBLE, hi DOUBLE"
    )
    got = {r["feature"]: (r["kind"], r["lo"], r["hi"]) for r in rec.override_effects(mined, rec.fixed_effects(spark)).collect()}
    assert got["long_line"] == ("never", None, None)
    assert got["characters"] == ("range", 1.0, 2.0)
    assert got["has_docstring"][0] == "always" and len(got) == 7


@pytest.mark.parametrize("rows", [10**6, 60])
def test_mined_ranges(spark, rows):
    df = spark.range(500).select(
        F.col("id").alias("row_id"),
        F.explode(
            F.array(
                F.struct(F.lit("up").alias("feature"), F.col("id").cast("double").alias("value"), (F.col("id") - 250).cast("double").alias("phi")),
                F.struct(F.lit("bad").alias("feature"), F.col("id").cast("double").alias("value"), F.lit(-1.0).alias("phi")),
            )
        ).alias("c"),
    ).select("row_id", "c.*")
    got = {r["feature"]: (r["kind"], r["lo"], r["hi"]) for r in rec.mine_ranges(df, rows_per_block=rows).collect()}
    assert got["up"] == ("range", 250.0, 499.0)
    assert got["bad"] == ("never", None, None)


def test_advice_without_a_text_is_refused(spark):
    rows = spark.createDataFrame([(1, 5.0, [("a", "increase"), ("b", "decrease")])], "row_id INT, score DOUBLE, recommendations ARRAY<STRUCT<feature: STRING, direction: STRING>>")
    texts = rec.messages_table(spark, 1, [("a", "increase", "more a"), ("b", "decrease", "less b")])
    assert rec.with_message(rows, texts).first().message.endswith("more a\n\nless b\n\n")
    with pytest.raises(Exception, match="no text for b/decrease"):
        rec.with_message(rows, texts.filter("feature = 'a'")).collect()


def test_every_advice_that_rules_can_give_has_a_text():
    given = {(f, d) for f, d, _ in fixed.MESSAGES}
    assert {(f, "increase" if kind == "always" else "decrease") for f, kind in fixed.ONE_DIRECTIONAL_EFFECTS.items()} <= given
    assert {(d, "increase") for needs in fixed.DEPENDENCIES.values() for d in needs} <= given
