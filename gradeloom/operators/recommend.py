"""From attributions to advice: value ranges that help, rules, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom import fixed_values as fixed
from gradeloom.functions.text import let
from gradeloom.operators.ordered import ROWS_PER_BLOCK, moving_mean, widest_positive_runs, with_rank
from gradeloom.schemas import DEPENDENCIES, EFFECTS, MESSAGES

INCREASE, DECREASE = "increase", "decrease"


# --- effects ---------------------------------------------------------------------


def undo_logs(attribution: DataFrame, log_features: list[str] = fixed.LOG_FEATURES) -> DataFrame:
    """Feature values on their original scale."""
    logged = F.col("feature").isin(log_features)
    return attribution.withColumn("value", F.when(logged, F.expm1("value")).otherwise(F.col("value")))


def mine_ranges(
    attribution: DataFrame,
    features: list[str] | None = None,
    window: int = 5,
    key: str = "row_id",
    rows_per_block: int = ROWS_PER_BLOCK,
    ranges: int | None = None,
) -> DataFrame:
    """(feature, kind, lo, hi): the widest range of values in which the smoothed effect is not negative.

    A feature without such a range is ``never``. A feature's rows are spread over
    tasks by value, so the number of rows per feature does not matter.
    """
    rows = attribution.select("feature", "value", "phi", key)
    if features is not None:
        rows = rows.filter(F.col("feature").isin(features))
    ranked = with_rank(rows, ["feature"], ["value", key], ranges=ranges)
    smooth = moving_mean(ranked, ["feature"], "phi", window, rows_per_block=rows_per_block)
    return widest_positive_runs(smooth, ["feature"], "value", window, rows_per_block=rows_per_block).select(
        "feature", F.when(F.col("lo").isNull(), F.lit("never")).otherwise(F.lit("range")).alias("kind"), "lo", "hi"
    )


def override_effects(mined: DataFrame, fixed_effects: DataFrame) -> DataFrame:
    """Both sets of effects; where a feature is in both, the fixed one holds."""
    right = fixed_effects.select("feature", F.struct("kind", "lo", "hi").alias("_fixed"))
    left = mined.select("feature", F.struct("kind", "lo", "hi").alias("_mined"))
    return left.join(right, "feature", "full_outer").select("feature", F.coalesce("_fixed", "_mined").alias("e")).select("feature", "e.*")


def fixed_effects(spark: SparkSession, effects: dict[str, str] = fixed.ONE_DIRECTIONAL_EFFECTS) -> DataFrame:
    rows = [(f, kind, None, None) for f, kind in effects.items()]
    return spark.createDataFrame(rows, "feature STRING, kind STRING, lo DOUBLE, hi DOUBLE")


def effects_table(effects: DataFrame, version: int) -> DataFrame:
    return effects.select(F.lit(version).alias("model_version"), "feature", "kind", "lo", "hi")


def dependencies_table(spark: SparkSession, version: int, dependencies: dict[str, dict] = fixed.DEPENDENCIES) -> DataFrame:
    rows = [
        (version, feature, pos, dependency, float(least))
        for feature, needs in dependencies.items()
        for pos, (dependency, least) in enumerate(needs.items())
    ]
    return spark.createDataFrame(rows, DEPENDENCIES)


def messages_table(spark: SparkSession, version: int, messages: list[tuple] = fixed.MESSAGES) -> DataFrame:
    return spark.createDataFrame([(version, *m) for m in messages], MESSAGES)


# --- rules -------------------------------------------------------------------------


def _effect_map(effects: DataFrame) -> Column:
    """feature -> (kind, lo, hi) as one value; one entry per feature."""
    entry = F.struct("feature", F.struct("kind", "lo", "hi"))
    return effects.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def _dependency_map(dependencies: DataFrame) -> Column:
    """feature -> ordered list of (pos, dependency, min_value)."""
    per_feature = dependencies.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("pos", "dependency", "min_value"))).alias("needs")
    )
    return per_feature.agg(F.map_from_entries(F.collect_list(F.struct("feature", "needs")))).scalar()


def _advice(feature: Column, direction: Column) -> Column:
    return F.struct(feature.alias("feature"), direction.alias("direction"))


def _put(advice: Column, new: Column) -> Column:
    """Set a direction: an existing entry keeps its place."""
    known = F.exists(advice, lambda x: x["feature"] == new["feature"])
    replaced = F.transform(
        advice,
        lambda x: _advice(x["feature"], F.when(x["feature"] == new["feature"], new["direction"]).otherwise(x["direction"])),
    )
    return F.when(known, replaced).otherwise(F.concat(advice, F.array(new)))


def _has(advice: Column, feature: str) -> Column:
    return F.exists(advice, lambda x: x["feature"] == feature)


def _consider(advice: Column, item: Column) -> Column:
    """Advice after looking at one more feature."""
    effect, needs = F.col("_effects")[item["feature"]], F.col("_needs")[item["feature"]]
    ranged = effect["kind"] == "range"
    direction = (
        F.when((effect["kind"] == "always") & (item["value"] == 0), F.lit(INCREASE))
        .when((effect["kind"] == "never") & (item["value"] > 0), F.lit(DECREASE))
        .when(ranged & (item["value"] < effect["lo"]), F.lit(INCREASE))
        .when(ranged & (item["value"] > effect["hi"]), F.lit(DECREASE))
    )
    by_need = F.transform(
        needs,
        lambda d: F.when(F.col("_present")[d["dependency"]] > d["min_value"], _advice(item["feature"], direction)).otherwise(
            _advice(d["dependency"], F.lit(INCREASE))
        ),
    )
    changes = (
        F.when(direction.isNull(), F.array().cast("array<struct<feature:string,direction:string>>"))
        .when(ranged & (F.size(needs) > 0), by_need)
        .otherwise(F.array(_advice(item["feature"], direction)))
    )
    changed = let(
        F.aggregate(changes, advice, _put),
        lambda a: F.when(
            _has(a, "characters") & _has(a, "effective_lines"), F.filter(a, lambda x: x["feature"] != "characters")
        ).otherwise(a),
    )
    done = (F.size(advice) >= 3) | F.exists(advice, lambda x: x["feature"] == item["feature"])
    return F.when(done, advice).otherwise(changed)


def _advise(df: DataFrame, effects: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Turn ``_ranked`` into ``recommendations``; everything happens inside the row."""
    none = F.array().cast("array<struct<feature:string,direction:string>>")
    present = F.map_concat("extracted_features", F.create_map(F.lit("effective_lines"), F.col("effective_lines").cast("double")))
    return (
        df.withColumns({"_effects": _effect_map(effects), "_needs": _dependency_map(dependencies), "_present": present})
        .withColumn(
            "recommendations",
            F.when((F.col("score") == -1) | (F.col("score") == 10) | F.col("_ranked").isNull(), none).otherwise(
                F.aggregate("_ranked", none, _consider)
            ),
        )
        .drop("_effects", "_needs", "_present", "_ranked")
    )


def recommend_rows(
    scored: DataFrame,
    effects: DataFrame,
    dependencies: DataFrame,
    features: list[str],
    phi: str = "phi",
    log_features: list[str] = fixed.LOG_FEATURES,
) -> DataFrame:
    """Add ``recommendations``: ordered (feature, direction), at most about three per row.

    ``scored`` has ``score``, ``extracted_features``, ``effective_lines`` and an
    array of effects in the order of ``features``. Features are visited from the
    most negative effect on; equal ones in feature order. Files scored -1 or 10
    get none. Nothing is shuffled.
    """

    def value(name: str) -> Column:
        stored = F.col("extracted_features")[name]
        return F.expm1(stored) if name in log_features else stored

    entries = [
        F.struct(F.get(phi, F.lit(i)).alias("phi"), F.lit(i).alias("pos"), F.lit(c).alias("feature"), value(c).alias("value"))
        for i, c in enumerate(features)
    ]
    return _advise(scored.withColumn("_ranked", F.array_sort(F.array(*entries))), effects, dependencies)


def recommend(
    scored: DataFrame,
    attribution: DataFrame,
    effects: DataFrame,
    dependencies: DataFrame,
    key: str = "row_id",
    log_features: list[str] = fixed.LOG_FEATURES,
) -> DataFrame:
    """The same from a long attribution table, joined on the key."""
    # as many entries per row as there are features
    ranked = undo_logs(attribution, log_features).groupBy(F.col("row_id").alias(key)).agg(
        F.array_sort(F.collect_list(F.struct("phi", "pos", "feature", "value"))).alias("_ranked")
    )
    return _advise(scored.join(ranked, key, "left"), effects, dependencies).select(*scored.columns, "recommendations")


def with_message(df: DataFrame, messages: DataFrame) -> DataFrame:
    """Add the text shown to the user. The score prints with two decimals. Advice that has no text is an error."""
    entry = F.struct(F.concat_ws("/", "feature", "direction"), "message")
    texts = messages.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    header = F.format_string(fixed.SCORE_HEADER, F.col("score"))

    def line(r):
        name = F.concat_ws("/", r["feature"], r["direction"])
        return F.concat(F.coalesce(F.col("_texts")[name], F.raise_error(F.concat(F.lit("no text for "), name))), F.lit("\n\n"))

    lines = F.transform("recommendations", line)
    message = (
        F.when(F.col("score") == -1, F.lit(fixed.INVALID_MESSAGE))
        .when(F.col("score") == 10, F.concat(header, F.lit(fixed.PERFECT_MESSAGE)))
        .otherwise(F.concat(header, F.lit(fixed.ADVICE_HEADER), F.array_join(lines, "")))
    )
    return df.withColumn("_texts", texts).withColumn("message", message).drop("_texts")
