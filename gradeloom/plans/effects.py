"""Mine what helps from a model's own training data and publish it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom import fixed_values as fixed
from gradeloom.operators import recommend as rec
from gradeloom.operators.attribution import attribute_forest
from gradeloom.session import stage
from gradeloom.sources.published import publish_reco_data


def mined_effects(
    model,
    train: DataFrame,
    features: list[str] = fixed.TRANSFORMED_FEATURES,
    key: str = "file_id",
    window: int = 5,
    fixed_effects: dict[str, str] = fixed.ONE_DIRECTIONAL_EFFECTS,
) -> DataFrame:
    """Attribution of the training rows, mined for ranges, with the fixed effects on top.

    Attributions are kept in a stage table: they are dear to compute and mining
    reads them more than once.
    """
    phi = stage(rec.undo_logs(attribute_forest(train, train, model, features, key)), "attribution")
    ranged = [f for f in features if f not in fixed_effects]
    mined = rec.mine_ranges(phi, ranged, window)
    return rec.override_effects(mined, rec.fixed_effects(train.sparkSession, fixed_effects))


def publish_for(
    spark: SparkSession, root: str, version: int, effects: DataFrame, dependencies: dict | None = None, messages: list | None = None
) -> None:
    """Publish effects of a version; dependencies and messages are carried over unless given."""
    publish_reco_data(
        spark,
        root,
        version,
        rec.effects_table(effects, version),
        None if dependencies is None else rec.dependencies_table(spark, version, dependencies),
        None if messages is None else rec.messages_table(spark, version, messages),
    )
