"""Score submissions and say what would improve them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from gradeloom import fixed_values as fixed
from gradeloom.operators.attribution import Explainer, forest_nodes, leaf_boxes
from gradeloom.operators.code_facts import with_code_facts
from gradeloom.operators.code_features import transformed_features
from gradeloom.operators.forest import score_sources
from gradeloom.operators.recommend import recommend_rows, with_message
from gradeloom.sources.published import read_reco_part
from gradeloom.sources.registry import Registry


@dataclass
class Scorer:
    """What scoring needs. ``background`` has the feature columns; ``leaves`` come from the model."""

    model: object
    version: str
    background: DataFrame
    leaves: DataFrame
    effects: DataFrame
    dependencies: DataFrame
    messages: DataFrame
    features: list[str] = field(default_factory=lambda: list(fixed.TRANSFORMED_FEATURES))
    feature_stage: object = transformed_features

    @classmethod
    def from_registry(cls, registry: Registry, reco_root: str, name: str, alias: str = fixed.PRODUCTION_ALIAS, **options) -> Scorer:
        """Everything by alias: the model, its training rows as background, and what is published for its version."""
        version = registry.resolve_alias(name, alias)
        model = registry.load_model(name, version)
        _, train = registry.training_set(name, version)
        features = options.get("features") or list(fixed.TRANSFORMED_FEATURES)
        parts = (read_reco_part(registry.spark, reco_root, part, version).drop("model_version") for part in ("effects", "dependencies", "messages"))
        return cls(model, str(version), train.select(*features), leaf_boxes(forest_nodes(registry.spark, model)), *parts, **options)

    @cached_property
    def explainer(self) -> Explainer:
        """Prepared on first use and shared by all batches of a stream."""
        return Explainer(self.background, self.leaves, self.features)

    def score(self, submissions: DataFrame) -> DataFrame:
        """(id, user_id, raw_code, created_at) to full submission rows with a message.

        Parsing, features, prediction, attribution and advice all happen inside
        the row: the submissions are read once and not shuffled.
        """
        parsed = with_code_facts(submissions.withColumn("text", F.col("raw_code")))
        scored = score_sources(parsed, self.model, self.features, self.feature_stage).drop("facts", "text")
        if "effective_lines" not in scored.columns:
            scored = scored.withColumn("effective_lines", F.lit(None).cast("int"))
        numbers = scored.withColumns({c: F.col("extracted_features")[c] for c in self.features})
        explained = self.explainer.add_to(numbers).drop(*self.features)
        advised = with_message(recommend_rows(explained, self.effects, self.dependencies, self.features), self.messages)
        return advised.select(
            "id",
            "user_id",
            "raw_code",
            "extracted_features",
            F.col("score").alias("prediction_output"),
            F.lit(self.version).alias("model_version"),
            F.col("created_at").cast("timestamp").alias("created_at"),
            "message",
        )
