"""Random forests: fitting, search, out-of-sample predictions, scoring of sources."""

from __future__ import annotations

import math
import random
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.fixed_values import SEARCH_FOLDS, SEARCH_TRIALS, TRANSFORMED_FEATURES
from gradeloom.operators.code_features import transformed_features
from gradeloom.operators.split import with_fold
from gradeloom.operators.vectors import assemble
from gradeloom.session import stage

MAX_DEPTH = 30  # the deepest tree Spark grows


def forest(
    label: str,
    trees: int = 100,
    max_depth: int = MAX_DEPTH,
    min_leaf: int = 1,
    subset: str = "all",
    seed: int = 0,
    weight: str | None = None,
    bins: int = 32,
) -> RandomForestRegressor:
    if not 0 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"trees can be 0 to {MAX_DEPTH} deep, not {max_depth}")
    estimator = RandomForestRegressor(
        featuresCol="features",
        labelCol=label,
        predictionCol="prediction",
        numTrees=trees,
        maxDepth=max_depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy=subset,
        maxBins=bins,
        seed=seed,
    )
    return estimator.setWeightCol(weight) if weight else estimator


def fit_forest(df: DataFrame, features: list[str], label: str, embedding: str | None = None, **params) -> RandomForestRegressionModel:
    """Fit on the given columns; ``weight`` names a sample weight column."""
    return forest(label, **params).fit(assemble(df, features, embedding))


def predict(df: DataFrame, model, features: list[str], embedding: str | None = None) -> DataFrame:
    """Add ``prediction``."""
    return model.transform(assemble(df, features, embedding)).drop("features")


def feature_importance(spark: SparkSession, model, features: list[str], embedding_dim: int = 0) -> DataFrame:
    """(feature, importance), most important first; embedding dimensions are named by their number."""
    names = [str(i) for i in range(embedding_dim)] + list(features)
    rows = list(zip(names, (float(x) for x in model.featureImportances.toArray())))
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(F.desc("importance"), "feature")


def out_of_fold_predictions(
    df: DataFrame, features: list[str], label: str, key: str, folds: int = SEARCH_FOLDS, seed: int = 0, **params
) -> DataFrame:
    """Every row with a prediction by a model that has not seen it."""
    data = stage(with_fold(assemble(df, features), key, folds, seed), "folds")
    parts = []
    for i in range(folds):
        model = forest(label, seed=seed, **params).fit(data.filter(F.col("fold") != i))
        parts.append(model.transform(data.filter(F.col("fold") == i)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.drop("features", "fold")


def _share(key: Column, tree: int, seed: int) -> Column:
    """A number from 0 to 1 that follows from the row's key."""
    return F.xxhash64(key, F.lit(tree), F.lit(seed)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))


def is_drawn(key: Column, tree: int, seed: int = 0) -> Column:
    """Whether ``poisson_weight`` is above zero, by one comparison."""
    return _share(key, tree, seed) >= math.exp(-1)


def poisson_weight(key: Column, tree: int, seed: int = 0) -> Column:
    """How often a bootstrap of mean 1 draws a row for a tree; follows from the row's key alone."""
    share = _share(key, tree, seed)
    upto, limits = 0.0, []
    for k in range(18):  # beyond that no double tells the sum from 1
        upto += math.exp(-1) / math.factorial(k)
        limits.append(upto)
    return reduce(add, [(share >= x).cast("int") for x in limits])


def fit_bagged(
    df: DataFrame, features: list[str], label: str, key: str, trees: int = 100, seed: int = 0, weight: str | None = None,
    embedding: str | None = None, parallelism: int = 4, **params,
) -> list[RandomForestRegressionModel]:
    """One model of one tree for each bootstrap of the rows, whose weights ``poisson_weight`` knows again.

    Rows are drawn by ``key``: rows that share one are drawn together. ``weight`` names a
    sample weight on top.
    """
    # what fitting reads; other columns are not stored
    needed = dict.fromkeys(["features", label, key, *([weight] if weight else [])])
    data = stage(assemble(df, features, embedding).select(*needed), "bagged")

    def fit(tree: int):
        drawn = poisson_weight(F.col(key), tree, seed).cast("double")
        # rows are left out before their number is worked out
        weighted = data.filter(is_drawn(F.col(key), tree, seed)).withColumn("_drawn", drawn * F.col(weight) if weight else drawn)
        weighted = weighted.filter("_drawn > 0") if weight else weighted
        return forest(label, trees=1, seed=seed + tree, weight="_drawn", **params).setBootstrap(False).fit(weighted)

    with ThreadPool(parallelism) as pool:
        return pool.map(fit, range(trees))


def out_of_bag_predictions(
    df: DataFrame, models: list[RandomForestRegressionModel], features: list[str], key: str, seed: int = 0, embedding: str | None = None
) -> DataFrame:
    """Add ``prediction``, the mean of the trees that were fitted without the row, and ``trees``, how many those are.

    A row that every tree has seen has no prediction. One pass; a tree is asked about
    its own rows only.
    """
    rows, votes = assemble(df, features, embedding), []
    for tree, model in enumerate(models):
        rows = model.copy().setPredictionCol(f"_tree{tree}").transform(rows)
        votes.append(F.when(~is_drawn(F.col(key), tree, seed), F.col(f"_tree{tree}")))
    # votes are added up as a list: spelled out for every tree, sums and conditions grow beyond the code that Java compiles
    none = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("n"))
    add_vote = lambda sums, v: F.when(v.isNull(), sums).otherwise(F.struct((sums["total"] + v).alias("total"), (sums["n"] + 1).alias("n")))
    counted = rows.withColumn("_votes", F.aggregate(F.array(*votes), none, add_vote))
    n, total = F.col("_votes.n"), F.col("_votes.total")
    return counted.select(*df.columns, F.when(n > 0, total / n).alias("prediction"), n.alias("trees"))


def draw_trials(trials: int = SEARCH_TRIALS, seed: int = 0) -> list[dict]:
    """Random points of the search space."""
    rng = random.Random(seed)
    # --- fixed values: the search space ---
    return [
        {
            "trees": rng.randint(100, 600),
            "max_depth": rng.randint(3, MAX_DEPTH),
            "min_leaf": rng.randint(1, 10),
            "subset": rng.choice(["sqrt", "log2", "all"]),
        }
        for _ in range(trials)
    ]


def search_forest(
    df: DataFrame,
    features: list[str],
    label: str,
    key: str,
    trials: list[dict] | None = None,
    folds: int = SEARCH_FOLDS,
    seed: int = 0,
    weight: str | None = None,
    parallelism: int = 4,
):
    """Pick the trial with the smallest mean RMSE over shuffled folds and refit it on everything.

    Weights are used for fitting, not for judging. Returns (model, trial table,
    best trial).
    """
    trials = draw_trials(seed=seed) if trials is None else trials
    # what fitting and judging read; other columns are neither stored nor cached for each fold
    needed = dict.fromkeys(["features", label, *([weight] if weight else []), "fold"])
    data = stage(with_fold(assemble(df, features), key, folds, seed).select(*needed), "search")
    estimator = forest(label, seed=seed, weight=weight)
    grid = [
        {
            estimator.numTrees: t["trees"],
            estimator.maxDepth: t["max_depth"],
            estimator.minInstancesPerNode: t["min_leaf"],
            estimator.featureSubsetStrategy: t["subset"],
        }
        for t in trials
    ]
    fitted = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=seed,
    ).fit(data)
    scores = [float(x) for x in fitted.avgMetrics]
    best = trials[scores.index(min(scores))]
    table = df.sparkSession.createDataFrame(
        [(i, t["trees"], t["max_depth"], t["min_leaf"], t["subset"], s) for i, (t, s) in enumerate(zip(trials, scores))],
        "trial INT, trees INT, max_depth INT, min_leaf INT, subset STRING, cv_rmse DOUBLE",
    )
    return fitted.bestModel, table, best


#: Space of the guided search: whole numbers from and to, or choices. Same as of ``draw_trials``.
SPACE = {"trees": (100, 600), "max_depth": (3, MAX_DEPTH), "min_leaf": (1, 10), "subset": ["sqrt", "log2", "all"]}


def propose_trials(seen: list[dict], number: int, seed: int = 0, space: dict = SPACE, warm_up: int = 10, good_share: float = 0.25, tries: int = 24) -> list[dict]:
    """The next trials after those ``seen`` (with their ``cv_rmse``), by the ratio of two densities.

    The best quarter of the trials is one density, the others are the second; of ``tries``
    points drawn from the first, the one where it is highest against the second is taken. Every
    parameter has densities of its own: a mixture of kernels around the trials' values and
    the whole space. Proposals of one round count as seen by the next ones, at the middle of
    the scores, so a round does not propose one point several times. The same trials and seed
    give the same proposals; the first ``warm_up`` trials are drawn from the whole space.
    """
    known, proposed = [dict(t) for t in seen], []

    def drawn(rng, name, near):
        kind = space[name]
        if isinstance(kind, list):
            return rng.choice(kind if not near or rng.random() < 1 / (len(near) + 1) else [t[name] for t in near])
        low, high = kind
        if not near or rng.random() < 1 / (len(near) + 1):
            return rng.randint(low, high)
        return min(high, max(low, round(rng.gauss(rng.choice(near)[name], width(kind, near)))))

    def width(kind, near):
        return max(1.0, (kind[1] - kind[0]) / max(1, len(near)))

    def density(name, value, near):
        kind = space[name]
        if isinstance(kind, list):
            return (sum(t[name] == value for t in near) + 1 / len(kind)) / (len(near) + 1)
        spread, flat = width(kind, near), 1 / (kind[1] - kind[0] + 1)
        kernels = sum(math.exp(-0.5 * ((value - t[name]) / spread) ** 2) for t in near) / (spread * math.sqrt(2 * math.pi))
        return (kernels + flat) / (len(near) + 1)

    for _ in range(number):
        rng = random.Random(f"{seed}:{len(known)}")
        ranked = sorted(known, key=lambda t: t["cv_rmse"])
        cut = max(1, math.ceil(good_share * len(ranked)))
        good, rest = ranked[:cut], ranked[cut:]
        if len(known) < warm_up:
            trial = {name: drawn(rng, name, []) for name in space}
        else:
            points = [{name: drawn(rng, name, good) for name in space} for _ in range(tries)]
            trial = max(points, key=lambda p: sum(math.log(density(n, p[n], good) / density(n, p[n], rest)) for n in space))
        proposed.append(trial)
        known.append(trial | {"cv_rmse": ranked[len(ranked) // 2]["cv_rmse"] if ranked else 0.0})
    return proposed


def guided_search(
    df: DataFrame,
    features: list[str],
    label: str,
    key: str,
    trials: int = SEARCH_TRIALS,
    round_size: int = 5,
    folds: int = SEARCH_FOLDS,
    seed: int = 0,
    weight: str | None = None,
    parallelism: int = 4,
    registry=None,
    study: str | None = None,
    space: dict = SPACE,
):
    """A search that learns from its trials, in rounds of parallel ones; returns as ``search_forest`` does.

    With a registry and the name of a study, every round's trials are stored before the next
    one begins. A search that was stopped goes on behind them, with the trials that it would
    have had without the stop; one that is complete only refits its best trial. A ``space`` of
    one's own has the same parameters.
    """
    schema = "trial INT, trees INT, max_depth INT, min_leaf INT, subset STRING, cv_rmse DOUBLE"
    seen = []
    if registry is not None:
        # as many rows as a study has trials; a round that was stored twice has the same ones
        stored = {r["trial"]: r.asDict() for r in registry.trials_of(study, missing=schema).collect()}
        while len(seen) in stored:
            seen.append(stored[len(seen)])
    # what fitting and judging read; other columns are not stored, and every round reads the one copy
    needed = dict.fromkeys(["features", label, *([weight] if weight else []), "fold"])
    data = stage(with_fold(assemble(df, features), key, folds, seed).select(*needed), "guided")
    # files in the order in which they were written: which rows a bootstrap draws follows from it, also where files have one size
    data = df.sparkSession.read.schema(data.schema).parquet(*sorted(data.inputFiles()))
    while len(seen) < trials:
        # rounds begin at fixed places, so a search that goes on proposes what it would have proposed
        proposals = propose_trials(seen, min(round_size - len(seen) % round_size, trials - len(seen)), seed, space)
        scores = cross_validated(data, label, proposals, folds, seed, weight, parallelism)
        done = [{"trial": len(seen) + i, **t, "cv_rmse": s} for i, (t, s) in enumerate(zip(proposals, scores))]
        if registry is not None:
            registry.log_trials(study, df.sparkSession.createDataFrame([tuple(t[c] for c in ("trial", *SPACE, "cv_rmse")) for t in done], schema))
        seen += done
    best = min(seen, key=lambda t: (t["cv_rmse"], t["trial"]))
    chosen = {name: best[name] for name in SPACE}
    model = forest(label, seed=seed, weight=weight, **chosen).fit(data)
    table = df.sparkSession.createDataFrame([tuple(t[c] for c in ("trial", *SPACE, "cv_rmse")) for t in seen], schema)
    return model, table, chosen


def cross_validated(rows: DataFrame, label: str, trials: list[dict], folds: int, seed: int, weight: str | None, parallelism: int) -> list[float]:
    """Mean RMSE over the folds (column ``fold``) of each trial, on rows with ``features``."""

    def fit(job):
        trial, fold = job
        return forest(label, seed=seed, weight=weight, **trial).fit(rows.filter(F.col("fold") != fold))

    def judge(job):
        """RMSE of each of the fold's models, in one pass over its rows."""
        models, fold = job
        held_out = rows.filter(F.col("fold") == fold)
        for i, model in enumerate(models):
            held_out = model.setPredictionCol(f"_trial{i}").transform(held_out)
        squares = [F.pow(F.col(f"_trial{i}") - F.col(label), 2.0) for i in range(len(models))]
        return held_out.agg(*[F.sqrt(F.avg(x)) for x in squares]).first()

    with ThreadPool(parallelism) as pool:
        models = pool.map(fit, [(t, i) for i in range(folds) for t in trials], 1)
        found = pool.map(judge, [(models[i * len(trials) : (i + 1) * len(trials)], i) for i in range(folds)], 1)
    return [sum(of_fold[i] for of_fold in found) / folds for i in range(len(trials))]


INVALID_SCORE = -1.0


def score_sources(
    df: DataFrame, model, features: list[str] = TRANSFORMED_FEATURES, feature_stage=transformed_features, embedding: str | None = None
) -> DataFrame:
    """Score files: adds ``features`` (map) and ``score``; -1 and no features without valid logic.

    Needs ``text`` and ``facts``. One pass: invalid rows go through the model
    with zeros and are overwritten, so nothing is parsed or read twice.
    """
    featured = feature_stage(df)
    valid = F.col("facts.has_logic")
    mapped = F.map_from_arrays(F.array(*[F.lit(c) for c in features]), F.array(*[F.col(c) for c in features]))
    extra = ["effective_lines"] if "effective_lines" in featured.columns else []
    prepared = featured.select(
        *df.columns,
        *extra,
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in features],
        F.when(valid, mapped).otherwise(F.create_map().cast("map<string,double>")).alias("extracted_features"),
    )
    scored = predict(prepared, model, features, embedding)
    return scored.select(
        *df.columns,
        *extra,
        "extracted_features",
        F.when(valid, F.col("prediction")).otherwise(F.lit(INVALID_SCORE)).alias("score"),
    )
