"""Quality rules: text statistics, and outliers by a minimum covariance determinant.

For each language and source, centre and covariance of the transformed statistics are those
of the part of the documents (``CORE`` of them) with the smallest covariance determinant,
found by concentration steps: measure Mahalanobis distances, keep the closest, estimate
again, until the determinant falls no more. There are two deterministic starts (medians with
quartile ranges, and mean with covariance of all), of which the one with the smaller
determinant counts. Covariances get a floor on the diagonal, since ratios that are zero in nearly every
document have no spread of their own; small groups lean on the estimate of their language.

Everything is built-in aggregation of sums by group. Quantiles come from histograms with
fixed bins, so a group that holds a third of all rows costs partial counts, not a sort.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import SPACES, bind, stage, text_or_empty, whole_row

SYMBOLS = "#*$%&|<>"
GRAM = 8

#: Transformed statistics and the least standard deviation each is given.
STATISTICS = {"word_length": 0.10, "symbols": 0.08, "dup_lines": 0.10, "repeats": 0.08}
DIMENSION = len(STATISTICS)
#: Share of a group that its estimate rests on, and how many documents of its language stand by a group.
CORE, PRIOR = 0.6, 30.0
#: Steps go on while the determinant falls by this share of itself; bins of the distances could make them circle, hence the most.
LEAST_FALL, MOST_STEPS = 0.01, 12
#: Documents beyond this quantile of the chi-square distribution are outliers.
CUTOFF = 0.999999

_PAIRS = [(i, j) for i in range(DIMENSION) for j in range(i + 1)]


def _chi2(x: float, degrees: int) -> float:
    """Distribution function for even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(middle, degrees) < p else (low, middle)
    return high


#: The core of a normal sample spreads less than the sample; this makes up for it.
CONSISTENCY = CORE / _chi2(chi2_quantile(CORE, DIMENSION), DIMENSION + 2)


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``GRAM`` words found twice or more in ``words``."""

    def cover(places):
        reach = F.transform(places, lambda p, k: F.least(F.lit(GRAM), F.coalesce(F.get(places, k + 1) - p, F.lit(GRAM))))
        return F.aggregate(reach, F.lit(0), lambda total, r: total + r)

    def count(grams):
        def places(ranked):
            twin = lambda g, k: (g["gram"] == F.get(ranked, k - 1)["gram"]) | (g["gram"] == F.get(ranked, k + 1)["gram"])
            found = F.transform(ranked, lambda g, k: F.when(F.coalesce(twin(g, k), F.lit(False)), g["place"]))
            return bind(F.array_sort(F.filter(found, lambda p: p.isNotNull())), cover)

        ranked = F.array_sort(F.transform(grams, lambda g, k: F.struct(g.alias("gram"), k.alias("place"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(bind(ranked, places))

    def grams(hashes):
        starts = F.sequence(F.lit(0), F.size(hashes) - GRAM)
        return bind(F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(GRAM)])), count)

    return F.when(F.size(words) < GRAM, 0).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), grams))


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts of whole texts: words, their code points, symbols, repeated lines and repeated windows of words.

    A null text has no words. Columns ``carry`` go along.
    """
    blank = "".join(chr(c) for c in (0x20, *range(0x09, 0x0E)))
    text = text_or_empty(text_column)
    first = docs.select(
        F.col(f"`{id_column}`"),
        *[F.col(f"`{c}`") for c in carry],
        F.array_remove(F.split(text, SPACES), "").alias("words"),
        F.char_length(F.translate(text, blank, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: F.translate(line, blank, "") != "").alias("lines"),
    )
    return first.select(
        F.col(f"`{id_column}`"),
        *[F.col(f"`{c}`") for c in carry],
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def base_failed(least_words: int = 20, most_repeats: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def vector() -> Column:
    """Statistics on scales on which clean documents lie close together."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return F.array(
        F.log(F.greatest(F.col("word_chars") / words, F.lit(1.0))),
        F.sqrt(F.col("n_symbols") / words),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        F.col("n_repeat_words") / words,
    )


def distance(x: Column, mean: Column, lower: Column) -> Column:
    """Squared Mahalanobis distance, by forward substitution with the Cholesky factor."""
    solved: list[Column] = []
    for i in range(DIMENSION):
        rest = x[i] - mean[i]
        for k in range(i):
            rest = rest - lower[_PAIRS.index((i, k))] * solved[k]
        solved.append(rest / lower[_PAIRS.index((i, i))])
    return sum((s * s for s in solved[1:]), solved[0] * solved[0])


def _with_factor(estimates: DataFrame) -> DataFrame:
    """Add the Cholesky factor of ``cov`` (an array by pairs), one row of it at a time."""
    step = estimates
    names = {}
    for i in range(DIMENSION):
        cov = {(a, b): F.col("cov")[_PAIRS.index((a, b))] for a, b in _PAIRS}
        row = {}
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - row.get((i, k), names.get((i, k))) * (row.get((j, k)) if j == i else names[j, k])
            row[i, j] = F.sqrt(rest) if i == j else rest / names[j, j]
        step = step.withColumns({f"l_{i}_{j}": value for (_, j), value in row.items()})
        names |= {(i, j): F.col(f"l_{i}_{j}") for j in range(i + 1)}
    factor = F.array(*[names[p] for p in _PAIRS])
    return step.withColumn("lower", factor).drop(*[f"l_{i}_{j}" for i, j in _PAIRS])


def _quantiles(counts: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Upper ends of the bins in which the shares of a histogram are reached."""
    run = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(whole)})
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))).alias(name) for name, share in shares.items()])


def _moments(rows: DataFrame, keys: list[str], scale: float, *carried: Column) -> DataFrame:
    """``mean``, ``cov`` (by pairs, times ``scale``, floored) and ``n_core`` of the rows of every key."""
    sums = rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"),
        *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(DIMENSION)],
        *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in _PAIRS],
        *carried,
    )
    n, floors = F.col("n"), list(STATISTICS.values())
    shared = {(i, j): F.col(f"p{i}_{j}") / n - F.col(f"s{i}") * F.col(f"s{j}") / n / n for i, j in _PAIRS}
    cov = [scale * F.greatest(F.lit(0.0), shared[p]) + floors[p[0]] ** 2 if p[0] == p[1] else scale * shared[p] for p in _PAIRS]
    others = [c for c in sums.columns[1 + len(keys) + DIMENSION + len(_PAIRS) :]]
    return sums.select(*keys, F.array(*[F.col(f"s{i}") / n for i in range(DIMENSION)]).alias("mean"), F.array(*cov).alias("cov"), n.alias("n_core"), *others)


def _by_quartiles(vectors: DataFrame, group: str) -> DataFrame:
    """A start for every group: medians, and quartile ranges on the diagonal."""
    grid = 200.0  # bins of 0.005
    coordinates = vectors.select(group, F.posexplode("x").alias("at", "value"))
    counts = coordinates.groupBy(group, "at", F.floor(F.col("value") * grid).alias("bin")).agg(F.count("*").alias("n"))
    spread = _quantiles(counts, [group, "at"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    floors = F.array(*[F.lit(s) for s in STATISTICS.values()])
    begin = spread.groupBy(group).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", ((F.col("q2") + 0.5) / grid).alias("middle"), ((F.col("q3") - F.col("q1")) / grid / 1.349).alias("wide")))),
            lambda s: F.struct(s["middle"].alias("middle"), F.greatest(s["wide"], F.get(floors, s["at"])).alias("wide")),
        ).alias("s")
    )
    return begin.select(
        group,
        F.transform("s", lambda s: s["middle"]).alias("mean"),
        F.array(*[F.pow(F.col("s")[i]["wide"], 2) if i == j else F.lit(0.0) for i, j in _PAIRS]).alias("cov"),
        F.lit(0.0).alias("n_core"),
    )


def estimate(vectors: DataFrame, group: str = "group") -> DataFrame:
    """``mean``, ``cov`` (floored, by pairs) and ``n_core`` of every group of ``vectors`` (columns group and x).

    Groups of any size work: a single document is its own centre with the floor as spread.
    Each group stops by itself, so its estimate does not depend on which others there are.
    """
    keys, fine = [group, "start"], 64.0  # bins per factor e of the squared distance
    starts = _by_quartiles(vectors, group).withColumn("start", F.lit(0)).unionByName(_moments(vectors, [group], 1.0).withColumn("start", F.lit(1)))
    params = starts.withColumn("before", F.lit(None).cast("double"))
    done = []
    for step in range(MOST_STEPS + 1):
        det = reduce(mul, [F.pow(F.col("lower")[_PAIRS.index((i, i))], 2) for i in range(DIMENSION)])
        falling = F.col("before").isNull() | (F.col("det") < F.col("before") * (1 - LEAST_FALL))
        params = stage(_with_factor(params).withColumn("det", det).withColumn("falling", falling & F.lit(step < MOST_STEPS)), f"mcd-params-{step}")
        done.append(params.filter("NOT falling").select(*keys, "mean", "cov", "n_core", "det"))
        params = params.filter("falling")
        if params.limit(1).count() == 0:
            break
        far = vectors.join(params.select(*keys, "mean", "lower", "det"), group)
        far = far.select(*keys, "x", "det", F.floor(F.log(distance(F.col("x"), F.col("mean"), F.col("lower")) + 1e-9) * fine).alias("bin"))
        close = _quantiles(far.groupBy(*keys, "bin").agg(F.count("*").alias("n")), keys, {"most": CORE})
        core = far.join(stage(close, f"mcd-core-{step}"), keys).filter("bin <= most")
        params = _moments(core, keys, CONSISTENCY, F.first("det").alias("before"))
    best = F.min_by(F.struct("mean", "cov", "n_core"), F.struct("det", "start")).alias("best")
    return reduce(DataFrame.union, done).groupBy(group).agg(best).select(group, "best.*")


def judge(statistics: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Add ``base_failed``, ``distance`` (null for base failures) and ``kept`` to :func:`text_statistics`.

    Documents that fail the base rules take no part in the estimates. Null languages and
    sources are groups of their own. An empty table gives no rows.
    """
    # a hash passes over nulls, so whether there is a value is hashed too
    name = lambda c: [F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))]
    marked = statistics.withColumns({"base_failed": base_failed(), "x": vector(), "of_lang": F.xxhash64(*name("lang")), "group": F.xxhash64(*name("lang"), *name("source"))})
    live = marked.filter(~F.col("base_failed"))
    # one run for the groups and for the languages, told apart by the sign bit of their hashes
    both = live.select(F.explode(F.array(F.shiftleft(F.col("of_lang"), 1), F.shiftleft(F.col("group"), 1) + 1)).alias("group"), "x")
    found = stage(estimate(both), "mcd")
    languages = found.select(F.col("group").alias("lang_key"), F.col("mean").alias("lang_mean"), F.col("cov").alias("lang_cov"))
    keys = live.select(F.shiftleft(F.col("of_lang"), 1).alias("lang_key"), (F.shiftleft(F.col("group"), 1) + 1).alias("group")).distinct()
    n = F.col("n_core")
    lean = lambda own, other: F.zip_with(own, other, lambda a, b: (n * a + PRIOR * b) / (n + PRIOR))
    params = _with_factor(
        found.join(keys, "group").join(languages, "lang_key").select("group", lean(F.col("mean"), F.col("lang_mean")).alias("mean"), lean(F.col("cov"), F.col("lang_cov")).alias("cov"))
    ).select("group", "mean", "lower")
    limit = chi2_quantile(cutoff, DIMENSION)
    rated = marked.withColumn("group", F.shiftleft(F.col("group"), 1) + 1).join(stage(params, "mcd-final"), "group", "left")
    away = F.when(~F.col("base_failed"), F.round(distance(F.col("x"), F.col("mean"), F.col("lower")), 6))
    return rated.withColumn("distance", away).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).drop("x", "of_lang", "group", "mean", "lower")


def judged_documents(docs: DataFrame, id_column: str = "doc_id", cutoff: float = CUTOFF) -> DataFrame:
    """One row for each row of ``docs``: its statistics, ``base_failed`` and ``kept``."""
    return judge(stage(text_statistics(docs, id_column), "text-statistics"), cutoff)


def kept_documents(docs: DataFrame, id_column: str = "doc_id", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Rows are written with their statistics once and judged from there, so that no text is
    measured or shuffled a second time.
    """
    own = docs.select(whole_row(docs).alias("doc"), F.col(f"`{id_column}`").alias("doc_id"), "lang", "source", "text")
    measured = stage(text_statistics(own, "doc_id", carry=("doc", "lang", "source")), "measured")
    return judge(measured, cutoff).filter("kept").select("doc.*")
