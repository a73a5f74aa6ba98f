"""Token windows, embeddings, clustering and similar vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from gradeloom.fixed_values import SPECIAL_TOKENS, WINDOW_OVERLAP, WINDOW_TOKENS
from gradeloom.operators.ordered import null_safe, with_rank
from gradeloom.session import stage


# --- windows and encoding ------------------------------------------------------


def whitespace_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^ \t\n\r]+"), F.lit(0))


def token_windows(
    df: DataFrame,
    text: str = "text",
    tokenize: Callable[[Column], Column] = whitespace_tokens,
    window: int = WINDOW_TOKENS,
    overlap: int = WINDOW_OVERLAP,
    special: int = SPECIAL_TOKENS,
) -> DataFrame:
    """One row per window of a text: ``chunk`` (from 0) and ``tokens``.

    A window holds ``window - special`` tokens and repeats the last ``overlap``
    tokens of the one before. The whole text is covered; an empty one gives one
    empty window.
    """
    content = window - special
    step = content - overlap
    tokens = F.col("_tokens")
    count = F.greatest(F.ceil((F.size(tokens) - content) / step) + 1, F.lit(1)).cast("int")
    # there is always a window; the outer form keeps the optimizer from adding a
    # filter on it below, which would tokenize every text again per window
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(tokens, i * step + 1, F.lit(content)))
    kept = [c for c in df.columns if c != text]
    return (
        df.withColumn("_tokens", tokenize(F.col(text)))
        .withColumn("_windows", windows)
        .select(*kept, F.posexplode_outer("_windows").alias("chunk", "tokens"))
    )


def encode(df: DataFrame, make_encoder: Callable[[], Callable], column: str, name: str = "embedding", batch_size: int = 64) -> DataFrame:
    """Add a vector per row from a user's encoder.

    ``make_encoder`` runs once per Python worker and returns a function from a
    NumPy batch of strings to a 2-D array.
    """
    udf = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return df.withColumn(name, udf(F.col(column)))


def mean_pool(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Unweighted mean of the vectors of each key. Sums are combined before the shuffle."""
    return (
        df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
        .groupBy(key)
        .agg(Summarizer.mean(F.col("v")).alias("v"))
        .select(key, vector_to_array("v").alias(vector))
    )


def embed_texts(df: DataFrame, key: str, make_encoder: Callable[[], Callable], text: str = "text", **windows) -> DataFrame:
    """Text to one vector per key: windows, encoder, mean of the windows."""
    chunks = token_windows(df.select(key, text), text, **windows).withColumn("_chunk_text", F.array_join("tokens", " "))
    return mean_pool(encode(chunks, make_encoder, "_chunk_text"), key)


def assemble(df: DataFrame, features: list[str], embedding: str | None = None, name: str = "features") -> DataFrame:
    """Feature vector for Spark ML: the embedding first, then the features in order."""
    inputs = list(features)
    if embedding:
        df = df.withColumn("_embedding", array_to_vector(F.col(embedding).cast("array<double>")))
        inputs = ["_embedding", *inputs]
    return VectorAssembler(inputCols=inputs, outputCol=name).transform(df).drop("_embedding")


# --- clustering ------------------------------------------------------------------


def _as_vector(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_vector", array_to_vector(F.col(vector).cast("array<double>")))


def kmeans(df: DataFrame, k: int, vector: str = "embedding", seed: int = 0, name: str = "cluster") -> DataFrame:
    data = _as_vector(df, vector)
    model = KMeans(k=k, seed=seed, featuresCol="_vector", predictionCol=name).fit(data)
    return model.transform(data).drop("_vector")


def kmeans_sweep(df: DataFrame, max_k: int, vector: str = "embedding", seed: int = 0) -> DataFrame:
    """(k, silhouette) for k = 2..max_k: Euclidean clustering, mean cosine silhouette."""
    data = stage(_as_vector(df, vector).select("_vector"), "kmeans")
    evaluator = ClusteringEvaluator(featuresCol="_vector", predictionCol="cluster", distanceMeasure="cosine")
    rows = []
    for k in range(2, max_k + 1):
        model = KMeans(k=k, seed=seed, featuresCol="_vector", predictionCol="cluster").fit(data)
        rows.append((k, evaluator.evaluate(model.transform(data))))
    return df.sparkSession.createDataFrame(rows, "k INT, silhouette DOUBLE")


def unit_vectors(df: DataFrame, vector: str, name: str = "_unit") -> DataFrame:
    """Add the vector at length 1; an all-zero vector stays zero."""
    scaled = Normalizer(inputCol="_vector", outputCol="_normed", p=2.0).transform(_as_vector(df, vector))
    return scaled.withColumn(name, vector_to_array("_normed")).drop("_vector", "_normed")


def _matrix(values: pa.Array) -> np.ndarray:
    """A list column as a 2-D array, without a Python loop."""
    width = len(values[0]) if len(values) else 0
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), width)


def _cluster_distances(block):
    """Arrow function: (mean distance to the own cluster, smallest to any other) among the clusters of a broadcast (labels, sizes, sums)."""
    result = pa.struct([("own", pa.float64()), ("other", pa.float64())])

    @arrow_udf("STRUCT<own: DOUBLE, other: DOUBLE>")
    def distances(units: pa.Array, own_labels: pa.Array) -> pa.Array:
        if not len(units):
            return pa.array([], type=result)
        labels, sizes, sums = block.value
        position = pd.Index(labels)
        total = sizes - _matrix(units) @ sums.T
        rows = np.arange(len(total))
        at = position.get_indexer(pd.Index(own_labels.to_pandas()))
        here = at >= 0
        own = np.full(len(total), np.nan)
        own[here] = total[rows[here], at[here]] / np.maximum(sizes[at[here]] - 1, 1)
        own[here] = np.where(sizes[at[here]] > 1, own[here], -1.0)
        mean = total / sizes
        mean[rows[here], at[here]] = np.inf
        return pa.StructArray.from_arrays([pa.array(own, from_pandas=True), pa.array(mean.min(axis=1))], fields=list(result))

    return distances


def silhouettes(
    df: DataFrame, label: str, vector: str = "embedding", name: str = "silhouette", numbers_per_block: int = 4_000_000
) -> DataFrame:
    """Cosine silhouette of every row, from one sum of unit vectors per cluster.

    The cost is rows times clusters, not rows squared. Cluster sums are cut by a hash into
    blocks of about a fixed size and broadcast one after the other; functions carry a
    block's handle only, so any number of clusters works.
    """
    units = unit_vectors(df, vector)
    sums = stage(
        units.groupBy(label).agg(
            F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(array_to_vector("_unit"))).alias("s")
        ),
        "cluster-sums",
    )
    shape = sums.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("s")).alias("dim")).first()
    blocks = math.ceil(shape["k"] * (shape["dim"] or 1) / numbers_per_block)
    in_block = F.pmod(F.xxhash64(label), F.lit(max(blocks, 1)))
    found = []
    for i in range(blocks):
        rows = sums.filter(in_block == i).toArrow()
        if not rows.num_rows:
            continue
        block = (rows[label].to_pylist(), rows["n"].to_numpy().astype(float), _matrix(rows["s"].combine_chunks()))
        units = units.withColumn(f"_d{i}", _cluster_distances(df.sparkSession.sparkContext.broadcast(block))("_unit", label))
        found.append(f"_d{i}")
    own = F.coalesce(*[F.col(f"{c}.own") for c in found])
    other = F.array_min(F.array(*[F.col(f"{c}.other") for c in found]))
    longest = F.greatest("_own", "_other")
    return (
        units.withColumns({"_own": own, "_other": other})
        .withColumn(
            name,
            F.when(F.col("_own") < 0, F.lit(0.0))
            .when(F.col("_other") == float("inf"), F.lit(None))
            .otherwise(F.coalesce((F.col("_other") - F.col("_own")) / F.when(longest != 0, longest), F.lit(0.0))),
        )
        .drop("_unit", "_own", "_other", *found)
    )


def silhouette_profile(df: DataFrame, label: str, key: str, silhouette: str = "silhouette") -> DataFrame:
    """Silhouettes in ascending order within each cluster, with the cluster's size."""
    # written, so that its real size decides between a broadcast and a shuffle on few keys
    sizes = stage(df.groupBy(label).agg(F.count(F.lit(1)).alias("cluster_size")), "cluster-sizes")
    ranked = with_rank(df.select(key, label, silhouette), [label], [silhouette, key], "position")
    return null_safe(ranked, sizes, [label])


def project_2d(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Two principal components as ``x`` and ``y``."""
    data = _as_vector(df, vector)
    model = PCA(k=2, inputCol="_vector", outputCol="_xy").fit(data)
    xy = vector_to_array("_xy")
    return model.transform(data).withColumns({"x": xy[0], "y": xy[1]}).drop("_vector", "_xy")


# --- similar vectors ----------------------------------------------------------------


def vector_groups(df: DataFrame, key: str, vector: str, score: str) -> DataFrame:
    """Exact copies of a vector as one row: smallest key, number of copies, score range.

    ``df`` joined to this on the vector gives the members of each group.
    """
    return df.groupBy(vector).agg(
        F.min(key).alias("id"),
        F.count(F.lit(1)).alias("copies"),
        F.min(score).cast("double").alias("lo"),
        F.max(score).cast("double").alias("hi"),
    )


#: Leading components in which cells are told apart and bounded.
HEAD = 16
_PAIRS = "a BIGINT, b BIGINT, cosine DOUBLE, gap DOUBLE"
#: Vectors travel in blocks of neighbouring cells: so many of these where cells allow it, and more only where one would have more rows than this.
BLOCKS, MOST_ROWS = 16, 32768
#: Cosines that are held at once.
TABLE_NUMBERS = 4_000_000
#: Where every row counts: copies of a vector that travel in one row, copies that weigh as much as a vector, pairs of rows that are made at once.
MOST_COPIES, COPIES_A_ROW, MOST_PAIRS = 256, 32, 200_000


def _rotated(groups: DataFrame, dims: int) -> DataFrame:
    """Add ``head``, the vector in its leading components, and ``rest``, the length of what is left."""
    model = PCA(k=dims, inputCol="_vector", outputCol="_head").fit(_as_vector(groups, "_unit"))
    turn = model.pc.toArray()
    result = pa.struct([("head", pa.list_(pa.float64())), ("rest", pa.float64())])

    @arrow_udf("STRUCT<head: ARRAY<DOUBLE>, rest: DOUBLE>")
    def rotate(units: pa.Array) -> pa.Array:
        if not len(units):
            return pa.array([], type=result)
        x = _matrix(units)
        head = x @ turn
        rest = np.sqrt(np.maximum((x**2).sum(1) - (head**2).sum(1), 0.0))
        ends = pa.array(np.arange(0, head.size + 1, dims, dtype=np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(head.ravel())), pa.array(rest)], fields=list(result))

    return groups.withColumn("_turned", rotate("_unit")).select(*groups.columns, "_turned.*")


def _with_cell(placed: DataFrame, levels: int) -> DataFrame:
    """Add ``cell``: one bit for each of the first components, whether it is above its median."""
    if not levels:
        return placed.withColumn("cell", F.lit(0).cast("bigint"))
    medians = placed.agg(*[F.percentile_approx(F.col("head")[k], 0.5).alias(str(k)) for k in range(levels)]).first()
    bits = [F.when(F.col("head")[k] > medians[k], 1 << (levels - 1 - k)).otherwise(0) for k in range(levels)]
    return placed.withColumn("cell", sum(bits, F.lit(0)).cast("bigint"))


def _reachable_cells(placed: DataFrame, levels: int, dims: int, min_cosine: float) -> DataFrame:
    """Pairs of cells (a <= b, with their rows) whose vectors can reach the cosine, found from the top of a tree of cells down.

    A cell is bounded by a box of its heads and its longest rest. Two boxes cannot hold vectors
    with a larger product than the sum of the largest products of their sides plus that of the
    rests. A pair of cells is looked at only if the pair of cells around them can reach it.
    """
    lo = lambda c: [F.min(F.col(c)[k]) for k in range(dims)]
    hi = lambda c: [F.max(F.col(c)[k]) for k in range(dims)]
    cells = [placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("rest").alias("rest"), F.array(*lo("head")).alias("lo"), F.array(*hi("head")).alias("hi"))]
    cells[0] = stage(cells[0], "cells")
    for _ in range(levels):
        above = cells[0].withColumn("cell", F.shiftright("cell", 1)).groupBy("cell")
        cells.insert(0, stage(above.agg(F.sum("n").alias("n"), F.max("rest").alias("rest"), F.array(*lo("lo")).alias("lo"), F.array(*hi("hi")).alias("hi")), "cells"))
    pairs = cells[0].select(F.col("cell").alias("a"), F.col("cell").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    for level in cells[1:]:
        one, other = (level.select(F.col("cell").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "rest", "lo", "hi")]) for x in "ab")
        halves = lambda x: F.explode(F.array(F.col(x) * 2, F.col(x) * 2 + 1)).alias(x)
        split = pairs.select(halves("a"), "b").select("a", halves("b"))
        corners = [F.greatest(*[F.col(f"{x}_a")[k] * F.col(f"{y}_b")[k] for x in ("lo", "hi") for y in ("lo", "hi")]) for k in range(dims)]
        bound = sum(corners, F.col("rest_a") * F.col("rest_b"))
        pairs = stage(split.filter("a <= b").join(one, "a").join(other, "b").filter(bound >= min_cosine - 1e-9).select("a", "b", "n_a", "n_b"), "cell-pairs")
    return pairs


def _compare_block(min_cosine: float, min_gap: float):
    """Function over two blocks; the left one also has a row for each pair of cells to compare (``cell`` and ``other``, which is -1 for vectors)."""

    def cells_of(rows: pd.DataFrame) -> dict:
        rows = rows.sort_values("cell", kind="stable")
        cells, first = np.unique(rows["cell"].to_numpy(), return_index=True)
        columns = [np.stack(rows["unit"]), *[rows[c].to_numpy() for c in ("id", "lo", "hi")]]
        return dict(zip(cells.tolist(), zip(*[np.split(c, first[1:]) for c in columns])))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        met, left = left[left["other"] >= 0], left[left["other"] < 0]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
        if len(met) and len(left) and len(right):
            one, two = cells_of(left), cells_of(right)
            for a, b in met[["cell", "other"]].itertuples(index=False):
                if a not in one or b not in two:
                    continue
                (x, id_x, lo_x, hi_x), (y, id_y, lo_y, hi_y) = one[a], two[b]
                step = max(1, TABLE_NUMBERS // len(y))
                for at in range(0, len(x), step):
                    cosine = x[at : at + step] @ y.T
                    m, n = np.nonzero(cosine >= min_cosine)
                    c, m = cosine[m, n], m + at
                    gap = np.maximum(np.abs(hi_x[m] - lo_y[n]), np.abs(hi_y[n] - lo_x[m]))
                    near = gap >= min_gap
                    if a == b:  # a cell with itself shows each pair twice
                        near &= id_x[m] < id_y[n]
                    m, n = id_x[m[near]], id_y[n[near]]
                    found.append((np.minimum(m, n), np.maximum(m, n), c[near], gap[near]))
        return pd.DataFrame(dict(zip(("a", "b", "cosine", "gap"), map(np.concatenate, zip(*found)))))

    return compare


def _vector_copies(df: DataFrame, key: str, vector: str, score: str) -> DataFrame:
    """Rows by their vector, ``MOST_COPIES`` or a few more in one row: their ``keys`` and ``scores``, the range of these, and a number (``id``)."""
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(score).cast("double").alias("score"), F.col(vector).alias("vector")).dropna()
    crowds = rows.groupBy("vector").agg(F.ceil(F.count(F.lit(1)) / MOST_COPIES).alias("parts")).filter("parts > 1")
    crowds = stage(crowds, "crowds")  # no more than the rows / MOST_COPIES, and written so that their real size decides on the join
    # dealt out in turn, so that copies which share a key do not stay together; written before it is read again, as such numbers have to be
    dealt = rows.withColumn("turn", F.monotonically_increasing_id()).join(crowds, "vector", "left")
    part = F.coalesce(F.pmod(F.xxhash64("turn"), F.col("parts")), F.lit(0).cast("bigint"))
    copies = dealt.groupBy("vector", part.alias("part")).agg(F.collect_list(F.struct("key", "score")).alias("c"))
    ranges = [F.array_min("c.score").alias("lo"), F.array_max("c.score").alias("hi")]
    return copies.select(
        F.monotonically_increasing_id().alias("id"), *ranges, F.col("vector").alias(vector), F.col("c.key").alias("keys"), F.col("c.score").alias("scores")
    )


class _Block:
    """Vectors with their copies as arrays, in the order of their cells."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("cell").combine_chunks()
        column = lambda name: rows[name].to_numpy()
        list_of = lambda name: rows[name].combine_chunks()
        self.units, self.ids, self.lo, self.hi = _matrix(list_of("unit")), column("id"), column("lo"), column("hi")
        self.keys, self.scores = (list_of(c).flatten().to_numpy(zero_copy_only=False) for c in ("keys", "scores"))
        self.copies = list_of("keys").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.copies) - self.copies
        cells, starts = np.unique(column("cell"), return_index=True)
        self.cells = dict(zip(cells.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(rows)])))


def _compare_copies(min_cosine: float, min_gap: float):
    """As ``_compare_block``, over the rows of both blocks (``side`` 0 and 1); gives every pair of rows, not of vectors, a bounded number at a time."""
    names = ["a", "b", "cosine", "gap"]

    def near_vectors(one: _Block, two: _Block, a: int, b: int) -> Iterator[tuple]:
        """(row of one, row of two, cosine) of vectors with copies that can be pairs."""
        (start_x, end_x), (start_y, end_y) = one.cells[a], two.cells[b]
        step = max(1, TABLE_NUMBERS // (end_y - start_y))
        for at in range(start_x, end_x, step):
            cosine = one.units[at : min(at + step, end_x)] @ two.units[start_y:end_y].T
            m, n = np.nonzero(cosine >= min(min_cosine, 1 - 1e-9))
            c, m, n = cosine[m, n], m + at, n + start_y
            alike = np.flatnonzero(c >= 1 - 1e-9)  # copies have a cosine of exactly one
            c[alike] = np.where((one.units[m[alike]] == two.units[n[alike]]).all(1), 1.0, c[alike])
            kept = (c >= min_cosine) & (np.maximum(np.abs(one.hi[m] - two.lo[n]), np.abs(two.hi[n] - one.lo[m])) >= min_gap)
            if a == b:  # a cell with itself shows each pair twice
                kept &= one.ids[m] <= two.ids[n]
            yield m[kept], n[kept], c[kept]

    def pairs_of_rows(one: _Block, two: _Block, m: np.ndarray, n: np.ndarray, c: np.ndarray) -> Iterator[tuple]:
        of_pair = one.copies[m] * two.copies[n]
        for run in np.split(np.arange(len(m)), np.flatnonzero(np.diff(np.cumsum(of_pair) // MOST_PAIRS)) + 1):
            size = of_pair[run]
            at = np.repeat(run, size)
            place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            x, y = one.first[m[at]] + place // two.copies[n[at]], two.first[n[at]] + place % two.copies[n[at]]
            (i, j), gap = (one.keys[x], two.keys[y]), np.abs(one.scores[x] - two.scores[y])
            # copies in one row meet each other twice
            kept = (gap >= min_gap) & np.where(one.ids[m[at]] == two.ids[n[at]], i < j, i != j)
            yield np.minimum(i, j)[kept], np.maximum(i, j)[kept], c[at][kept], gap[kept]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        met = rows.filter(pc.field("other") >= 0)
        one, two = (rows.filter((pc.field("other") < 0) & (pc.field("side") == x)) for x in (0, 1))
        if not (len(met) and len(one) and len(two)):
            return
        one, two, held, n_held = _Block(one), _Block(two), [], 0
        for a, b in zip(met["cell"].to_pylist(), met["other"].to_pylist()):
            if a not in one.cells or b not in two.cells:
                continue
            for near in near_vectors(one, two, a, b):
                for found in pairs_of_rows(one, two, *near):
                    held.append(found)
                    n_held += len(found[0])
                    if n_held >= MOST_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)
                        held, n_held = [], 0
        if n_held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)

    return compare


def _pairs_in_rows(copies: DataFrame, min_cosine: float, min_gap: float) -> DataFrame:
    """Pairs among the copies of each row."""
    each = lambda name: F.explode(F.arrays_zip("keys", "scores")).alias(name)
    pairs = copies.select("*", each("x")).select("*", each("y"))
    cosine = F.when(F.exists("_unit", lambda v: v != 0), 1.0).otherwise(0.0)
    found = pairs.select(F.col("x.keys").alias("a"), F.col("y.keys").alias("b"), cosine.alias("cosine"), F.abs(F.col("x.scores") - F.col("y.scores")).alias("gap"))
    return found.filter((F.col("a") < F.col("b")) & (F.col("cosine") >= min_cosine) & (F.col("gap") >= min_gap))


def _own_pairs(groups: DataFrame, min_gap: float) -> DataFrame:
    """A vector whose copies differ in score is paired with itself."""
    return groups.filter(F.col("hi") - F.col("lo") >= min_gap).select(
        F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"), (F.col("hi") - F.col("lo")).alias("gap")
    )


def close_pairs(
    df: DataFrame,
    key: str,
    vector: str,
    score: str,
    min_cosine: float,
    min_gap: float,
    cells: int | None = None,
    block_rows: int = 2000,
    most_rows: int = MOST_ROWS,
    every_copy: bool = False,
) -> DataFrame:
    """(a, b, cosine, gap): distinct vectors that are alike while their scores differ.

    Exact. Copies of a vector count as one (see ``vector_groups``), so a vector
    repeated many times costs one row; where its own copies differ in score it is
    paired with itself. With ``every_copy`` all rows count: every two of them with keys
    a < b, a cosine and a gap that reach the least ones are a row, copies of one vector
    among them; those are still compared once, and only what is returned grows with the
    square of their number. Rows without a key, vector or score are in no pair then.
    Vectors are turned into their principal components and cut
    into cells of about ``block_rows`` at the medians of the leading ones; only
    pairs of cells whose bounds reach the cosine are compared. Vectors travel in
    blocks of neighbouring cells, ``most_rows`` at most on each side: to ``BLOCKS``
    others, and to more only beyond ``BLOCKS * most_rows`` vectors. How much that saves depends on how much of the
    vectors lies in their leading components: without any structure and at a low
    cosine every pair of cells can reach it, and the work grows with the square.
    ``similar_pairs`` does not, and misses a stated share.
    """
    members = ["keys", "scores"] if every_copy else []
    groups = unit_vectors((_vector_copies if every_copy else vector_groups)(df, key, vector, score), vector)
    groups = stage(groups.select("id", "lo", "hi", "_unit", *members), "vector-groups")
    shape = groups.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_unit")).alias("dim")).first()
    if shape["n"] < 2 and every_copy:
        return _pairs_in_rows(groups, min_cosine, min_gap)
    if shape["n"] < 2:
        return _own_pairs(groups, min_gap).select(*[F.col(c).cast(t) for c, t in (("a", "bigint"), ("b", "bigint"), ("cosine", "double"), ("gap", "double"))])
    dims = min(HEAD, shape["dim"])
    levels = min(dims, max(0, math.ceil(math.log2((cells or shape["n"] / block_rows)))))
    placed = stage(_with_cell(stage(_rotated(groups, dims), "rotated"), levels), "placed")
    pairs = _reachable_cells(placed, levels, dims, min_cosine)
    # a vector goes once to each block in which some cell can reach its own, however many cells that has
    up = levels - min(levels, math.ceil(math.log2(max(1, shape["n"] / most_rows, min(BLOCKS, shape["n"] / block_rows)))))
    block_of = lambda c: F.shiftright(c, up)
    weight = 1 + (F.size("keys") - 1) / COPIES_A_ROW if every_copy else F.lit(1)
    sizes = stage(placed.groupBy(block_of("cell").alias("block")).agg(F.ceil(F.sum(weight) / most_rows).alias("pieces")), "blocks")
    blocks = pairs.select("a", "b", block_of("a").alias("block_a"), block_of("b").alias("block_b"))
    for x in "ab":
        blocks = blocks.join(sizes.select(F.col("block").alias(f"block_{x}"), F.col("pieces").alias(f"n_{x}")), f"block_{x}")
    blocks = stage(blocks, "block-pairs")
    piece = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    def side(own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        wanted = blocks.select(F.col(own).alias("cell"), "block_a", "block_b", "n_a", "n_b").distinct()
        return placed.join(wanted, "cell").select(
            # new columns on each side: both come from one table
            *[F.col(c).alias(n) for c, n in (*((c, c) for c in ("block_a", "block_b", "cell", "id", "lo", "hi", *members)), ("_unit", "unit"))], F.lit(-1).cast("bigint").alias("other"),
            F.pmod(piece, F.col(f"n_{own}")).alias(own_name), every(f"n_{other}").alias(other_name),
        )

    no = lambda kind, name: F.lit(0).cast(kind).alias(name)
    met = blocks.select("block_a", "block_b", F.col("a").alias("cell"), F.col("b").alias("other"), every("n_a").alias("i"), "n_b").select(
        "*", no("bigint", "id"), no("double", "lo"), no("double", "hi"), F.array().cast("array<double>").alias("unit"), every("n_b").alias("j")
    )
    block = ["block_a", "block_b", "i", "j"]
    if every_copy:
        met = met.withColumns({"keys": F.array().cast("array<bigint>"), "scores": F.array().cast("array<double>")})
    left = side("a", "b", "i", "j").unionByName(met.drop("n_b"))
    if every_copy:
        both = left.withColumn("side", F.lit(0)).unionByName(side("b", "a", "j", "i").withColumn("side", F.lit(1)))
        return both.groupBy(*block).applyInArrow(_compare_copies(min_cosine, min_gap), _PAIRS)
    across = left.groupBy(*block).cogroup(side("b", "a", "j", "i").groupBy(*block)).applyInPandas(_compare_block(min_cosine, min_gap), _PAIRS)
    return across.unionByName(_own_pairs(groups, min_gap))


# --- similar vectors by random projections ----------------------------------------------

#: Random vectors that share a bucket, on average; bits of the sketch that a pair is estimated by, and how far below (standard deviations) it is given up.
BUCKET_ROWS, SKETCH_BITS, SKETCH_SIGMAS = 16, 512, 4.0


def bands_for(n: int, min_cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a band and number of bands for ``n`` vectors.

    Two vectors at an angle a agree in the sign of a random projection with a probability of
    1 - a / pi. A band has enough bits to keep buckets of strangers small at any ``n``; there
    are enough bands for a pair at ``min_cosine`` to share one with a probability of ``recall``.
    """
    bits = min(62, max(1, math.ceil(math.log2(max(n, 2) / BUCKET_ROWS))))
    agree = 1 - math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi
    share = agree**bits
    return bits, 1 if share >= recall else math.ceil(math.log1p(-recall) / math.log1p(-share))


def _buckets(groups: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """``groups`` with ``bucket``, a number for each band, and ``sketch``, further signs packed into integers."""
    words = SKETCH_BITS // 64

    @arrow_udf("STRUCT<bucket: ARRAY<BIGINT>, sketch: ARRAY<BIGINT>>")
    def project(units: pa.Array) -> pa.Array:
        result = pa.struct([("bucket", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
        if not len(units):
            return pa.array([], type=result)
        x = _matrix(units)
        draw = np.random.default_rng(seed)

        def signs(n):
            return (x @ draw.normal(size=(x.shape[1], n))) >= 0

        weights = 1 << np.arange(bits, dtype=np.int64)
        buckets = np.stack([signs(bits) @ weights for _ in range(bands)], 1)
        sketch = np.packbits(signs(SKETCH_BITS), axis=1).view(np.int64)

        def lists(values):
            return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))

        return pa.StructArray.from_arrays([lists(buckets), lists(np.ascontiguousarray(sketch))], fields=list(result))

    made = groups.withColumn("_made", project("_unit"))
    return made.select("id", "lo", "hi", F.col("_made.bucket").alias("bucket"), *[F.col("_made.sketch")[k].alias(f"s{k}") for k in range(words)])


def candidate_pairs(groups: DataFrame, min_cosine: float, min_gap: float, recall: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) of groups in one bucket of some band whose scores differ, once for each band: all, and those whose sketch can reach the cosine."""
    bits, bands = bands_for(groups.count(), min_cosine, recall)
    rows = _buckets(groups, bits, bands, seed)
    sketch = [c for c in rows.columns if c[0] == "s"]
    banded = stage(rows.select("id", "lo", "hi", *sketch, F.posexplode("bucket").alias("band", "bucket")), "bands")
    one, other = (banded.select("band", "bucket", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "lo", "hi", *sketch)]) for x in ("one", "other"))
    gap = F.greatest(F.abs(F.col("one_hi") - F.col("other_lo")), F.abs(F.col("other_hi") - F.col("one_lo")))
    met = one.join(other, ["band", "bucket"]).filter((F.col("one_id") < F.col("other_id")) & (gap >= min_gap))
    apart = sum((F.bit_count(F.col(f"one_{s}").bitwiseXOR(F.col(f"other_{s}"))) for s in sketch), F.lit(0))
    differ = math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi
    most = SKETCH_BITS * (differ + SKETCH_SIGMAS * math.sqrt(differ * (1 - differ) / SKETCH_BITS))
    named = [F.col("one_id").alias("a"), F.col("other_id").alias("b")]
    return met.select(*named), met.filter(apart <= most).select(*named)


def similar_pairs(
    df: DataFrame, key: str, vector: str, score: str, min_cosine: float, min_gap: float, recall: float = 0.95, seed: int = 0
) -> DataFrame:
    """(a, b, cosine, gap) as of ``close_pairs``, by the signs of random projections.

    Every row is right: cosines and gaps are those of the vectors. A pair at exactly
    ``min_cosine`` is found with a probability of ``recall``, one above it more surely. Bands
    get longer with the number of vectors, so a vector meets about as many strangers in a
    table of any size; their number grows with a small power of it (0.22 at a cosine of 0.9).
    The buckets are joined as any other key, so Spark splits those that are hot.
    """
    groups = unit_vectors(vector_groups(df, key, vector, score), vector)
    groups = stage(groups.select("id", "lo", "hi", "_unit"), "vector-groups")
    _, met = candidate_pairs(groups, min_cosine, min_gap, recall, seed)
    pairs = stage(met.distinct(), "similar-candidates")
    one, other = (groups.select(*[F.col(c).alias(f"{x}_{c}") for c in ("id", "lo", "hi", "_unit")]) for x in ("one", "other"))
    both = pairs.join(one, F.col("a") == F.col("one_id")).join(other, F.col("b") == F.col("other_id"))
    product = F.aggregate(F.zip_with("one__unit", "other__unit", lambda x, y: x * y), F.lit(0.0), lambda at, x: at + x)
    gap = F.greatest(F.abs(F.col("one_hi") - F.col("other_lo")), F.abs(F.col("other_hi") - F.col("one_lo")))
    found = both.select("a", "b", product.alias("cosine"), gap.alias("gap")).filter(F.col("cosine") >= min_cosine)
    return found.unionByName(_own_pairs(groups, min_gap))


# --- neighbours, and a layout that keeps them ----------------------------------------------

#: Orders that rows are sorted in for the first neighbours, rows looked at behind each, and joins of neighbours with neighbours.
FIRST_ORDERS, FIRST_ROWS, DESCENTS = 8, 8, 3
#: Rows that stand around a row because it is their neighbour, as a multiple of its own neighbours.
REVERSE = 4


def _raw_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``place``, the vector as it is given: half as wide as its unit vector where it holds floats."""
    given = dict(df.dtypes)[vector] == "array<float>"
    return df.select(F.col(key).cast("bigint").alias("id"), (F.col(vector) if given else F.col(vector).cast("array<double>")).alias("place"))


def _units(places: pa.Array) -> np.ndarray:
    """Vectors at length 1; an all-zero vector stays zero."""
    x = _matrix(places).astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(length > 0, length, 1.0)[:, None]


_SCORED = "a BIGINT, b BIGINT, cosine DOUBLE"


def _scored_batch(a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cosine, pa.float64())], names=["a", "b", "cosine"])


def _first_neighbours(rows: DataFrame, seed: int) -> DataFrame:
    """(a, b, cosine), both ways, of rows that stand close to each other in some order by the signs of random projections."""

    @arrow_udf("ARRAY<BIGINT>")
    def codes(places: pa.Array) -> pa.Array:
        if not len(places):
            return pa.array([], pa.list_(pa.int64()))
        x = _units(places)
        draw = np.random.default_rng(seed)
        weights = 1 << np.arange(62, dtype=np.int64)[::-1]
        found = np.stack([((x @ draw.normal(size=(x.shape[1], 62))) >= 0) @ weights for _ in range(FIRST_ORDERS)], 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, FIRST_ORDERS, dtype=np.int32)), pa.array(found.ravel()))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (batch.column(0).to_numpy(), batch.column(2).to_numpy(), _units(batch.column(3)))
            orders, ids, x = new if held is None else (np.concatenate(pair) for pair in zip(held, new))
            old = 0 if held is None else len(held[0])
            for gap in range(1, min(FIRST_ROWS, len(ids) - 1) + 1):
                i = np.arange(max(0, old - gap), len(ids) - gap)
                i = i[(orders[i] == orders[i + gap]) & (ids[i] != ids[i + gap])]
                if len(i):
                    cosine = np.einsum("ij,ij->i", x[i], x[i + gap])
                    yield _scored_batch(np.concatenate([ids[i], ids[i + gap]]), np.concatenate([ids[i + gap], ids[i]]), np.concatenate([cosine, cosine]))
            held = (orders[-FIRST_ROWS:], ids[-FIRST_ROWS:], x[-FIRST_ROWS:])

    coded = rows.select("id", "place", F.posexplode(codes("place")).alias("order", "code")).select(F.col("order").cast("bigint").alias("order"), "code", "id", "place")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(parts, "order", "code", "id").sortWithinPartitions("order", "code", "id")
    return ordered.mapInArrow(link, _SCORED)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` distinct pairs of each ``a`` with the largest cosine."""
    # by ``a`` alone, so that telling pairs apart and ranking them take one shuffle
    pairs = pairs.repartition("a").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    order = W.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


#: Numbers that one comparison of the rows around some hubs may gather.
HUB_NUMBERS = 2_000_000


def _pairs_at_hubs(k: int):
    """Arrow function over the rows around hubs (hub, b, new, floor, place; sorted by hub and b): (a, b, cosine) that can be among the ``k`` nearest of a.

    Two rows around a hub are compared unless both stood there in the round before, which has compared
    them. A pair goes on for an end whose ``floor``, the cosine of its k-th neighbour so far, it reaches and
    among whose k nearest around this hub it is; no other can change the graph.
    """

    def compare(ids: np.ndarray, new: np.ndarray, floor: np.ndarray, x: np.ndarray, first: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(size, 1)
        step = max(1, HUB_NUMBERS // (len(i) * max(x.shape[1], 1)))
        for at in range(0, len(first), step):
            rows = first[at : at + step, None] + np.arange(size)
            one, other = rows[:, i].ravel(), rows[:, j].ravel()
            cosine = np.einsum("ij,ij->i", x[one], x[other])
            cosine[~(new[one] | new[other]) | (ids[one] == ids[other])] = -np.inf
            table = np.full((len(rows), size, size), -np.inf)
            table[:, i, j] = table[:, j, i] = cosine.reshape(len(rows), -1)
            least = floor[rows]
            if size > k:
                least = np.maximum(least, np.partition(table, size - k, axis=2)[:, :, size - k])
            hub, row, near = np.nonzero((table >= least[:, :, None]) & (table > -np.inf))
            yield _scored_batch(ids[rows[hub, row]], ids[rows[hub, near]], table[hub, row, near])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            hubs = got.column(0).to_numpy()
            # the last hub may go on in the next batch
            cut = int(np.searchsorted(hubs, hubs[-1]))
            held = got.slice(cut)
            if cut:
                yield from whole(got.slice(0, cut))
        if held is not None:
            yield from whole(held)

    def whole(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hubs, ids = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        new, floor = rows.column(2).to_numpy(zero_copy_only=False), rows.column(3).to_numpy()
        x = _units(rows.column(4))
        first = np.flatnonzero(np.r_[True, hubs[1:] != hubs[:-1]])
        sizes = np.diff(np.r_[first, len(hubs)])
        for size in np.unique(sizes):
            if size > 1:
                yield from compare(ids, new, floor, x, first[sizes == size], int(size))

    return run


def neighbour_graph(df: DataFrame, key: str, vector: str, k: int = 10, seed: int = 0, descents: int = DESCENTS) -> DataFrame:
    """(a, b, cosine): about the ``k`` rows with the largest cosine to each row.

    Approximate: the first neighbours stand next to each other in a few orders; then what is
    a neighbour of a neighbour is tried, some rounds in a row. A row is compared with a
    bounded number of others in each round, whatever the table's size: around a row stand its
    ``k`` neighbours and the ``REVERSE * k`` closest of the rows whose neighbour it is. Vectors
    travel to the rows around which they stand and are compared there, so what is shuffled
    follows the graph and not the pairs. Keys have to be whole numbers, one for each row.
    """
    rows = stage(_raw_vectors(df, key, vector), "places")
    graph = stage(_nearest(_first_neighbours(rows, seed), k), "neighbours")
    before = None
    for _ in range(descents):
        turned = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")
        near = graph.select("a", "b").union(_nearest(turned, REVERSE * k).select("a", "b"))
        marked = near.withColumn("old", F.lit(False))
        if before is not None:
            marked = marked.withColumn("now", F.lit(True)).union(before.select("a", "b", F.lit(True), F.lit(False)))
            marked = marked.groupBy("a", "b").agg(F.max("old").alias("old"), F.max("now").alias("now")).filter("now").drop("now")
        near = stage(marked.groupBy("a", "b").agg(F.max("old").alias("old")).select("a", "b", (~F.col("old")).alias("new")), "near")
        # a hub without new rows has nothing to compare
        moved = near.filter("new").select("a").distinct()
        floors = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(float("-inf")).alias("floor"))
        placed = rows.join(floors.withColumnRenamed("a", "id"), "id", "left").select(F.col("id").alias("b"), "place", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        around = near.join(moved, "a", "left_semi").join(placed, "b").select("a", "b", "new", "floor", "place")
        found = around.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_pairs_at_hubs(k), _SCORED)
        graph = stage(_nearest(graph.unionByName(found), k), "neighbours")
        before = near
    return graph


def project_neighbours(df: DataFrame, key: str, vector: str = "embedding", k: int = 10, steps: int = 40, seed: int = 0, graph: DataFrame | None = None) -> DataFrame:
    """(key, x, y): a layout in which neighbours stand close to each other.

    The two smoothest functions on the graph of neighbours: eigenvectors of its normalised
    adjacency next to the constant one, by power iteration. A step is a join of the edges
    with the values and a sum; after some steps a few sums over all rows make the two
    independent of each other and of the constant again. Rows without a neighbour stand at the
    origin. ``graph`` is a table as of ``neighbour_graph``, if there is one already.
    """
    graph = neighbour_graph(df, key, vector, k, seed) if graph is None else graph
    edges = graph.select("a", "b").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    # a row with all of its neighbours; an edge needs no weight of its own, as that follows from its ends
    lists = stage(edges.groupBy("a").agg(F.collect_list("b").alias("near")).withColumn("root", F.sqrt(F.size("near").cast("double"))), "edges")
    noise = lambda name: F.xxhash64("a", F.lit(f"{seed}{name}")) / F.lit(2.0**63)
    values = lists.select("a", "root", noise("x").alias("x"), noise("y").alias("y"))
    done = 0
    while done < steps:
        held = lists.join(values.drop("root"), "a")
        for _ in range(min(STEPS_AT_ONCE, steps - done)):
            # half of the step is to stay, which keeps alternating functions out: what a row sends to itself
            sent = held.select("a", "root", "x", "y", F.explode(F.concat("near", F.array("a"))).alias("to"))
            share = F.when(F.col("to") == F.col("a"), F.col("root")).otherwise(1 / F.col("root"))
            moved = sent.groupBy(F.col("to").alias("a")).agg(*[F.sum(F.col(c) * share).alias(f"to_{c}") for c in "xy"])
            held = lists.join(moved, "a").select("a", "near", "root", *[(F.col(f"to_{c}") / F.col("root") / 2).alias(c) for c in "xy"])
        values = held.select("a", "root", "x", "y")
        done += STEPS_AT_ONCE
        values = stage(values, "layout")
        names = ("root", "x", "y")
        s = values.agg(*[F.sum(F.col(i) * F.col(j)).alias(i + j) for i in names for j in names]).first()
        if not s["rootroot"]:
            break
        product = np.array([[s[i + j] for j in names] for i in names])
        # columns of this are the constant, and x and y freed from it and from each other
        turn = np.linalg.solve(np.linalg.cholesky(product + 1e-300 * np.eye(3)), np.eye(3))
        values = values.select("a", "root", *[sum((F.col(n) * float(turn[i, j]) for j, n in enumerate(names)), F.lit(0.0)).alias(c) for i, c in ((1, "x"), (2, "y"))])
    placed = values.select(F.col("a").alias("_a"), (F.col("x") / F.col("root")).alias("x"), (F.col("y") / F.col("root")).alias("y"))
    rows = df.select(key).join(placed, F.col(key).cast("bigint") == F.col("_a"), "left")
    return rows.select(key, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


#: Steps of the layout between two tables.
STEPS_AT_ONCE = 5


def kept_neighbours(layout: DataFrame, key: str, graph: DataFrame, k: int = 10) -> DataFrame:
    """One row, ``kept``: the share of the graph's edges whose ends are among each other's ``k`` nearest in the layout (columns x and y).

    The plane is bent onto a small part of a sphere, where nearer means a larger cosine.
    """
    wide = layout.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")).scalar()
    bent = layout.select(key, F.array((F.col("x") / wide).alias("x"), F.col("y") / wide, F.lit(8.0)).alias("place"))
    flat = neighbour_graph(bent, key, "place", k)
    own = graph.select("a", "b", F.lit(1).alias("own")).join(flat.select("a", "b", F.lit(1).alias("found")), ["a", "b"], "left")
    return own.agg((F.count("found") / F.count("own")).alias("kept"))
