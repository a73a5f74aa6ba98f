"""Shapley values of tree ensembles against a background set.

Interventional tree Shapley values (Lundberg et al., 2020). For a leaf of value v,
a row x and a background row z, a path feature counts only if exactly one of the
two lies in the leaf's box on it. With a such features on the side of x and b on
the side of z, and no path feature missed by both, each of the a features gets
v (a-1)! b! / (a+b)! and each of the b features gets -v a! (b-1)! / (a+b)!. The result is
the mean over background rows and trees.

Which path features a row satisfies is a bit mask. Background rows are reduced
to (leaf, mask, count) by Spark first, so the cost follows the distinct masks and
not the background's size. Explaining a row then needs nothing but the leaves and
those counts: the rows are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from gradeloom.operators.curate import sample_rows
from gradeloom.schemas import LEAVES
from gradeloom.session import scratch_path, stage

MASKS_PER_BLOCK = 2_000_000
CELLS = 2_000_000  # leaves x rows worked on at once
PRODUCTS = 2_000_000  # row masks x background masks x path features worked on at once
LONGEST_PATH = 62  # features of a path that fit into the bits of a mask
DENSE_NUMBERS = 24_000_000  # numbers kept per task for effects already worked out, over all blocks
WHOLE_TABLE = 2_000_000  # numbers of the sums that a table of effects is worked out from


# --- leaves of a fitted forest --------------------------------------------------


def forest_nodes(spark: SparkSession, model) -> DataFrame:
    """The nodes of a fitted Spark forest, from its saved form."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    node = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        node["prediction"].alias("value"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    )


def _boxes_of_tree(nodes: pd.DataFrame) -> pd.DataFrame:
    at = nodes.set_index("node").to_dict("index")
    tree = int(nodes["tree"].iloc[0])
    rows, pending = [], [(0, {})]
    while pending:
        number, box = pending.pop()
        node = at[number]
        if node["left"] < 0:
            bounds = box or {None: (None, None)}
            rows.extend((tree, number, node["value"], f, lo, hi) for f, (lo, hi) in bounds.items())
            continue
        feature, cut = int(node["feature"]), node["threshold"]
        lo, hi = box.get(feature, (-math.inf, math.inf))
        pending.append((int(node["left"]), {**box, feature: (lo, min(hi, cut))}))
        pending.append((int(node["right"]), {**box, feature: (max(lo, cut), hi)}))
    frame = pd.DataFrame(rows, columns=["tree", "leaf", "value", "feature", "lo", "hi"])
    frame["feature"] = frame["feature"].astype("Int32")
    return frame


def leaf_boxes(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, value, feature, lo, hi): a leaf holds rows with lo < x <= hi on each path feature.

    One task per tree. A tree without a split gives one row with a null feature.
    """
    return nodes.groupBy("tree").applyInPandas(_boxes_of_tree, LEAVES)


# --- Shapley values ---------------------------------------------------------------


class _Leaf(NamedTuple):
    value: float
    features: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


class _Masks(NamedTuple):
    masks: np.ndarray
    shares: np.ndarray


class _Boxes:
    """Leaves by feature, so that the masks of many rows and leaves take a few look-ups for each feature.

    Bounds cut a feature's values into intervals; what bits an interval sets is worked out once.
    """

    def __init__(self, leaves: list[_Leaf]):
        found: dict[int, list] = {}
        for i, leaf in enumerate(leaves):
            for j, (feature, lo, hi) in enumerate(zip(leaf.features, leaf.lo, leaf.hi)):
                found.setdefault(int(feature), []).append((i, j, lo, hi))
        self.size = len(leaves)
        longest = max(len(leaf.features) for leaf in leaves)
        self.kind = next(kind for kind in (np.uint8, np.uint16, np.uint32, np.int64) if longest <= 8 * np.dtype(kind).itemsize)
        #: feature: its bounds, bits by interval and leaf; values that are no number lie behind all bounds and set none
        self.tests = {}
        for feature, rows in found.items():
            i, j, lo, hi = (np.array(c) for c in zip(*rows))
            cuts = np.unique(np.concatenate([lo, hi]))
            interval = np.arange(len(cuts) + 1)[:, None]
            inside = (interval > np.searchsorted(cuts, lo)) & (interval <= np.searchsorted(cuts, hi))
            bits = np.zeros((len(interval), self.size), dtype=self.kind)
            bits[:, i] = inside.astype(self.kind) << j.astype(self.kind)
            self.tests[feature] = (cuts, bits)

    def masks(self, x: np.ndarray) -> np.ndarray:
        """Leaf by row; bit j is set where the row lies in the leaf's box on path feature j. ``x`` is feature by row."""
        masks = np.zeros((x.shape[1], self.size), dtype=self.kind)
        for feature, (cuts, bits) in self.tests.items():
            masks |= bits[np.searchsorted(cuts, x[feature])]
        return np.ascontiguousarray(masks.T)


def _dense_and_wide(leaves: list[_Leaf], numbers, room: int) -> tuple[list[int], list[int]]:
    """Leaves whose masks index a table of bounded size (``numbers`` of a leaf's width), and the others."""
    dense, wide = [], []
    for i, leaf in enumerate(leaves):
        need = numbers(len(leaf.features))
        (dense if need <= room else wide).append(i)
        room -= need if need <= room else 0
    return dense, wide


def _slices(positions: list[int], rows: int) -> Iterator[list[int]]:
    """The leaves a bounded number at a time."""
    step = max(1, CELLS // max(rows, 1))
    for at in range(0, len(positions), step):
        yield positions[at : at + step]


def _weights(longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(a-1)! b! / (a+b)! and a! (b-1)! / (a+b)!, zero where not defined."""
    f = [float(math.factorial(i)) for i in range(2 * longest + 1)]
    size = range(longest + 1)
    gain = np.array([[f[a - 1] * f[b] / f[a + b] if a else 0.0 for b in size] for a in size])
    loss = np.array([[f[a] * f[b - 1] / f[a + b] if b else 0.0 for b in size] for a in size])
    return gain, loss


def _leaf_effect(leaf: _Leaf, ours: np.ndarray, background: _Masks, gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    """Effect per (distinct row mask, path feature), a bounded number of products at a time."""
    width = len(leaf.features)
    bits = np.arange(width, dtype=np.int64)
    effect = np.zeros((len(ours), width))
    rows = max(1, min(len(ours), PRODUCTS // width))
    columns = max(1, PRODUCTS // (rows * width))
    for i in range(0, len(ours), rows):
        x = ours[i : i + rows, None]
        for k in range(0, len(background.masks), columns):
            z = background.masks[None, k : k + columns]
            covered = (x | z) == (1 << width) - 1
            only_x, only_z = x & ~z, z & ~x
            a, b = np.bitwise_count(only_x), np.bitwise_count(only_z)
            scale = np.where(covered, leaf.value * background.shares[None, k : k + columns], 0.0)
            plus, minus = scale * gain[a, b], scale * loss[a, b]
            on_x = (only_x[..., None] >> bits) & 1
            on_z = (only_z[..., None] >> bits) & 1
            effect[i : i + rows] += np.einsum("uk,ukf->uf", plus, on_x) - np.einsum("uk,ukf->uf", minus, on_z)
    return effect


def _table_numbers(width: int) -> int:
    return (width + 1) << width


def _effect_tables(leaves: list[_Leaf], backgrounds: list[_Masks], gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    """Effects of leaves with paths of one length: leaf by path feature by row mask.

    A background row counts for a row mask if the features it misses are among the mask's. So
    shares are put at the missed features, by their number, and summed up over all subsets of every
    mask, one feature after the other. The subsets with a certain feature are those of the mask less those
    of the mask without it.
    """
    width = len(leaves[0].features)
    every = np.arange(1 << width)
    size = np.bitwise_count(every).astype(np.int64)
    sums = np.zeros((len(leaves), width + 1, 1 << width))
    for own, background in zip(sums, backgrounds):
        missed = background.masks ^ ((1 << width) - 1)
        own[size[missed], missed] = background.shares
    for j in range(width):
        halves = sums.reshape(len(leaves), width + 1, -1, 2, 1 << j)
        halves[:, :, :, 1] += halves[:, :, :, 0]
    plus, minus = gain[: width + 1, width - size], loss[: width + 1, width - size]
    value = np.array([leaf.value for leaf in leaves])[:, None]
    effects = np.empty((len(leaves), width, 1 << width))
    with_all = np.einsum("lam,am->lm", sums, plus)
    lost = np.einsum("lam,am->lm", sums, minus)
    for j in range(width):
        has = np.flatnonzero(every >> j & 1)
        effects[:, j] = -value * lost
        effects[:, j, has] = value * (with_all[:, has] - np.einsum("lam,am->lm", sums[:, :, has ^ (1 << j)], plus[:, has]))
    return effects


class _Effects:
    """Effects of leaves for every mask, kept once they have been worked out.

    Leaves beyond ``room`` work them out again for each batch, and those with paths too long
    for a table look at the distinct masks of the batch.
    """

    def __init__(self, leaves: list[_Leaf], backgrounds: list[_Masks], room: int):
        # tables are worked out for leaves of one length at a time
        order = sorted(range(len(leaves)), key=lambda i: len(leaves[i].features))
        self.leaves, self.backgrounds = [leaves[i] for i in order], [backgrounds[i] for i in order]
        self.weights = _weights(max(len(leaf.features) for leaf in leaves))
        whole = [i for i, leaf in enumerate(self.leaves) if _table_numbers(len(leaf.features)) <= WHOLE_TABLE]
        kept, _ = _dense_and_wide([self.leaves[i] for i in whole], lambda width: width << width, room)
        self.kept, self.whole = set(kept), set(whole)
        self.tables: dict[int, np.ndarray] = {}
        self._boxes: dict[tuple, _Boxes] = {}

    def _part(self, chosen: list[int]) -> _Boxes:
        key = (chosen[0], chosen[-1], len(chosen))
        if key not in self._boxes:
            self._boxes[key] = _Boxes([self.leaves[i] for i in chosen])
        return self._boxes[key]

    def _by_table(self, chosen: list[int], rows: int) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves that have a table, with it: kept ones, and those that are worked out for this batch."""
        wanted = []
        for i in chosen:
            if i in self.tables:
                yield i, self.tables[i]
            elif i in self.kept or (i in self.whole and self._pays(i, rows)):
                wanted.append(i)
        at = 0
        while at < len(wanted):
            width = len(self.leaves[wanted[at]].features)
            step = max(1, WHOLE_TABLE // _table_numbers(width))
            part = [i for i in wanted[at : at + step] if len(self.leaves[i].features) == width]
            at += len(part)
            tables = _effect_tables([self.leaves[i] for i in part], [self.backgrounds[i] for i in part], *self.weights)
            for i, table in zip(part, tables):
                if i in self.kept:
                    self.tables[i] = table
                yield i, table

    def _pays(self, i: int, rows: int) -> bool:
        """Whether all masks take less than those of the rows, one by one."""
        return rows * len(self.backgrounds[i].masks) > _table_numbers(len(self.leaves[i].features))

    def add_to(self, phi: np.ndarray, x: np.ndarray) -> None:
        """Add the effects to ``phi``; both are feature by row."""
        for chosen in _slices(list(range(len(self.leaves))), x.shape[1]):
            masks = dict(zip(chosen, self._part(chosen).masks(x)))
            for i, table in self._by_table(chosen, x.shape[1]):
                mask = masks.pop(i).astype(np.intp)
                for j, feature in enumerate(self.leaves[i].features):
                    phi[feature] += table[j].take(mask)
            for i, mask in masks.items():
                distinct, which = np.unique(mask.astype(np.int64), return_inverse=True)
                part = _leaf_effect(self.leaves[i], distinct, self.backgrounds[i], *self.weights)[which]
                for j, feature in enumerate(self.leaves[i].features):
                    phi[feature] += part[:, j]


def _effects_function(block, trees: int, room: int):
    """Arrow function: feature values of a row to their effects; ``block`` is a broadcast of leaves and their masks."""

    @arrow_udf("ARRAY<DOUBLE>")
    def effects(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Effects(*block.value, room)
        for batch in batches:
            n = len(batch)
            x = np.ascontiguousarray(batch.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T) if n else np.zeros((0, 0))
            phi = np.zeros_like(x)
            if n:
                known.add_to(phi, x)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * len(x))
            yield pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(phi.T / trees).ravel()))

    return effects.asNondeterministic()


def _count_masks(shared):
    """Arrow function: rows (arrays of feature values) to (leaf, mask, n), one row for each mask of a dense leaf and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = shared.value
        dense, wide = _dense_and_wide(leaves, lambda width: 1 << width, DENSE_NUMBERS)
        totals = {i: np.zeros(1 << len(leaves[i].features), dtype=np.int64) for i in dense}
        parts: dict[tuple, _Boxes] = {}

        def table(leaf, masks, n):
            return pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(masks, pa.int64()), pa.array(n, pa.int64())], names=["leaf", "mask", "n"])

        for batch in batches:
            rows = batch.column(0)
            if not len(rows):
                continue
            x = np.ascontiguousarray(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).T)
            for chosen in [*_slices(dense, len(rows)), *([i] for i in wide)]:
                key = (chosen[0], len(chosen))
                if key not in parts:
                    parts[key] = _Boxes([leaves[i] for i in chosen])
                for i, found in zip(chosen, parts[key].masks(x)):
                    if i in totals:
                        totals[i] += np.bincount(found, minlength=len(totals[i]))
                    else:
                        masks, n = np.unique(found.astype(np.int64), return_counts=True)
                        yield table(np.full(len(masks), i), masks, n)
        for i, n in totals.items():
            masks = np.flatnonzero(n)
            if len(masks):
                yield table(np.full(len(masks), i), masks, n[masks])

    return count


def _collect_leaves(leaves: DataFrame) -> tuple[list[_Leaf], int]:
    """The leaves with a path as arrays, and the number of trees. They come from a model that was on the driver already."""
    rows = sorted(leaves.select("tree", "leaf", "feature", "value", "lo", "hi").collect(), key=lambda r: (r.tree, r.leaf, -1 if r.feature is None else r.feature))
    trees = len({r.tree for r in rows})
    found: dict[tuple, list] = {}
    for r in rows:
        if r.feature is not None:
            found.setdefault((r.tree, r.leaf), []).append(r)
    longest = max(map(len, found.values()), default=0)
    if longest > LONGEST_PATH:
        raise ValueError(f"a path tests {longest} features; {LONGEST_PATH} is the most")
    columns = (("feature", int), ("lo", float), ("hi", float))
    return [_Leaf(float(path[0].value), *(np.array([r[c] for r in path], dtype=t) for c, t in columns)) for path in found.values()], trees


class Explainer:
    """Effects of a fixed set of leaves against a fixed background, prepared once and used on any rows.

    ``leaves`` is a table as from ``leaf_boxes``; feature numbers index ``features``. What
    masks the background has is a table, cut by a hash into blocks of at most about
    ``MASKS_PER_BLOCK`` rows, a leaf's masks too: effects are sums over masks, so it does not
    matter which block adds them; a leaf with few masks is in one only. One block at a time becomes a broadcast; functions carry its handle
    only. The results of the blocks are added up inside the row, so rows are never shuffled.
    """

    def __init__(self, background: DataFrame, leaves: DataFrame, features: list[str]):
        self.features = list(features)
        self._functions = []
        spark = background.sparkSession
        # missing values count as 0, in the background as in the rows
        z = background.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"))
        boxes, trees = _collect_leaves(leaves)
        if not boxes:
            return
        counted = z.mapInArrow(_count_masks(spark.sparkContext.broadcast(boxes)), "leaf INT, mask BIGINT, n BIGINT").groupBy("leaf", "mask").agg(F.sum("n").alias("n"))
        masks = stage(counted, "masks")
        # every row of the background has one mask in each leaf
        size = masks.agg(F.count(F.lit(1)).alias("masks"), F.sum(F.when(F.col("leaf") == 0, F.col("n"))).alias("rows")).first()
        rows, blocks = size["rows"] or 0, -(-2 * size["masks"] // MASKS_PER_BLOCK)
        # a leaf with few masks is in one block, so that no two of them look at it for every row
        few = [i for i, leaf in enumerate(boxes) if 1 << len(leaf.features) <= MASKS_PER_BLOCK // 16]
        together = F.xxhash64("leaf") if len(few) == len(boxes) else F.when(F.col("leaf").isin(few), F.xxhash64("leaf")).otherwise(F.xxhash64("leaf", "mask"))
        in_block = F.pmod(together, F.lit(max(blocks, 1)))
        for k in range(blocks):
            block = masks.filter(in_block == k).sort("leaf", "mask").toArrow()
            if not block.num_rows:
                continue
            leaf, mask, n = (c.to_numpy() for c in block.columns)
            chosen, starts = np.unique(leaf, return_index=True)
            found = [_Masks(m, c / rows) for m, c in zip(np.split(mask, starts[1:]), np.split(n, starts[1:]))]
            self._functions.append(_effects_function(spark.sparkContext.broadcast(([boxes[i] for i in chosen], found)), trees, DENSE_NUMBERS // blocks))

    def add_to(self, df: DataFrame, name: str = "phi") -> DataFrame:
        """Add an array with the effect of every feature, in feature order. Missing values count as 0."""
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features])
        parts = {f"_phi{i}": function(x) for i, function in enumerate(self._functions)}
        # without a function no tree has a split, and nothing depends on any feature
        total = F.col("_phi0") if parts else F.array(*[F.lit(0.0)] * len(self.features))
        for part in list(parts)[1:]:
            total = F.zip_with(total, F.col(part), lambda a, b: a + b)
        return (df.withColumns(parts) if parts else df).withColumn(name, total).drop(*parts)


def attribute(df: DataFrame, background: DataFrame, leaves: DataFrame, features: list[str], key: str = "row_id") -> DataFrame:
    """(row_id, feature, pos, value, phi): the effects as a long table, one row per row and feature."""
    rows = Explainer(background, leaves, features).add_to(df.select(F.col(key).cast("bigint").alias("row_id"), *features))
    names = F.array(*[F.lit(c) for c in features])
    values = F.array(*[F.col(c).cast("double") for c in features])
    return rows.select(
        "row_id", F.posexplode(F.arrays_zip(names.alias("feature"), values.alias("value"), F.col("phi").alias("phi"))).alias("pos", "c")
    ).select("row_id", "c.feature", "pos", "c.value", "c.phi")


def attribute_forest(
    df: DataFrame,
    background: DataFrame,
    model,
    features: list[str],
    key: str = "row_id",
    background_key: str | None = None,
    background_rows: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Shapley values of a fitted forest against the whole background, or a sample of as many rows as the caller names."""
    if background_rows is not None:
        background = sample_rows(background, background_rows, background_key or key, seed)
    return attribute(df, background, leaf_boxes(forest_nodes(df.sparkSession, model)), features, key)
