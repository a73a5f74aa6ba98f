"""Train/test splits by owner or by row.

Owners are ordered by a hash of (seed, owner) and the first ones are the test
set. Only the hash of the last test owner has to be known: membership is then a
comparison inside the row. The data itself is neither sorted, joined nor
shuffled, and an owner with very many rows is no special case.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradeloom.session import stage

PREFIX_DIGITS = 5  # 16**5 counters; each stands for a millionth of the keys
CELL = 100_000  # keys that are ranked in one task; larger cells are cut by further digits
NULL_KEY = "\x00null"  # null is a key of its own


class Boundary(NamedTuple):
    hash: str | None
    key: str | None


def _text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(NULL_KEY))


def _hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), _text(key)))


def order_boundary(df: DataFrame, place: Column, size: int | Callable[[int], int]) -> str | None:
    """The ``size``-th smallest value of ``place``, a string that starts with a hash.

    Rows are counted per prefix (a table of fixed size), and under the one prefix that holds
    the boundary again by longer prefixes, until few enough are left to rank or they are all
    equal. ``size`` may be a function of the number of rows. None if no row is wanted.
    """
    places = df.select(place.alias("k"))
    prefix, wanted = "", None
    while True:
        cells = places.filter(F.col("k").startswith(prefix)).groupBy(F.substring("k", 1, len(prefix) + PREFIX_DIGITS).alias("p"))
        counts = stage(cells.agg(F.count("*").alias("count"), F.min("k").alias("least"), F.max("k").alias("most")), "key-counts")
        if wanted is None:
            total = counts.agg(F.sum("count")).first()[0] or 0
            wanted = min(total, size(total) if callable(size) else size)
            if wanted <= 0:
                return None
        upto = counts.withColumn("upto", F.sum("count").over(W.partitionBy(F.lit(0)).orderBy("p")))
        cell = upto.filter(F.col("upto") >= wanted).orderBy("p").first()
        wanted -= cell["upto"] - cell["count"]
        if cell["least"] == cell["most"]:
            return cell["least"]
        prefix = os.path.commonprefix([cell["least"], cell["most"]])
        if cell["count"] <= CELL:
            inside = places.filter(F.col("k").startswith(prefix) & F.col("k").between(cell["least"], cell["most"]))
            return inside.withColumn("n", F.row_number().over(W.orderBy("k"))).filter(F.col("n") == wanted).first()["k"]


def hash_boundary(
    df: DataFrame, key: str | Column, size: Callable[[int], int], seed: int, unique: bool = False
) -> Boundary:
    """Hash and key of the last of the first ``size(number of keys)`` keys in hash order.

    With ``unique`` every row counts, repeated keys too.
    """
    keys = df.select(_text(F.col(key) if isinstance(key, str) else key).alias("k"))
    if not unique:
        keys = keys.distinct()
    last = order_boundary(keys, F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.col("k"))), F.col("k")), size)
    return Boundary(None, None) if last is None else Boundary(last[:32], last[32:])


def within_boundary(key: Column, boundary: Boundary, seed: int) -> Column:
    if boundary.hash is None:
        return F.lit(False)
    h, k = _hash(key, seed), _text(key)
    return (h < boundary.hash) | ((h == boundary.hash) & (k <= boundary.key))


def with_split(
    df: DataFrame, key: str, test_share: float = 0.3, seed: int = 0, unique: bool = False, name: str = "is_test"
) -> DataFrame:
    """Mark the test rows: ``ceil(share * keys)`` of the keys, all rows of a key on one side.

    Rows without a key are one key, so every row is on exactly one side.
    """
    boundary = hash_boundary(df, key, lambda total: math.ceil(test_share * total), seed, unique)
    return df.withColumn(name, within_boundary(F.col(key), boundary, seed))


def split_by_owner(df: DataFrame, test_share: float = 0.3, seed: int = 0, owner: str = "developer"):
    """(train, test) without a common owner."""
    marked = with_split(df, owner, test_share, seed)
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def split_by_row(df: DataFrame, key: str, test_share: float = 0.3, seed: int = 0):
    """(train, test) by row: the contrast case, which leaks owners."""
    marked = with_split(df, key, test_share, seed, unique=True)
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def common_owners(train: DataFrame, test: DataFrame, owner: str) -> DataFrame:
    """Owners on both sides."""
    return train.select(owner).intersect(test.select(owner))  # null equals null here


def count_common_owners(train: DataFrame, test: DataFrame, owner: str, name: str = "common_owners") -> DataFrame:
    return common_owners(train, test, owner).agg(F.count("*").alias(name))


def with_fold(df: DataFrame, key: str, folds: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """Shuffled folds by row hash; sizes are equal up to chance and stable under repartitioning."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int"))
