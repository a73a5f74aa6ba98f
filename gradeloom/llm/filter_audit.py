"""What five filters remove, alone and in every order.

The filters look at whole texts: A too few words, B too few distinct words, C too many
capitals, D symbols of markup or code, E a copy of a text with a smaller id. A to D need
their own row alone. E is an existential self-join: a row fails if another row has the same
hash, the same text and a smaller id; the ids that fail it are put together with the ids
that fail the others, and every document ends up with one combination of failures. There are
32 combinations, so everything that is asked about orders of filters comes from 32 counts
for each part of the corpus, whatever its size.

Texts travel only where their hash comes back under another id. A group of copies may hold a
third of all rows: against it stands one row (the smallest id of the text), aggregated
before the shuffle and written, so that Spark can split the join.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import SPACES, bind, stage, text_or_empty

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
#: Cells of the hash in which some hash comes back. As many rows at most are broadcast, whatever the input.
CELLS = 1 << 20
_SPACE_CHARACTERS = " \t\n\x0b\f\r"


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    trimmed = F.btrim(text, F.lit(_SPACE_CHARACTERS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    counts = bind(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("n_distinct")))

    def bits(c):
        failed = {
            "A": c["n"] < LEAST_WORDS,
            "B": c["n_distinct"] * 100 < c["n"] * DISTINCT_PERCENT,
            "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * CAPITAL_PERCENT,
            "D": text.rlike(r"[#$%&*|]"),
        }
        return sum((F.when(f, BIT[k]).otherwise(0) for k, f in failed.items()), F.lit(0))

    return bind(counts, bits)


def copies(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (id, part, mark) whose text stands under a smaller id too.

    ``rows`` has id, part and mark (the hash of the text), ``docs`` the same with the text ``t``.
    """
    again = rows.groupBy("mark").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    cell = F.pmod("mark", F.lit(CELLS))
    cells = F.broadcast(again.select(cell.alias("cell")).distinct())
    texts = stage(docs.withColumn("cell", cell).join(cells, "cell", "left_semi").select("id", "part", "mark", "t"), "audit-texts")
    # the smallest id stands for all of a text: a smaller one exists where that one is smaller
    firsts = texts.groupBy("mark", "t").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    one, other = texts.alias("x"), stage(firsts.select("mark", "t", "least"), "audit-firsts").alias("y")
    same = (F.col("x.mark") == F.col("y.mark")) & (F.col("x.t") == F.col("y.t")) & (F.col("y.least") < F.col("x.id"))
    return one.join(other, same, "left_semi").select("id", "part", "mark")


def failures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """``id``, ``part``, ``mark`` (hash of the text), ``mask`` (bits of all failed filters) and ``n`` (how many rows are equal in these)."""
    text = text_or_empty(text_column)
    keys = [F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{part_column}`"), F.lit("")).alias("part"), F.xxhash64(text).alias("mark")]
    rows = stage(docs.select(*keys, own_failures(text).alias("bits")), "audit-rows")
    repeated = copies(rows, docs.select(*keys, text.alias("t")))
    ids = rows.withColumn("n", F.lit(1)).unionByName(repeated.withColumns({"bits": F.lit(BIT["E"]), "n": F.lit(0)}))
    return ids.groupBy("id", "part", "mark").agg(F.bit_or("bits").alias("mask"), F.sum("n").alias("n"))


def _tallies(counts: Column) -> Column:
    """For every filter behind every set of others: what it keeps, removes, and so on, from the counts by mask."""
    cases = [{"bit": b, "before": m} for b in BIT.values() for m in range(1 << len(FILTERS)) if not m & b]
    every = F.from_json(F.lit(json.dumps(cases)), "array<struct<bit:int,before:int>>")

    def tally(case):
        bit, before = case["bit"], case["before"]
        fails = lambda c: c["mask"].bitwiseAND(bit) != 0
        gone = lambda c: c["mask"].bitwiseAND(before) != 0
        removed = lambda c: fails(c) & ~gone(c)
        # among all orders a document's failed filters come first equally often
        share = lambda c: c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("long")

        def total(of, value=lambda c: c["n"]):
            return F.aggregate(counts, F.lit(0).cast("long"), lambda at, c: at + F.when(of(c), value(c)).otherwise(F.lit(0).cast("long")))

        return F.struct(
            bit.alias("bit"),
            before.alias("before"),
            total(lambda c: c["mask"].bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
            total(removed).alias("removed"),
            total(lambda c: fails(c) & gone(c)).alias("redundant"),
            total(lambda c: c["mask"] == bit).alias("unique_fails"),
            total(removed, lambda c: c["good"]).alias("good_lost"),
            total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
            total(fails, share).alias("shapley"),
        )

    return F.transform(every, tally)


def _steps() -> Column:
    """All steps of all orders: the order, the number of the step, and the place of its tally."""
    at = {(b, m): i for i, (b, m) in enumerate((b, m) for b in BIT.values() for m in range(1 << len(FILTERS)) if not m & b)}
    steps = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for k, name in enumerate(order):
            steps.append({"filter_order": order, "step": k + 1, "place": at[BIT[name], before]})
            before |= BIT[name]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,place:int>>")


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    ``kept`` documents are left after the step, ``removed`` go in it, ``redundant`` fail its
    filter but have gone before, ``unique_fails`` fail no other filter; ``good_lost`` and
    ``toxic_lost`` are removed documents with a label quality = 1 or toxic = 1; ``shapley`` is
    the sum of what the step's filter removes over all 120 orders.

    A null text is empty (and equal to empty ones), a null part is the part ''. Rows with a
    null id copy nothing and are copied by nothing, and have no label. Repeated rows count
    each; rows under one id do not copy each other. A document with several labels is good or
    toxic if one of them says so. An empty table gives no rows. Other columns are not read.
    """
    failed = failures(docs, id_column, text_column, part_column)
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("long")).alias("good"), F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("long")).alias("toxic")
    )
    lost = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    combinations = failed.join(said, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("good"), lost("toxic"))
    # 32 combinations at most
    parts = combinations.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    steps = parts.select("part", _tallies(F.col("counts")).alias("tallies")).select("part", "tallies", F.explode(_steps()).alias("at"))
    tally = F.get("tallies", F.col("at.place"))
    numbers = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return steps.select("part", "at.filter_order", "at.step", *[tally[c].alias(c) for c in numbers])
