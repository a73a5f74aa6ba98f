"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents, in an order shuffled by a seeded hash, at a rate in
proportion to its target. A document that is served when its source has served ``c`` tokens
in all finishes at the virtual time ``c / target``. The mix is the global order of these
finish times, cut off where the total budget is used up: documents are range-sorted by
finish time, summed up in that order and truncated at the budget. A document in service at
virtual time 1, when sources have had their targets, is two pieces in that order, so every
source meets its target to the token. A source whose target is above its size starts over
with its first document.

Running sums are taken in two steps, over hash buckets of a source and then within a
bucket, so a source that holds a third of all rows is not summed in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import SPACES, WORDS, text_or_empty, whole_row, word_count
from gradeloom.operators.ordered import running_totals

#: Each source has two to this power hash buckets.
BUCKET_BITS = 12


def source_targets(sizes: DataFrame, source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources from their sizes (columns ``source`` and ``source_size``), one row for each.

    Sources in the order of code points, null last, take the ``weights`` in turn and divide
    ``share`` times all sizes by them. A target stops at ``most`` times its source's size
    and the excess goes to the others by weight, until none is above: sources below the
    level at which the cap binds get their cap, the rest one rate times their weight. The
    table has a row for each source, so windows over all of it are windows over few rows.
    """
    by_name = Window.orderBy(F.col(source).isNull(), F.col(source))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.select(source, "source_size", weight.alias("weight")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = [F.col("cap") / F.col("weight"), F.col(source).isNull(), F.col(source)]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rated = ranked.withColumns({
        "rate": (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(rest),
        "limit": F.col("cap") / F.col("weight"),
    })
    # the level is the first rate that its own and all later caps allow; without one all are at their cap
    level = F.first(F.when(F.col("rate") <= F.col("limit"), F.col("rate")), ignorenulls=True).over(
        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return rated.withColumn("level", level).select(
        source,
        "source_size",
        F.when((F.col("limit") < F.col("level")) | F.col("level").isNull(), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"),
    )


def schedule(docs: DataFrame, source: str = "source", size: Column | None = None, key: Sequence[str] = ("doc_id",), seed: int = 17, passes: int = 2, **targets) -> DataFrame:
    """What the mix takes of every row of ``docs``, one row for each.

    Columns: ``doc`` (the row as a struct, so its names cannot clash), ``row`` (a name for it
    that no other row has), ``size``, ``source_size``, ``target`` and ``turns``, an array with ``pass`` (from 0), ``finish``
    (virtual time at which the document is through) and ``taken`` (tokens of this pass,
    0 once its source has had its target). The shuffle orders rows by a hash of ``key`` (of the
    whole row where that is null), then by ``key`` and the whole row, so null and repeated keys
    and repeated rows count one by one and reruns agree. Null sources are one source, null texts have size 0, an empty table
    gives no rows. ``passes`` has to be at least ``most`` of the targets.
    """
    size = word_count(text_or_empty()) if size is None else size
    name = F.col(f"`{source}`")
    # 60 bits of MD5, which SQL engines agree on
    known = F.array_compact(F.array(*[F.col(f"`{k}`").cast("string") for k in key]))
    shuffled = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.when(F.size(known) > 0, known).otherwise(F.array(F.xxhash64(whole_row(docs)).cast("string"))))), 1, 15), 16, 10).cast("long")
    sized = docs.select(
        whole_row(docs).alias("doc"),
        size.cast("long").alias("size"),
        name.isNull().alias("nosource"),
        F.coalesce(name, F.lit("")).alias("named"),
        shuffled.alias("place"),
        F.shiftright(shuffled, 60 - BUCKET_BITS).cast("int").alias("bucket"),
    )
    group = ["nosource", "named", "bucket"]
    buckets = sized.groupBy(*group).agg(F.sum("size").alias("bucket_size"))
    per_source = buckets.groupBy("nosource", "named").agg(F.sum("bucket_size").alias("source_size"))
    target = source_targets(per_source.withColumn("source", F.when(~F.col("nosource"), F.col("named"))), **targets).select(
        F.col("source").isNull().alias("nosource"), F.coalesce("source", F.lit("")).alias("named"), "source_size", "target"
    )
    in_front = Window.partitionBy("nosource", "named").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*group, F.coalesce(F.sum("bucket_size").over(in_front), F.lit(0)).alias("bucket_start")).join(target, ["nosource", "named"])
    ranked = Window.partitionBy(*group).orderBy("place", *[F.col(f"doc.`{k}`") for k in key], F.xxhash64("doc"))
    inside = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    served = sized.withColumns({"upto": F.sum("size").over(inside), "number": F.row_number().over(ranked)}).join(starts, group)

    def turn(number):
        begin = F.col("bucket_start") + F.col("upto") - F.col("size") + number * F.col("source_size")
        return F.struct(
            number.alias("pass"),
            F.when(F.col("target") > 0, (begin + F.col("size")) / F.col("target")).alias("finish"),
            F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - begin)).cast("long").alias("taken"),
        )

    row = F.struct(*group, "number").alias("row")
    return served.select("doc", row, "size", "source_size", "target", F.array(*[turn(F.lit(p)) for p in range(passes)]).alias("turns"))


def truncated(plan: DataFrame) -> DataFrame:
    """What the global order of finish times keeps within the budget: ``row``, ``taken`` and ``position``, one row for each of the ``plan``.

    The budget is the sum of the whole tokens of all targets. ``position`` is where the document's
    first token stands in the mix, null if it has none. Only names and numbers are sorted.
    """
    budget = plan.groupBy("row.nosource", "row.named").agg(F.first("target").alias("target")).agg(F.sum(F.floor("target"))).scalar()
    turn = F.col("turn")
    # a document in service when its source has had its target is cut there; what is behind comes later than all that is not
    pieces = F.array(
        F.struct(F.when(turn["taken"] < F.col("size"), F.least(turn["finish"], F.lit(1.0))).otherwise(turn["finish"]).alias("finish"), F.lit(False).alias("late"), turn["taken"].alias("tokens")),
        F.struct(turn["finish"].alias("finish"), F.lit(True).alias("late"), (F.col("size") - turn["taken"]).alias("tokens")),
    )
    queue = plan.select("row", "size", F.explode("turns").alias("turn")).select("row", "turn.pass", F.explode(F.filter(pieces, lambda p: p["tokens"] > 0)).alias("piece"))
    queue = queue.select("row.*", "pass", "piece.*")
    order = ["finish", "late", "nosource", "named", "bucket", "number", "pass"]
    summed = running_totals(queue, [], order, {"upto": F.col("tokens")})
    before = F.col("upto") - F.col("tokens")
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("tokens"), budget - before))
    kept = summed.select(F.struct("nosource", "named", "bucket", "number").alias("row"), taken.alias("taken"), F.when(taken > 0, before).alias("position"))
    every = kept.unionByName(plan.select("row", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("position")))
    return every.groupBy("row").agg(F.sum("taken").alias("taken"), F.min("position").alias("position"))


def taken_words(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda total, turn: total + turn["taken"])


def first_words(text: Column, count: Column) -> Column:
    """A text up to the end of its word ``count``, white space untouched."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"(?:{SPACES})?{WORDS}"), F.lit(0)), F.lit(1), count.cast("int")), "")


def mix(docs: DataFrame, source: str = "source", key: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """The documents of the mix, range-sorted by finish time, with the columns of ``docs``.

    A document that is taken in two passes comes twice. Of a document that is served in
    part only the words served are kept (and ``n_chars`` follows, where there is one).
    Documents without words take nothing and are not in the mix.
    """
    turns = schedule(docs, source, key=key, **options).select("doc", "size", F.explode(F.filter("turns", lambda t: t["taken"] > 0)).alias("turn"))
    ordered = turns.orderBy("turn.finish", f"doc.`{source}`", *[f"doc.`{k}`" for k in key])
    partly = F.col("turn.taken") < F.col("size")
    text = F.when(partly, first_words(F.col("doc.text"), F.col("turn.taken"))).otherwise(F.col("doc.text"))
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(partly, F.char_length(text)).otherwise(columns["n_chars"]).cast(dict(docs.dtypes)["n_chars"])
    return ordered.select(*[column.alias(c) for c, column in columns.items()])
