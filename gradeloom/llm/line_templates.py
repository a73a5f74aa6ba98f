"""Recurring lines across documents, found by a log-template tree.

A line is parsed at fixed depth: its number of tokens, then its leading tokens (tokens with
a digit count as variable from the start) lead to a leaf. Within a leaf the rest of the line
is cut into segments, and templates are the line as it is and the line with one segment
generalised to a variable field. A template that stands in enough documents is recurring;
the first document that has it keeps its line, the others lose theirs.

The tree is a chain of hashed keys, so a leaf is never gathered: most lines stand in leaves
with too few lines to recur and are dropped after the first count, what remains is counted
by template. Texts are shuffled once, to take the lines out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import SPACES, stage, text_or_empty, whole_row

LEAD, SEGMENTS = 3, 4
#: Documents that make a template recurring, for lines with ``LONG`` tokens or more and for shorter ones.
LONG, DOCS_LONG, DOCS_SHORT = 8, 3, 20
VARIABLE = "<*>"
_HAS_DIGIT = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def parsed_lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Distinct lines with a token of every document: its key, line hash, leaf, and hashes of the segments."""
    text = text_or_empty(text_column)
    own = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{id_column}`"), text).alias("doc"), F.explode(F.array_distinct(_lines(text))).alias("line"))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", _HAS_DIGIT, VARIABLE)).otherwise(F.col("line"))
    tokens = own.select("id", "doc", F.xxhash64("line").alias("line"), F.array_remove(F.split(masked, SPACES), "").alias("tokens")).withColumn("n", F.size("tokens"))
    rest = F.col("n") - LEAD
    at = [(F.lit(k) * rest / SEGMENTS).cast("int") for k in range(SEGMENTS + 1)]
    segments = [F.xxhash64(F.slice("tokens", LEAD + 1 + at[k], at[k + 1] - at[k])) for k in range(SEGMENTS)]
    long = F.col("n") >= LONG
    return tokens.filter("n > 0").select(
        "id",
        "doc",
        "line",
        "n",
        F.xxhash64("n", F.slice("tokens", 1, LEAD)).alias("leaf"),
        *[F.when(long, s).otherwise(F.xxhash64("tokens") if k == 0 else F.lit(0).cast("long")).alias(f"s{k}") for k, s in enumerate(segments)],
    )


def _templates() -> Column:
    """Keys of a line's templates, of 128 bits: as it is, and with each segment generalised for long lines."""
    names = [f"s{k}" for k in range(SEGMENTS)]
    key = lambda *parts: F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(*reversed(parts)).alias("b"))
    exact = key(F.col("leaf"), F.lit(-1), *map(F.col, names))
    open_ = [key(F.col("leaf"), F.lit(k), *[F.col(n) for n in names if n != f"s{k}"]) for k in range(SEGMENTS)]
    return F.when(F.col("n") >= LONG, F.array(exact, *open_)).otherwise(F.array(exact))


def recurring_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", docs_long: int = DOCS_LONG, docs_short: int = DOCS_SHORT) -> DataFrame:
    """``doc`` (hash of id and text) and ``line`` (hash) of the lines that recur and are not the first of their template."""
    lines = stage(parsed_lines(docs, id_column, text_column), "lines")
    needed = F.when(F.col("n") >= LONG, docs_long).otherwise(docs_short)
    # written, as the keepers below, so that Spark can split the lines of a very common leaf
    leaves = stage(lines.groupBy("leaf").agg(F.count("*").alias("found"), F.first("n").alias("n")).filter(F.col("found") >= needed).select("leaf"), "leaves")
    crowded = lines.join(leaves, "leaf", "left_semi").select("id", "doc", "line", "n", F.explode(_templates()).alias("template"))
    crowded = stage(crowded, "templates")
    once = crowded.groupBy("template", "doc").agg(F.first("n").alias("n"), F.min(F.struct(F.col("id").isNull(), "id", "doc")).alias("place"))
    counted = once.groupBy("template").agg(F.count("*").alias("docs"), F.first("n").alias("n"), F.min("place").alias("first"))
    # written, so that the join below has two plain sides and Spark can split the documents of a very common line
    recurring = stage(counted.filter(F.col("docs") >= needed).select("template", F.col("first.doc").alias("keeper")), "recurring")
    return crowded.join(recurring, "template").filter("doc <> keeper").select("doc", "line").distinct()


def without_recurring_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with recurring lines taken out of the text; adds ``n_lines`` and ``n_dropped``.

    Lines are what stands between line feeds; lines without a token stay. A null text stays
    null and has no lines. Rows that agree in id and text are one document; the first
    document of a template is the one with the smallest id (nulls last, ties by a hash).
    Columns named ``n_lines`` or ``n_dropped`` are replaced. An empty table gives no rows.
    """
    gone = recurring_lines(docs, id_column, text_column, **options).groupBy("doc").agg(F.collect_list("line").alias("gone"))
    text = F.col("text")
    own = docs.select(
        whole_row(docs).alias("row"), text_or_empty(text_column).alias("text"), F.xxhash64(F.col(f"`{id_column}`"), text_or_empty(text_column)).alias("doc")
    )
    joined = own.join(gone, "doc", "left")
    kept = F.filter(_lines(text), lambda line: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), F.xxhash64(line)))
    cleaned = joined.select("row", "text", F.when(F.col("gone").isNotNull(), kept).alias("kept"))
    changed = F.col("kept").isNotNull()
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns[text_column] = F.when(changed, F.array_join("kept", "\n")).otherwise(columns[text_column])
    columns["n_lines"] = F.when(F.col(f"row.`{text_column}`").isNull(), 0).otherwise(F.size(_lines(text))).cast("long")
    columns["n_dropped"] = F.when(changed, F.size(_lines(text)) - F.size("kept")).otherwise(0).cast("long")
    return cleaned.select(*[c.alias(n) for n, c in columns.items()])
