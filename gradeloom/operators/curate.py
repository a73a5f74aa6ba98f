"""Corpus curation: formatting, filters, lint reports, samples."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from gradeloom.fixed_values import LINT_DIRECTIVES, SAFE_LICENSES
from gradeloom.operators.ordered import exact_quantiles
from gradeloom.operators.split import NULL_KEY, order_boundary
from gradeloom.schemas import LINT_REPORT


def format_corpus(df: DataFrame, size: str = "size", drop: tuple[str, ...] = ("language", "score")) -> DataFrame:
    """Drop what is not needed and give the size its name and type."""
    return df.drop(*drop).withColumnRenamed(size, "NUM_CHARS").withColumn("NUM_CHARS", F.col("NUM_CHARS").cast("bigint"))


def allow_licenses(df: DataFrame, column: str = "license", allowed: list[str] = SAFE_LICENSES) -> DataFrame:
    """Exact, case-sensitive; a missing license is not allowed."""
    return df.filter(F.col(column).isin(allowed))


def trim_below_quantile(df: DataFrame, column: str = "NUM_CHARS", share: float = 0.99) -> DataFrame:
    """Keep rows strictly below the exact quantile of the column.

    The quantile is looked up first, so the filter is a comparison with a
    constant and is pushed into the scan.
    """
    limit = exact_quantiles(df, column, [share])[0]
    if limit is not None and dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint"):
        limit = math.ceil(limit)  # the same rows, without a cast that would keep the filter from the scan
    return df.filter(F.col(column) < F.lit(limit))


def trim_below(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.filter(F.col(column) < limit)


def exclude_directives(df: DataFrame, patterns: list[str] = LINT_DIRECTIVES, text: str = "text") -> DataFrame:
    """Drop files in which any pattern (a regular expression) is found, and files without text."""
    clean = reduce(lambda a, b: a & b, [~F.col(text).rlike(p) for p in patterns], F.col(text).isNotNull())
    return df.filter(clean)


def drop_unscored(df: DataFrame, column: str, marker: float = -1) -> DataFrame:
    return df.filter(F.col(column) != marker)


def unscored_to_null(column: Column, marker: float = -1) -> Column:
    return F.nullif(column, F.lit(marker))


def with_lint_score(df: DataFrame, report: str = "pylint_text", name: str = "pylint_score") -> DataFrame:
    """Score of a lint report: -1 with any fatal or error message, null where it cannot be read."""
    parsed = F.from_json(F.col(report), LINT_REPORT)["statistics"]
    counts = parsed["messageTypeCount"]
    failed = (counts["fatal"] > 0) | (counts["error"] > 0)
    return df.withColumn(name, F.when(failed, F.lit(-1.0)).when(~failed, parsed["score"]))


def unreadable_reports(df: DataFrame, name: str = "pylint_score") -> DataFrame:
    """The rows whose report could not be read, for quarantine."""
    return df.filter(F.col(name).isNull())


def report_fault(report: str = "pylint_text", name: str = "pylint_score") -> Column:
    """Why a row has no lint score: ``missing report`` or ``unreadable report``; null where it has one."""
    return F.when(F.col(report).isNull(), "missing report").when(F.col(name).isNull(), "unreadable report")


def quarantine(df: DataFrame, fault: Column, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """One pass into two sinks: rows without a fault, and rows with one in column ``fault``.

    Both are written below ``path`` from a single evaluation of ``df`` and read back; an
    earlier content of ``path`` is replaced. The third value says how many rows were
    ``read``, ``kept`` and ``quarantined``, counted while they were written.
    """
    seen = Observation()
    marked = df.withColumn("fault", fault)
    counted = marked.observe(
        seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col("fault").isNull()).alias("kept"), F.count_if(F.col("fault").isNotNull()).alias("quarantined")
    )
    tagged = counted.withColumn("sink", F.when(F.col("fault").isNull(), "kept").otherwise("quarantined"))
    tagged.write.mode("overwrite").partitionBy("sink").parquet(path)
    rows = df.sparkSession.read.schema(tagged.schema).parquet(path)
    kept = rows.filter("sink = 'kept'").drop("sink", "fault")
    return kept, rows.filter("sink = 'quarantined'").drop("sink"), dict(seen.get)


def expand_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON keys become columns of the same row; nothing can shift between rows."""
    parsed = F.from_json(F.col(column), schema)
    kept = [c for c in df.columns if c != column]
    return df.withColumn("_parsed", parsed).select(*kept, "_parsed.*")


def expand_map(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Map keys become columns of the same row."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, *[F.col(column)[k].alias(k) for k in keys])


def json_schema_of(df: DataFrame, column: str) -> str:
    """Schema of a JSON column, merged over all its values by one aggregate."""
    variant = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column)))).first()[0]
    return variant.replace("OBJECT<", "STRUCT<")


def for_training(df: DataFrame) -> DataFrame:
    """Submission columns under the names the corpus uses."""
    return df.withColumnsRenamed({"raw_code": "text", "user_id": "repo_name"}).withColumn(
        "repo_name", F.col("repo_name").cast("string")
    )


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) without replacement, repeatable for a seed.

    Rows are taken in the order of a hash of their key, then of the key, then of the whole
    row. The place of the last key is looked up from counts, so a sample of any size is a
    filter; whole rows are hashed only among those that share this key, and of rows that
    are equal in every column as many as are missing are added. Null keys are rows like
    any other.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY))
    place = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), text)), text)
    last = order_boundary(df, place, n)
    if last is None:
        return df.limit(0)
    before, ties = df.filter(place < last), df.filter(place == last)
    counts = df.agg(F.count_if(place < last).alias("before"), F.count_if(place == last).alias("ties")).first()
    missing = n - counts["before"]
    if missing >= counts["ties"]:
        return df.filter(place <= last)
    whole = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    edge = order_boundary(ties, whole, missing)
    equal = ties.filter(whole == edge)
    missing -= ties.filter(whole < edge).count()
    one = equal.agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
    repeated = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(missing)))).select("row.*")
    return before.unionByName(ties.filter(whole < edge)).unionByName(repeated)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)
