"""Line features, and the flagship query on curated documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.scalars import character_limit, with_over_limit
from gradeloom.functions.text import with_line_features
from gradeloom.operators import curate
from gradeloom.plans.checks.curation import DIRECTIVES
from gradeloom.plans.checks.tables import documents, table

LINE_BREAK_SQL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
FILLED_SQL = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lines_sql(relation: str, columns: str) -> str:
    """The line features of a relation with ``text``, in SQL."""
    return f"""
      (SELECT {columns}, len(ls) AS lines, len(ls) - len(filled) AS empty_lines, len(filled) AS effective_lines,
              length(text) AS characters,
              len(filled) / nullif(len(ls), 0) AS code_compactness,
              coalesce(list_aggregate(filled, 'stddev_pop'), 0) AS line_length_std,
              len([x FOR x IN ls IF length(x) > 100]) AS long_lines,
              len([x FOR x IN ls IF length(x) > 100]) / nullif(len(filled), 0) AS long_line_ratio,
              length(text) / nullif(len(ls), 0) AS chars_per_line
       FROM (SELECT *, [length(x) FOR x IN ls IF regexp_matches(x, '{FILLED_SQL}')] AS filled
             FROM (SELECT *, CASE WHEN text = '' THEN [] WHEN parts[len(parts)] = '' THEN parts[1:len(parts)-1] ELSE parts END AS ls
                   FROM (SELECT *, string_split_regex(text, '{LINE_BREAK_SQL}') AS parts FROM {relation}))))"""


def line_features(spark, folder):
    return with_line_features(documents(spark, folder)).select(
        "doc_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("lines", "empty_lines", "effective_lines", "characters", "long_lines")],
        *[F.round(c, 6).alias(c) for c in ("code_compactness", "line_length_std", "long_line_ratio", "chars_per_line")],
    )


def char_limit(spark, folder):
    logged = table(spark, folder, "documents").select(F.log1p(F.length("text")).alias("characters"))
    return character_limit(logged)


def over_limit(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", F.length("text").alias("characters"))
    return with_over_limit(docs, character_limit(docs, logged=False)).select("doc_id", "over_limit")


def curated_summary(spark, folder):
    """Curate, measure the lines, log and flag, then describe each language."""
    corpus = curate.format_corpus(documents(spark, folder), "n_chars", ())
    kept = curate.exclude_directives(curate.trim_below_quantile(corpus), DIRECTIVES)
    measured = with_line_features(kept).select(
        "lang",
        F.log1p("characters").alias("characters"),
        F.log1p("line_length_std").alias("line_length_std"),
        F.col("code_compactness"),
        (F.col("long_line_ratio") > 0).cast("double").alias("long_line"),
    )
    numbers = ["characters", "line_length_std", "code_compactness", "long_line"]
    return measured.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in numbers]
    )


QUERIES = {
    "c1_line_features": line_features,
    "c7_character_limit": char_limit,
    "c8_over_limit": over_limit,
    "curated_line_summary": curated_summary,
}

ORACLES = {
    "c1_line_features": f"""
        SELECT doc_id, lines, empty_lines, effective_lines, characters, long_lines, round(code_compactness, 6) AS code_compactness,
               round(line_length_std, 6) AS line_length_std, round(long_line_ratio, 6) AS long_line_ratio, round(chars_per_line, 6) AS chars_per_line
        FROM {lines_sql('documents', 'doc_id')}""",
    "c7_character_limit": """
        SELECT CAST(round_even(CAST(m AS DOUBLE), -3) AS BIGINT) AS char_limit
        FROM (SELECT CAST(trunc(exp(max(ln(1 + length(text)))) - 1) AS BIGINT) AS m FROM documents)""",
    "c8_over_limit": """
        SELECT doc_id, length(text) > (SELECT CAST(round_even(CAST(max(length(text)) AS DOUBLE), -3) AS BIGINT) FROM documents) AS over_limit
        FROM documents""",
    "curated_line_summary": f"""
        SELECT lang, count(*) AS n, round(avg(ln(1 + characters)), 6) AS avg_characters, round(avg(ln(1 + line_length_std)), 6) AS avg_line_length_std,
               round(avg(code_compactness), 6) AS avg_code_compactness, round(avg(CASE WHEN long_line_ratio > 0 THEN 1.0 ELSE 0.0 END), 6) AS avg_long_line
        FROM {lines_sql('''(SELECT * FROM documents WHERE n_chars < (SELECT quantile_cont(n_chars, 0.99) FROM documents)
             AND NOT regexp_matches(text, '[Ll]icen[cs]e') AND NOT regexp_matches(text, 'https?://'))''', 'lang')}
        GROUP BY lang""",
}
