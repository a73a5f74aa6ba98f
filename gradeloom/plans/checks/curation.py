"""Formatting, filters, lint reports, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.scalars import owner_of, stamp_to_timestamp, timestamp_to_stamp
from gradeloom.operators import curate
from gradeloom.operators.profile import column_profile
from gradeloom.plans.checks.tables import EVENTS, events, submissions, table
from gradeloom.session import scratch_path

# documents have no license; their source stands in for one
ALLOWED = ["src0", "src1", "src2", "src3", "src4", "src5"]
ALLOWED_SQL = "('src0', 'src1', 'src2', 'src3', 'src4', 'src5')"
DIRECTIVES = ["[Ll]icen[cs]e", "https?://"]


def _corpus(spark, folder):
    return curate.format_corpus(table(spark, folder, "documents"), "n_chars", ("lang",))


def format_corpus(spark, folder):
    return _corpus(spark, folder).select("doc_id", "source", "NUM_CHARS")


def allowlist(spark, folder):
    return curate.allow_licenses(_corpus(spark, folder), "source", ALLOWED).select("doc_id", "source")


def quantile_trim(spark, folder):
    """The quantile is taken of what the allowlist leaves."""
    kept = curate.allow_licenses(_corpus(spark, folder), "source", ALLOWED)
    return curate.trim_below_quantile(kept).select("doc_id", "NUM_CHARS")


def fixed_trim(spark, folder):
    return curate.trim_below(_corpus(spark, folder), "NUM_CHARS", 5000).select("doc_id", "NUM_CHARS")


def directives(spark, folder):
    return curate.exclude_directives(_corpus(spark, folder), DIRECTIVES).select("doc_id", "source")


def _scored(spark, folder):
    # k = 0 stands for a submission that could not be scored
    return events(spark, folder).withColumn("score", F.when(F.col("k") == 0, F.lit(-1.0)).otherwise(F.col("k")))


def unscored(spark, folder):
    kept = curate.drop_unscored(_scored(spark, folder), "score")
    return kept.select("event_id", curate.unscored_to_null(F.col("score")).alias("score"))


def lint_reports(spark, folder):
    """Every event as a lint report; some fatal, some with errors, some broken."""
    k = F.col("k").cast("int")
    counts = F.create_map(
        F.lit("fatal"), (k < 5).cast("int"), F.lit("error"), F.when(k % 10 == 7, k).otherwise(0), F.lit("warning"), k
    )
    report = F.to_json(F.struct(F.struct(counts.alias("messageTypeCount"), F.col("value").alias("score")).alias("statistics")))
    broken = F.when(k == 50, F.lit("{broken")).otherwise(report)
    scored = curate.with_lint_score(events(spark, folder).withColumn("pylint_text", broken))
    return scored.select("event_id", "pylint_score")


def quarantine(spark, folder):
    """Reports that cannot be read: the events' props read as lint reports where k is odd."""
    rows = events(spark, folder).withColumn("pylint_text", F.when(F.col("k") % 2 == 1, F.lit("{")).otherwise(
        F.lit('{"statistics": {"messageTypeCount": {"fatal": 0, "error": 0}, "score": 5.0}}')))
    return curate.unreadable_reports(curate.with_lint_score(rows)).select("event_id", "user_id")


def quarantined_reports(spark, folder):
    """Every event in one of two sinks, written by one pass, whose counts add up."""
    good = F.lit('{"statistics": {"messageTypeCount": {"fatal": 0, "error": 0}, "score": 5.0}}')
    text = F.when(F.col("k") % 9 == 4, F.lit(None)).when(F.col("k") % 9 == 7, F.lit("{broken")).otherwise(good)
    rows = curate.with_lint_score(events(spark, folder).withColumn("pylint_text", text))
    kept, bad, counts = curate.quarantine(rows, curate.report_fault(), scratch_path(spark, "quarantine"))
    adds_up = counts["read"] == counts["kept"] + counts["quarantined"]
    both = kept.withColumn("fault", F.lit("")).unionByName(bad)
    return both.select("event_id", "fault", F.lit(adds_up).alias("adds_up"), F.lit(counts["read"]).alias("n_read"))


def json_columns(spark, folder):
    """The schema of the JSON is found from the data."""
    rows = table(spark, folder, "events")
    schema = curate.json_schema_of(rows, "props")
    return curate.expand_json(rows, "props", schema).select("event_id", "user_id", F.col("k").cast("bigint").alias("k"))


def training_names(spark, folder):
    rows = submissions(spark, folder).withColumnRenamed("model_version", "raw_code")
    return curate.for_training(rows).select("id", "text", "repo_name")


def profile(spark, folder):
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    found = column_profile(table(spark, folder, "customer"))
    sql_name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return found.withColumn("dtype", sql_name[F.col("dtype")])


def sample(spark, folder):
    return curate.sample_rows(table(spark, folder, "orders"), 200, "o_orderkey", 11).select("o_orderkey", "o_totalprice")


def owners(spark, folder):
    return table(spark, folder, "pages").select("page_id", owner_of(F.col("url")).alias("developer"))


def projection(spark, folder):
    return curate.project(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


def stamps(spark, folder):
    """Time stamps as text and back."""
    stamp = timestamp_to_stamp(F.col("ts"))
    return events(spark, folder).select(
        "event_id", stamp.alias("stamp"), F.unix_timestamp(stamp_to_timestamp(stamp)).alias("seconds")
    )


QUERIES = {
    "b1_format": format_corpus,
    "b2_license_allowlist": allowlist,
    "b3_quantile_trim": quantile_trim,
    "b4_fixed_trim": fixed_trim,
    "b5_directive_exclusion": directives,
    "b7_drop_unscored": unscored,
    "b8_lint_score": lint_reports,
    "b8_quarantine": quarantined_reports,
    "b8_unreadable_reports": quarantine,
    "b9_json_columns": json_columns,
    "b10_training_names": training_names,
    "b11_column_profile": profile,
    "b12_random_sample": sample,
    "b13_owner_from_path": owners,
    "b14_projection": projection,
    "j_time_stamps": stamps,
}

_PROFILE = " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", '{dtype}' AS dtype, count({name}) AS non_null, count(*) AS n_rows FROM customer"
    for name, dtype in [
        ("c_custkey", "BIGINT"), ("c_name", "VARCHAR"), ("c_nationkey", "INTEGER"), ("c_acctbal", "DOUBLE"), ("c_mktsegment", "VARCHAR"),
    ]
)

ORACLES = {
    "b1_format": "SELECT doc_id, source, CAST(n_chars AS BIGINT) AS \"NUM_CHARS\" FROM documents",
    "b2_license_allowlist": f"SELECT doc_id, source FROM documents WHERE source IN {ALLOWED_SQL}",
    "b3_quantile_trim": f"""
        WITH kept AS (SELECT doc_id, n_chars FROM documents WHERE source IN {ALLOWED_SQL})
        SELECT doc_id, CAST(n_chars AS BIGINT) AS "NUM_CHARS" FROM kept WHERE n_chars < (SELECT quantile_cont(n_chars, 0.99) FROM kept)""",
    "b4_fixed_trim": "SELECT doc_id, CAST(n_chars AS BIGINT) AS \"NUM_CHARS\" FROM documents WHERE n_chars < 5000",
    "b5_directive_exclusion": """
        SELECT doc_id, source FROM documents
        WHERE NOT regexp_matches(text, '[Ll]icen[cs]e') AND NOT regexp_matches(text, 'https?://')""",
    "b7_drop_unscored": f"SELECT event_id, k AS score FROM {EVENTS} WHERE k <> 0",
    "b8_quarantine": f"""
        SELECT event_id, CASE k % 9 WHEN 4 THEN 'missing report' WHEN 7 THEN 'unreadable report' ELSE '' END AS fault, true AS adds_up,
          CAST(count(*) OVER () AS INTEGER) AS n_read FROM {EVENTS}""",
    "b8_lint_score": f"""
        SELECT event_id, CASE WHEN k = 50 THEN NULL WHEN k < 5 OR k % 10 = 7 THEN CAST(-1 AS DOUBLE) ELSE value END AS pylint_score
        FROM {EVENTS}""",
    "b8_unreadable_reports": f"SELECT event_id, user_id FROM {EVENTS} WHERE k % 2 = 1",
    "b9_json_columns": f"SELECT event_id, user_id, CAST(k AS BIGINT) AS k FROM {EVENTS}",
    "b10_training_names": "SELECT event_id AS id, event_type AS text, CAST(user_id AS VARCHAR) AS repo_name FROM events",
    "b11_column_profile": _PROFILE,
    "b12_random_sample": """
        SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('11:' || o_orderkey), o_orderkey LIMIT 200""",
    "b13_owner_from_path": "SELECT page_id, split_part(url, '/', 1) AS developer FROM pages",
    "b14_projection": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem",
    "j_time_stamps": """
        SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S_UTC') AS stamp, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""",
}
