"""Profiles, histograms, metrics and joins of plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import evaluate, profile
from gradeloom.operators.curate import exclude_directives
from gradeloom.operators.ordered import moving_mean, with_rank
from gradeloom.operators.retraining import combine, with_decay_weight
from gradeloom.operators.split import with_split
from gradeloom.plans.checks.tables import EVENTS, events, table
from gradeloom.session import stage

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PREDICTIONS = {"low": "low", "high": "high"}


def value_counts(spark, folder):
    return profile.value_counts(table(spark, folder, "documents"), "source")


def quantiles(spark, folder):
    return profile.quantiles(table(spark, folder, "documents"), "n_chars", [0.0, 0.25, 0.5, 0.99, 1.0]).select(
        "share", F.round("value", 6).alias("value")
    )


SPAN = [0.01, 0.25, 0.5, 0.9, 0.99]


def stored_sketches(spark, folder):
    """Quantiles of all documents from stored sketches of their parts: each has its rank, give or take the stated error."""
    docs, error = table(spark, folder, "documents"), 0.01
    sketches = stage(profile.quantile_sketches(docs, ["n_chars"], ["lang", "source"], error), "sketches")
    found = profile.merged_quantiles(sketches, SPAN).collect()  # a row for each share
    below = docs.agg(*[F.struct(F.count_if(F.col("n_chars") < r["value"]).alias("lo"), F.count_if(F.col("n_chars") <= r["value"]).alias("hi")).alias(str(i)) for i, r in enumerate(found)])
    inside = lambda i, r: (F.col(f"{i}.lo") <= (r["share"] + error) * r["n"]) & (F.col(f"{i}.hi") >= (r["share"] - error) * r["n"])
    return below.select(F.inline(F.array(*[F.struct(F.lit(r["share"]).alias("share"), F.lit(r["n"]).alias("n"), inside(i, r).alias("inside")) for i, r in enumerate(found)])))


def histogram(spark, folder):
    return _edges(profile.histogram(table(spark, folder, "documents"), "n_chars", 400))


def _edges(df):
    return df.withColumns({c: F.round(c, 6) for c in ("lo", "hi")})


def histogram_by_score(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    # quality has two values, so the score is made finer with the document's number
    scored = docs.withColumn("score", F.col("quality") * 10 + F.col("doc_id") % 7)
    return _edges(profile.histogram_by_score(scored, "n_chars", "score", 200))


def skewness(spark, folder):
    return profile.skewness(table(spark, folder, "lineitem"), NUMBERS).select("column", F.round("skewness", 6).alias("skewness"))


def correlations(spark, folder):
    return profile.correlations(table(spark, folder, "lineitem"), NUMBERS).withColumn("correlation", F.round("correlation", 6))


def _predicted(spark, folder):
    return table(spark, folder, "lineitem").withColumns(
        {"low": F.col("l_quantity") * 1400 + 2000, "high": F.col("l_quantity") * 1600 * (1 - F.col("l_discount"))}
    )


def _rounded(df, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in ("mae", "rmse", "r2")})


def metrics(spark, folder):
    return _rounded(evaluate.metrics(_predicted(spark, folder), "l_extendedprice", "low", ["l_returnflag"]))


def metrics_text(spark, folder):
    return evaluate.metrics_as_text(evaluate.metrics(_predicted(spark, folder), "l_extendedprice", "low"))


def mean_baseline(spark, folder):
    marked = with_split(table(spark, folder, "orders"), "o_custkey", 0.3, 2)
    return _rounded(evaluate.mean_baseline(marked, "o_totalprice"))


def residual_bins(spark, folder):
    df = evaluate.with_error(_predicted(spark, folder), "l_extendedprice", "low")
    binned = evaluate.residual_bins(df, "low", "error", 12)
    return binned.select("bin", "n", *[F.round(c, 4).alias(c) for c in ("mean_error", "min_error", "max_error")])


def top_k(spark, folder):
    df = table(spark, folder, "orders").withColumn("error", F.col("o_totalprice") - 250000)
    return evaluate.top_k(df, "error", 50, "o_orderkey").select("kind", "o_orderkey", "error")


def compare_versions(spark, folder):
    return _rounded(evaluate.compare_versions(_predicted(spark, folder), "l_extendedprice", PREDICTIONS))


def weight_summary(spark, folder):
    cutoff = F.lit("2024-02-01 00:00:00").cast("timestamp")
    weighted = with_decay_weight(events(spark, folder), cutoff, created_at="ts")
    return profile.weight_summary(weighted).select(*[F.round(c, 9).alias(c) for c in ("min", "max", "mean")])


def smoothed(spark, folder):
    rows = events(spark, folder).select("event_id", "event_type", "value", (F.col("k") - 50).alias("s"))
    ranked = with_rank(rows, ["event_type"], ["value", "event_id"])
    return moving_mean(ranked, ["event_type"], "s", 4).select("event_id", "rank", F.round("smooth", 6).alias("smooth"))


def union_common(spark, folder):
    """Open and closed orders with different columns, united on the common ones."""
    orders = table(spark, folder, "orders")
    old = orders.filter("o_orderstatus = 'F'").drop("o_orderpriority")
    new = orders.filter("o_orderstatus <> 'F'").drop("o_orderdate")
    return combine(old, new)


def set_operations(spark, folder):
    """Customers with large orders, of them those that also have small ones, and those that have not."""
    orders = table(spark, folder, "orders")
    large = orders.filter("o_totalprice > 400000").select("o_custkey").distinct()
    small = orders.filter("o_totalprice < 50000").select("o_custkey").distinct()
    return large.intersect(small).withColumn("kind", F.lit("both")).unionByName(large.subtract(small).withColumn("kind", F.lit("large only")))


def totals(spark, folder):
    return profile.submission_totals(table(spark, folder, "events"))


def labelled_documents(spark, folder):
    """Documents with their labels, if any."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left")


def customers_without_orders(spark, folder):
    keys = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").join(keys, "c_custkey", "left_anti").select("c_custkey", "c_name")


def flagged_documents(spark, folder):
    """What directive exclusion leaves, per source."""
    kept = exclude_directives(table(spark, folder, "documents"), ["copyright", "[Ll]icen[cs]e"])
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "f1_value_counts": value_counts,
    "f2_quantiles": quantiles,
    "f2_stored_sketches": stored_sketches,
    "f3_histogram": histogram,
    "f4_histogram_by_score": histogram_by_score,
    "f5_skewness": skewness,
    "f6_correlations": correlations,
    "f7_metrics": metrics,
    "f7_metrics_text": metrics_text,
    "f8_mean_baseline": mean_baseline,
    "f9_residual_bins": residual_bins,
    "f10_top_k": top_k,
    "f12_weight_summary": weight_summary,
    "f14_moving_mean": smoothed,
    "f17_union_common_columns": union_common,
    "f18_set_operations": set_operations,
    "f19_totals": totals,
    "g11_compare_versions": compare_versions,
    "e1_labelled_documents": labelled_documents,
    "e3_anti_join": customers_without_orders,
    "b5_excluded_by_source": flagged_documents,
}


def _histogram_sql(relation: str, column: str, bins: int, group: str = "") -> str:
    keys = f"{group}, " if group else ""
    same = f"r.{group} = b.{group} AND " if group else ""
    by = f"GROUP BY {group}" if group else ""
    joined = f"JOIN r ON r.{group} = v.{group}" if group else "CROSS JOIN r"
    prefix = f"v.{group}, " if group else ""
    left = f"r.{group}, " if group else ""
    return f"""
        WITH v AS (SELECT {keys}CAST({column} AS DOUBLE) AS x FROM {relation}),
        r AS (SELECT {keys}min(x) AS a, (max(x) - min(x)) / {bins} AS w FROM v {by}),
        b AS (SELECT {prefix}CAST(least(floor((x - a) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM v {joined} GROUP BY ALL)
        SELECT {left}CAST(g.bin AS INTEGER) AS bin, round(a + g.bin * w, 6) AS lo, round(a + (g.bin + 1) * w, 6) AS hi, coalesce(b.n, 0) AS n
        FROM r CROSS JOIN range({bins}) AS g(bin) LEFT JOIN b ON {same}b.bin = g.bin"""


_PREDICTED_SQL = "(SELECT *, l_quantity * 1400 + 2000 AS low, l_quantity * 1600 * (1 - l_discount) AS high FROM lineitem)"


def _metrics_sql(label: str, prediction: str, digits: int = 4) -> str:
    error = f"({label} - {prediction})"
    return f"""round(avg(abs({error})), {digits}) AS mae, round(sqrt(avg({error} * {error})), {digits}) AS rmse,
               round(1 - sum({error} * {error}) / (var_pop({label}) * count(*)), {digits}) AS r2"""


ORACLES = {
    "f1_value_counts": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "f2_stored_sketches": f"SELECT CAST(share AS DOUBLE) AS share, CAST(n AS INTEGER) AS n, true AS inside FROM (SELECT unnest({SPAN}) AS share), (SELECT count(n_chars) AS n FROM documents)",
    "f2_quantiles": " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS share, round(CAST(quantile_cont(n_chars, {p}) AS DOUBLE), 6) AS value FROM documents"
        for p in (0.0, 0.25, 0.5, 0.99, 1.0)
    ),
    "f3_histogram": _histogram_sql("documents", "n_chars", 400),
    "f4_histogram_by_score": _histogram_sql(
        """(SELECT n_chars, s > (SELECT median(quality * 10 + doc_id % 7) FROM labels JOIN documents USING (doc_id)) AS high_score
            FROM (SELECT n_chars, quality * 10 + doc_id % 7 AS s FROM documents JOIN labels USING (doc_id)))""",
        "n_chars", 200, "high_score",
    ),
    "f5_skewness": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(skewness({c}), 6) AS skewness FROM lineitem" for c in NUMBERS),
    "f6_correlations": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a in NUMBERS for b in NUMBERS
    ),
    "f7_metrics": f"SELECT l_returnflag, {_metrics_sql('l_extendedprice', 'low')} FROM {_PREDICTED_SQL} GROUP BY l_returnflag",
    "f7_metrics_text": f"""
        SELECT printf('%.3f', mae) AS mae, printf('%.3f', rmse) AS rmse, printf('%.3f', r2) AS r2
        FROM (SELECT {_metrics_sql('l_extendedprice', 'low', 9)} FROM {_PREDICTED_SQL})""",
    "f8_mean_baseline": f"""
        WITH g AS (SELECT k, row_number() OVER (ORDER BY md5('2:' || k), CAST(k AS VARCHAR)) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders)),
        m AS (SELECT *, n <= ceil(0.3 * (SELECT count(*) FROM g)) AS is_test FROM orders JOIN g ON o_custkey = k),
        p AS (SELECT *, (SELECT avg(o_totalprice) FROM m WHERE NOT is_test) AS prediction FROM m)
        SELECT is_test, {_metrics_sql('o_totalprice', 'prediction')} FROM p GROUP BY is_test""",
    "f9_residual_bins": f"""
        WITH r AS (SELECT min(low) AS a, (max(low) - min(low)) / 12 AS w FROM {_PREDICTED_SQL})
        SELECT CAST(greatest(least(floor((low - a) / w), 11), 0) AS INTEGER) AS bin, count(*) AS n,
               round(avg(l_extendedprice - low), 4) AS mean_error, round(min(l_extendedprice - low), 4) AS min_error,
               round(max(l_extendedprice - low), 4) AS max_error
        FROM {_PREDICTED_SQL} CROSS JOIN r GROUP BY ALL""",
    "f10_top_k": """
        WITH e AS (SELECT o_orderkey, o_totalprice - 250000 AS error FROM orders)
        (SELECT 'top_performing' AS kind, * FROM e ORDER BY abs(error), o_orderkey LIMIT 50)
        UNION ALL (SELECT 'over_estimated', * FROM e ORDER BY error, o_orderkey LIMIT 50)
        UNION ALL (SELECT 'under_estimated', * FROM e ORDER BY error DESC, o_orderkey LIMIT 50)""",
    "f12_weight_summary": """
        WITH w AS (SELECT exp(-ln(2) / 30 * (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 86400000000.0) AS w FROM events)
        SELECT round(min(w), 9) AS "min", round(max(w), 9) AS "max", round(avg(w), 9) AS mean FROM w""",
    "f14_moving_mean": f"""
        SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rank,
               round(sum(k - 50) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 6) AS smooth
        FROM {EVENTS}""",
    "f17_union_common_columns": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderstatus <> 'F' AS is_new FROM orders",
    "f18_set_operations": """
        WITH l AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000),
             s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice < 50000)
        SELECT o_custkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM s) THEN 'both' ELSE 'large only' END AS kind FROM l""",
    "f19_totals": "SELECT count(DISTINCT user_id) AS total_users, count(*) AS total_submissions FROM events",
    "g11_compare_versions": f"""
        SELECT 'low' AS version, {_metrics_sql('l_extendedprice', 'low')} FROM {_PREDICTED_SQL}
        UNION ALL SELECT 'high', {_metrics_sql('l_extendedprice', 'high')} FROM {_PREDICTED_SQL}""",
    "e1_labelled_documents": "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "e3_anti_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "b5_excluded_by_source": """
        SELECT source, count(*) AS n FROM documents
        WHERE NOT regexp_matches(text, 'copyright') AND NOT regexp_matches(text, '[Ll]icen[cs]e') GROUP BY source""",
}
