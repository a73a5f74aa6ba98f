"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (folder of the tables), BENCH_CPUS (cores). Every query
runs once on the smallest tables to warm the session, then up to three times;
the median wall time counts. Results are computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from gradeloom.operators import attribution as at
from gradeloom.operators.forest import fit_forest
from gradeloom.plans.checks import all_queries
from gradeloom.plans.checks.tables import table
from gradeloom.session import get_session, spread, stage

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
BUDGET = float(os.environ.get("BENCH_REPEAT_BELOW_SEC", "10"))

HEADLINE = [
    "curated_line_summary",
    "c1_line_features",
    "g1_user_split",
    "g3_decay_weights",
    "h3_mined_ranges",
    "i2_drift",
    "f3_histogram",
    "f6_correlations",
    "f7_metrics",
    "f10_top_k",
    "g16_silhouettes",
    "e9_close_pairs",
    "g12_token_windows",
    "h1_fixed_leaves",
    "h5_recommendations",
    "k2_rolling_error_stream",
    "d18_transformed_features",
]
COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_partkey", "l_linenumber"]


def forest_attribution(trees: int):
    """Shapley values of every line item: fit outside the clock, explain inside it."""
    models = {}

    def run(spark, folder):
        rows = spread(table(spark, folder, "lineitem"), "l_orderkey").withColumn("row_id", F.xxhash64("*"))
        if folder not in models:
            models[folder] = fit_forest(stage(rows, "bench"), COLUMNS, "l_extendedprice", trees=trees, max_depth=5)
        return lambda: at.attribute_forest(rows, rows, models[folder], COLUMNS)

    return run


def peak_memory_mb(spark) -> int:
    """The most memory that the JVM, driver and executor in one, has had."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    with open(f"/proc/{pid}/status") as status:
        return next(int(line.split()[1]) // 1024 for line in status if line.startswith("VmHWM"))


def main() -> None:
    spark = get_session(
        "bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    known = all_queries()
    jobs = {name: (lambda s, f, q=known[name]: (lambda: q(s, f))) for name in HEADLINE}
    jobs["h1_forest_3_trees"] = forest_attribution(3)
    jobs["h1_forest_20_trees"] = forest_attribution(20)

    def once(prepare, folder):
        build = prepare(spark, folder)
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times, rates = {}, {}
    for name, prepare in jobs.items():
        once(prepare, WARM)
        runs = [once(prepare, FOLDER)]
        while len(runs) < 3 and sum(runs) < BUDGET:
            runs.append(once(prepare, FOLDER))
        times[name] = round(statistics.median(runs), 3)
        print(f"{name:28s} {times[name]:8.3f}s  ({len(runs)} runs)", file=sys.stderr, flush=True)
    for name, source in (
        ("c1_line_features", "documents"), ("g1_user_split", "events"), ("h3_mined_ranges", "events"), ("i2_drift", "events"),
        ("d18_transformed_features", "orders"), ("h1_forest_20_trees", "lineitem"), ("g16_silhouettes", "embeddings"),
    ):
        rates[name] = round(table(spark, FOLDER, source).count() / times[name])
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rates,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "memory_mb": peak_memory_mb(spark),
            }
        )
    )


if __name__ == "__main__":
    main()
