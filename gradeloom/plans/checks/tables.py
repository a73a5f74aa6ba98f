"""The driver's tables, and the submissions and source files derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, in enough tasks for work on whole texts."""
    return spread(table(spark, folder, "documents"), "doc_id")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the number in ``props`` as ``k`` and ``ts`` as a UTC timestamp."""
    return table(spark, folder, "events").withColumns(
        {"ts": F.col("ts").cast("timestamp"), "k": F.from_json("props", "k DOUBLE")["k"]}
    )


EVENTS = "(SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Events under the names submissions have."""
    return events(spark, folder).select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("event_type").alias("model_version"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("prediction_output"),
        "k",
    )


SUBMISSIONS = (
    "(SELECT event_id AS id, user_id, event_type AS model_version, ts AS created_at, value AS prediction_output, k "
    f"FROM {EVENTS})"
)


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """One Python file per order.

    The tables hold no Python, so every order is written out as a small module
    whose shape follows its columns. What each file contains is therefore known
    from the columns alone, which is what the SQL side computes from.
    """
    orders = spread(table(spark, folder, "orders"), "o_orderkey").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("p"),
        (F.col("o_orderstatus") == "F").alias("f"),
    )
    k, c, p = (F.col(x).cast("string") for x in "kcp")
    owner = F.col("c")

    def function(i):
        n_args = F.pmod(i + owner, F.lit(8)).cast("int")
        args = F.when(
            n_args > 0, F.array_join(F.transform(F.sequence(F.lit(0), n_args - 1), lambda j: F.concat(F.lit("a"), j.cast("string"))), ", ")
        ).otherwise("")
        number = i.cast("string")
        return F.concat(
            F.lit("def func_"), number, F.lit("("), args, F.lit("):\n"),
            F.when(i % 2 == 1, F.lit('    """doc"""\n')).otherwise(""),
            F.lit("    if LIMIT > "), number, F.repeat(F.lit(" and LIMIT"), i), F.lit(":\n"),
            F.lit("        return [v for v in range("), number, F.lit(") if v]\n"),
            F.lit("    return "), number, F.lit("\n\n"),
        )

    methods = F.when(
        F.col("p") % 3 > 0,
        F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.col("p") % 3),
                lambda i: F.concat(F.lit("    def run_"), i.cast("string"), F.lit("(self):\n        return self.items\n")),
            ),
            "",
        ),
    ).otherwise("")
    klass = F.when(
        owner % 2 == 0,
        F.concat(
            F.when(owner % 4 == 0, F.concat(F.lit("class Order_"), k)).otherwise("class Order"),
            F.lit(":\n    def __init__(self, items):\n        self.items = items\n"),
            methods,
        ),
    ).otherwise("")
    whole = F.concat(
        F.when(F.col("f"), F.concat(F.lit('"""order '), k, F.lit('"""\n'))).otherwise(F.concat(F.lit("# order "), k, F.lit("\n"))),
        F.lit("import os\n"),
        F.when(owner % 3 == 0, F.lit("import sys as system\n")).otherwise("\n"),
        F.lit("LIMIT = "), c, F.lit("\n"),
        F.lit("total_"), (owner % 5).cast("string"), F.lit(" = os.getpid()  # start\n"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.col("p") - 1), function), ""),
        klass,
        F.when(owner % 11 == 0, F.concat(F.lit('note = "'), F.repeat(F.lit("x"), F.lit(120)), F.lit('"\n'))).otherwise(""),
        F.when(owner % 50 == 7, F.lit("def broken(:\n")).otherwise(""),
    )
    text = F.when(owner % 50 == 8, F.concat(F.lit("import os\n# only an import in "), k, F.lit("\n"))).otherwise(whole)
    return orders.select(
        k.cast("bigint").alias("file_id"),
        text.alias("text"),
        F.concat(F.lit("dev"), c, F.lit("/repo"), k).alias("repo_name"),
        F.col("c").alias("user_id"),
    )


# the same files in SQL, with what each of them contains
SOURCES = r"""
  (SELECT k AS file_id, c, p, f,
     CASE WHEN c % 50 = 8 THEN 'import os' || chr(10) || '# only an import in ' || k || chr(10)
     ELSE
       CASE WHEN f THEN '"COMMENT"order ' || k || '"COMMENT"' ELSE '# order ' || k END || chr(10)
       || 'import os' || chr(10)
       || CASE WHEN c % 3 = 0 THEN 'import sys as system' ELSE '' END || chr(10)
       || 'LIMIT = ' || c || chr(10)
       || 'total_' || (c % 5) || ' = os.getpid()  # start' || chr(10)
       || array_to_string([
            'def func_' || i || '(' || array_to_string(['a' || j FOR j IN range((i + c) % 8)], ', ') || '):' || chr(10)
            || CASE WHEN i % 2 = 1 THEN '    "COMMENT"doc"COMMENT"' || chr(10) ELSE '' END
            || '    if LIMIT > ' || i || repeat(' and LIMIT', i) || ':' || chr(10)
            || '        return [v for v in range(' || i || ') if v]' || chr(10)
            || '    return ' || i || chr(10) || chr(10)
          FOR i IN range(p)], '')
       || CASE WHEN c % 2 = 0 THEN
            CASE WHEN c % 4 = 0 THEN 'class Order_' || k ELSE 'class Order' END || ':' || chr(10)
            || '    def __init__(self, items):' || chr(10) || '        self.items = items' || chr(10)
            || array_to_string(['    def run_' || i || '(self):' || chr(10) || '        return self.items' || chr(10) FOR i IN range(1, p % 3 + 1)], '')
          ELSE '' END
       || CASE WHEN c % 11 = 0 THEN 'note = "' || repeat('x', 120) || '"' || chr(10) ELSE '' END
       || CASE WHEN c % 50 = 7 THEN 'def broken(:' || chr(10) ELSE '' END
     END AS text,
     c % 50 <> 7 AS parsed,
     c % 50 NOT IN (7, 8) AS has_logic
   FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p,
                o_orderstatus = 'F' AS f FROM orders))
""".replace('"COMMENT"', '"""')
