"""Run the queries and the SQL side by side: python tests/compare.py FOLDER [name ...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kind(name):
    name = str(name).upper()
    return {"LONG": "BIGINT", "STRING": "VARCHAR", "INT": "INTEGER"}.get(name, name)


def compare(spark, con, folder, name, query, sql):
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows only", f"{len(got)} rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: kind(d[1]) for d in result.description}
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", f"{sorted(df.columns)} against {sorted(names)}"
    off = {c: (kind(t), types[c]) for c, t in df.dtypes if kind(t) != types[c]}
    if len(got) != len(want):
        return "COUNT", f"{len(got)} against {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return "VALUES", f"{len(bad)} of {len(got)} differ, first {bad[0]}"
    if off:
        return "TYPES", str(off)
    return "ok", f"{len(got)} rows"


def main():
    from gradeloom.session import get_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = get_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sql = database(folder), contract.oracle_sql()
    failed = 0
    for name, query in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            status, note = compare(spark, con, folder, name, query, sql.get(name))
        except Exception as error:  # report and go on
            status, note = "ERROR", str(error).strip().split("\n")[0][:400]
        failed += status not in ("ok", "rows only")
        print(f"{name:28s} {status:10s} {time.time() - start:6.1f}s  {note[:500]}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
