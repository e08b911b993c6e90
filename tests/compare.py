"""Run registered queries and their check SQL side by side.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factloom.sources.tables import NAMES  # noqa: E402


def _plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v))
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    return str(v)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(path):
    import duckdb

    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


# joins that compare every row of one side with every row of the other
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def compare(spark, con, path, name, run, sql):
    """Return (ok, message)."""
    started = time.time()
    df = run(spark, path)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    plan = df._jdf.queryExecution().toString()
    found = [operator for operator in FORBIDDEN if operator in plan]
    if found:
        return False, f"plan has {found}"
    if sql is None:
        return bool(rows), f"{len(rows)} rows (no SQL) in {spent:.1f}s"
    started = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    expected = cur.fetchall()
    duck_spent = time.time() - started
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    got, want = normalise(df.columns, rows), normalise(columns, expected)
    if got != want:
        in_got, in_want = set(got), set(want)
        only_got = [r for r in got if r not in in_want][:3]
        only_want = [r for r in want if r not in in_got][:3]
        return False, (f"{sorted(columns)}\n rows {len(got)} vs {len(want)}\n spark only: {only_got}"
                       f"\n sql only:   {only_want}")
    return True, f"{len(rows)} rows in {spent:.1f}s (sql {duck_spent:.1f}s)"


def session(cores="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    args = list(argv)
    path = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = session(), duck(path)
    oracles, failed = oracle_sql(), []
    for name, run in queries().items():
        if args and name not in args:
            continue
        try:
            ok, message = compare(spark, con, path, name, run, oracles.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        print("ok  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            failed.append(name)
    print(f"failed: {failed}" if failed else "all matched")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
