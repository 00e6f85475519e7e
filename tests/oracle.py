"""Run a registered query on Spark and its check SQL on DuckDB, and compare whole results."""

import math
import sys
import time

import duckdb

from ballast.plans.stand_ins import BASE


def duck(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in BASE:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    return str(v)


def rows_of(columns, rows):
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(cell(r[i]) for i in at) for r in rows), key=repr)


def compare(spark, con, name, run, sql, folder):
    df = run(spark, folder)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), "rows-only"
    res = con.execute(sql)
    want_names, want = rows_of([c[0] for c in res.description], res.fetchall())
    if got_names != want_names:
        return len(got), f"columns differ: {got_names} / {want_names}"
    if len(got) != len(want):
        return len(got), f"row count {len(got)} / {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return len(got), f"{len(bad)} rows differ, e.g.\n    spark  {bad[0][0]}\n    duckdb {bad[0][1]}\n    cols {got_names}"
    return len(got), "ok"


def main(argv):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from ballast.session import session
    import __spark_entry__ as entry

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = session("check", master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            n, verdict = compare(spark, con, name, run, oracles.get(name), folder)
        except Exception as exc:  # noqa: BLE001
            n, verdict = -1, f"{type(exc).__name__}: {str(exc)[:500]}"
        if verdict not in ("ok", "rows-only"):
            bad += 1
        if verdict != "ok" or n == 0 or os.environ.get("VERBOSE"):
            print(f"{name}: {verdict} ({n} rows, {time.time() - t:.1f}s)", flush=True)
    print("checked", len(queries), "bad", bad)


if __name__ == "__main__":
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    main(sys.argv[1:])
