"""Compare registered queries with their SQL in DuckDB, value by value."""

from __future__ import annotations

import glob
import math
import os
import time
from collections import Counter

import duckdb

SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
               "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    return x


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> str:
    """Empty when both sides agree, else what differs."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(_cell(r[c]) for c in cols) for r in df.select(cols).collect())
    t1 = time.time()
    rel = con.sql(sql)
    names, types = rel.columns, dict(zip(rel.columns, map(str, rel.types)))
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    wrong = [(c, t, types[c]) for c, t in df.dtypes if SPARK_TYPES.get(t, t) != types[c]]
    order = [names.index(c) for c in cols]
    want = Counter(tuple(_cell(r[i]) for i in order) for r in rel.fetchall())
    t2 = time.time()
    note = f"[{sum(got.values())} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s]"
    if got != want:
        a, b = list((got - want).elements()), list((want - got).elements())
        return f"{len(a)} extra, {len(b)} missing of {sum(want.values())} {cols}: {sorted(map(str, a))[:3]} vs {sorted(map(str, b))[:3]} {note}"
    if wrong:
        return f"types {wrong} {note}"
    if not got:
        return f"no rows {note}"
    print(f"ok   {name} {note}", flush=True)
    return ""


def main() -> None:
    import sys
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from spanweave.session import build_session
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = build_session(master="local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                                                      "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = sys.argv[1:]
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            if name in oracles:
                problem = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                t0 = time.time()
                n = fn(spark, sf_dir).count()
                problem = "" if n else "no rows"
                print(f"rows {name} [{n} rows, {time.time() - t0:.1f}s, no SQL]", flush=True)
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        if problem:
            bad += 1
            print(f"FAIL {name}: {problem}", flush=True)
    print(f"{bad} failed")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
