"""Run registered queries in Spark and their SQL text in DuckDB and compare them value by value."""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "tinyint": "TINYINT",
}


def make_spark(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelforge")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))  # stage tables; one machine here
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def make_duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v)


def compare(spark: SparkSession, con, sf: str, fn, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf)
    names = sorted(df.columns)
    got = [tuple(row[c] for c in names) for row in df.collect()]
    rel = con.sql(sql)
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if sorted(rel.columns) != names:
        return f"columns {names} vs {sorted(rel.columns)}"
    bad = [
        f"{n}:{t} vs {types[n]}"
        for n, t in df.dtypes
        if TYPES.get(t, "?") != types[n] and not t.startswith("array")
    ]
    idx = [rel.columns.index(c) for c in names]
    want = [tuple(row[i] for i in idx) for row in rel.fetchall()]
    a = sorted([tuple(norm(v) for v in row) for row in got])
    b = sorted([tuple(norm(v) for v in row) for row in want])
    if bad:
        return f"types {bad}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; {names}; e.g. {a[:1]} {b[:1]}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ; {names}\n   spark {diff[0][0]}\n   sql   {diff[0][1]}"
    return None if a else "EMPTY"


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries

    sf = "/root/testdata/sf0.01"
    picks = []
    for a in argv:
        if a.startswith("sf"):
            sf = f"/root/testdata/{a}"
        else:
            picks.append(a)
    spark = make_spark()
    spark.sparkContext.setLogLevel("ERROR")
    con = make_duck(sf)
    q, o = queries(), oracle_sql()
    fails = 0
    for key, fn in q.items():
        if picks and not any(key.startswith(p) for p in picks):
            continue
        t0 = time.time()
        try:
            if key in o:
                msg = compare(spark, con, sf, fn, o[key])
            else:
                n = fn(spark, sf).count()
                msg = None if n else "EMPTY"
        except Exception as e:  # report and go on with the next query
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        fails += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {key} {time.time() - t0:.1f}s{'' if key in o else ' (rows)'}"
              + (f"\n   {msg}" if msg else ""), flush=True)
    print("failures:", fails)
    return fails


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
