"""Run queries next to their SQL twins: `python -m checks.compare [folder] [query ...]`."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

from checks.oracles import ORACLES
from checks import planted  # noqa: F401  (adds its queries to both lists)
from checks.queries import QUERIES
from tillpath.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _key(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, float):
        return "fnan" if math.isnan(value) else f"f{value + 0.0!r}"
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, dt.datetime):
        return f"t{value.isoformat()}"
    if isinstance(value, dt.date):
        return f"d{value.isoformat()}"
    return f"{type(value).__name__}{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, name, folder):
    """None if equal, else what differs; also the seconds of the Spark side."""
    start = time.monotonic()
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    seconds = time.monotonic() - start
    if name not in ORACLES:
        return (None if rows else "no rows"), seconds, len(rows)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    wanted = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", seconds, len(rows)
    ours, theirs = rows_of(df.columns, rows), rows_of(columns, wanted)
    if ours == theirs:
        return None, seconds, len(rows)
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    detail = f"{len(ours)} rows vs {len(theirs)}; only ours {len(a)}: {sorted(a)[:2]}; only SQL {len(b)}: {sorted(b)[:2]}"
    return f"{sorted(columns)}: {detail}", seconds, len(rows)


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "compare", f"local[{cores}]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        try:
            problem, seconds, n = compare(spark, con, name, folder)
        except Exception as error:  # the run goes on with the next query
            problem, seconds, n = f"{type(error).__name__}: {str(error)[:1500]}", 0.0, 0
        failed += problem is not None
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:28s} {seconds:6.2f}s {n:7d} {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} queries agree")
    spark.stop()


if __name__ == "__main__":
    main()
