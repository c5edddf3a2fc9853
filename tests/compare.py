"""Run registered queries against their SQL on the same parquet files.

``python -m tests.compare [--sf DIR] [--plain] [name ...]``
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import time

import duckdb
from pyspark.sql import SparkSession


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if type(value).__name__ == "Decimal":
        return int(value) if value == int(value) else float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(repr, r))
    )


def compare(spark, con, query, sf_dir: str):
    """``(message, rows)``; the message is empty when both sides agree."""
    df = query.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return "", len(got)
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if got == want:
        return "", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    (a, b) = bad[0]
    detail = next(
        (
            (x[max(0, i - 30) : i + 30], y[max(0, i - 30) : i + 30])
            for x, y in zip(a, b)
            if isinstance(x, str) and isinstance(y, str) and x != y
            for i in [next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))]
        ),
        (a, b),
    )
    return f"{len(bad)} of {len(got)} rows differ, e.g. {detail!r}", len(got)


def main():
    from postweave.plans import all_queries
    from postweave.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("--plain", action="store_true", help="a session with Spark's defaults")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    if args.plain:
        spark = SparkSession.builder.master("local[8]").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8)
    con = connect(args.sf)
    failed = []
    for name, query in all_queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            message, n = compare(spark, con, query, args.sf)
        except Exception as error:  # noqa: BLE001
            message, n = f"{type(error).__name__}: {str(error)[:600]}", 0
        kind = "sql" if query.sql else "rows"
        print(f"{'FAIL' if message else 'ok':5}{name:32}{kind:5}{n:7} {time.time() - start:6.1f}s {message}", flush=True)
        if message:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
