"""Runs a query on Spark and its twin in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir, fn, sql):
    """(problem or None, rows)."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g. {str(bad[0][0])[:300]} != {str(bad[0][1])[:300]}", len(got)
    return None, len(got)


def main() -> None:
    from semdrift.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    from semdrift.plans.catalog import load

    queries, oracles = load()
    con = connect(sf_dir)
    failed = 0
    for key in sorted(queries):
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, queries[key], oracles.get(key))
        except Exception as exc:
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        failed += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {key:32s} rows={n:6d} {time.time() - begin:6.2f}s {'' if key in oracles else '(no sql)'} {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
