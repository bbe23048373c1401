"""Runs registered queries next to their SQL and compares the values.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=key)


def kinds(values):
    return {type(v).__name__ for v in values if v is not None}


def compare(spark, con, sf: str, name: str) -> tuple[str, int, float, float]:
    import __spark_entry__ as entry

    t0 = time.time()
    df = entry.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "no sql", len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    want = cur.fetchall()
    t2 = time.time()
    gc, gr = rows_of(df.columns, got)
    wc, wr = rows_of([d[0] for d in cur.description], want)
    if gc != wc:
        return f"COLUMNS {gc} <> {wc}", len(got), t1 - t0, t2 - t1
    if len(gr) != len(wr):
        extra = [r for r in gr if r not in set(wr)][:2] if len(gr) < 5000 else []
        missing = [r for r in wr if r not in set(gr)][:2] if len(wr) < 5000 else []
        return f"ROWS {len(gr)} <> {len(wr)}; only spark {extra}; only sql {missing}", len(got), t1 - t0, t2 - t1
    for i, column in enumerate(gc):
        a, b = kinds(r[i] for r in gr), kinds(r[i] for r in wr)
        if a and b and a != b:
            return f"TYPE of {column}: {a} <> {b}", len(got), t1 - t0, t2 - t1
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    if bad:
        cells = [(c, x, y) for a, b in bad[:1] for c, x, y in zip(gc, a, b) if x != y]
        return f"VALUES {len(bad)} differ: {cells}", len(got), t1 - t0, t2 - t1
    return "ok", len(got), t1 - t0, t2 - t1


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from voxlake.session import local_session

    spark = local_session("compare", cores=8)
    con = connect(args.sf)
    failed = 0
    for name in args.names or entry.queries():
        try:
            verdict, n, a, b = compare(spark, con, args.sf, name)
        except Exception as error:  # report and go on with the next query
            verdict, n, a, b = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0, 0, 0
        failed += verdict not in ("ok", "no sql")
        print(f"{name:34s} {n:7d} rows {a:6.2f}s sql {b:6.2f}s  {verdict[:900]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
