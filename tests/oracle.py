"""Runs named queries beside their SQL and compares the rows.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import datetime
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, folder: str, name: str) -> str | None:
    """What differs, or nothing."""
    got = entry.queries()[name](spark, folder)
    found = rows_of(got.columns, got.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if found else "no rows"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    types = dict(got.dtypes)
    if len(found) != len(want):
        return f"{len(found)} rows, expected {len(want)}; {found[:2]} {want[:2]}"
    bad = [(a, b) for a, b in zip(found, want) if a != b
           or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ: {bad[:3]} (columns {sorted(names)}, {types})"
    return None


if __name__ == "__main__":
    from foldmark.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.1f}s {kind:4} {name}"
              + (f"\n      {problem}" if problem else ""), flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} fine")
    spark.stop()
