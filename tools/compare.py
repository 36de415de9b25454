"""Runs registered queries on Spark and their SQL on DuckDB, and compares the rows.

usage: python tools/compare.py [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factloom.plans.registry import catalogue  # noqa: E402
from factloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def kinds(rows: list[tuple]) -> list[str]:
    found: list[set] = [set() for _ in (rows[0] if rows else ())]
    for row in rows:
        for i, v in enumerate(row):
            if v is not None:
                found[i].add(type(v).__name__)
    return [",".join(sorted(f)) for f in found]


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    con, spark, bad = database(a.sf), local_session(), []
    for name, q in catalogue().items():
        if a.names and not any(n == name or n in q.build.__module__ for n in a.names):
            continue
        start = time.time()
        try:
            df = q.run(spark, a.sf)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if q.sql is None:
                print(f"rows  {name}: {len(got)} rows, no SQL, {took:.1f}s")
                continue
            rel = con.sql(q.sql)
            want_columns = rel.columns
            want = rows_of(want_columns, rel.fetchall())
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            print(f"ERROR {name}: {str(e)[:700]}")
            continue
        if sorted(df.columns) != sorted(want_columns):
            bad.append(name)
            print(f"BAD   {name}: columns {sorted(df.columns)} / {sorted(want_columns)}")
        elif got != want or kinds(got) != kinds(want):
            bad.append(name)
            print(f"BAD   {name}: {len(got)} / {len(want)} rows; kinds {kinds(got)} {kinds(want)}")
            missing = [r for r in want if r not in set(got)][:3] if len(want) < 50000 else want[:2]
            extra = [r for r in got if r not in set(want)][:3] if len(got) < 50000 else got[:2]
            print("   columns", sorted(df.columns))
            print("   only SQL  ", missing)
            print("   only Spark", extra)
        else:
            flag = "  EMPTY" if not got else ""
            print(f"ok    {name}: {len(got)} rows, {took:.1f}s{flag}")
    print("failing:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
