"""Runs registered queries beside their checking SQL: python tests/parity.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from trendloom.plans.views import BASE_TABLES  # noqa: E402
from trendloom.session import local_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.9g}") + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([(type(normal(r[i])).__name__, normal(r[i])) for i in order]) for r in rows)


def compare(spark, con, name: str, sf_dir: str):
    """(rows, seconds, difference or '')."""
    start = time.time()
    df = E.queries()[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    sql = E.oracle_sql().get(name)
    if sql is None:
        return len(rows), took, "" if rows else "no rows"
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    expected = found.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(rows), took, f"columns {sorted(df.columns)} / {sorted(columns)}"
    ours, theirs = table(df.columns, rows), table(columns, expected)
    if ours == theirs:
        return len(rows), took, "" if rows else "no rows"
    only_ours = [r for r in ours if r not in set(theirs)][:2]
    only_theirs = [r for r in theirs if r not in set(ours)][:2]
    return len(rows), took, f"{len(ours)}/{len(theirs)} rows\n   spark {only_ours}\n   check {only_theirs}"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(E.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session("8"), connect(sf_dir)
    bad = 0
    for name in names:
        try:
            rows, took, problem = compare(spark, con, name, sf_dir)
        except Exception as why:  # noqa: BLE001
            rows, took, problem = 0, 0.0, f"{type(why).__name__}: {str(why)[:700]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {rows:7d} rows {took:6.2f}s {problem[:1500]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal; without SQL: {sorted(set(E.queries()) - set(E.oracle_sql()))}")
