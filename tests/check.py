"""Run registered queries beside their SQL counterparts and report differences.

Usage: python tests/check.py [data folder] [query name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import duckdb

import __spark_entry__ as entry
from cohortry.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def kinds(rows):
    out = {}
    for row in rows:
        for i, v in enumerate(row):
            if v is not None:
                out.setdefault(i, set()).add(type(v).__name__)
    return out


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    spent = time.time() - start
    text = entry.oracle_sql().get(name)
    if text is None:
        return True, f"rows only: {len(got)} rows, {spent:.1f}s"
    cur = con.execute(text)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    note = f"{len(got)} rows, {spent:.1f}s"
    if a[0] != b[0]:
        return False, f"{note}; columns {a[0]} against {b[0]}"
    if a[1] != b[1]:
        left, right = list((a[1] - b[1]).elements()), list((b[1] - a[1]).elements())
        return False, f"{note}; {len(want)} expected; {len(left)} extra, {len(right)} missing\n   {sorted(left, key=str)[:3]}\n   {sorted(right, key=str)[:3]}"
    if kinds(a[1]) != kinds(b[1]):
        return False, f"{note}; types {kinds(a[1])} against {kinds(b[1])}"
    return bool(got), note if got else f"{note}; empty"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, bad = local_session(cpus=8), connect(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} right")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
