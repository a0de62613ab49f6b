"""Run registered queries and their SQL twins side by side and report differences.

python tools/compare.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import importlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    """One value in a form both engines share."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, int | float):
        return float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(repr, r))
    )


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--no-sql", action="store_true")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    import duckdb

    from taproom import build_session

    entry = importlib.import_module("__spark_entry__")
    folder = f"/root/testdata/sf{options.sf}"
    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if options.names and not any(name.startswith(p) for p in options.names):
            continue
        started = time.time()
        try:
            frame = build(spark, folder)
            got = rows_of(frame.columns, frame.collect())
            took = time.time() - started
            if name not in oracle or options.no_sql:
                print(f"ROWS  {name} {len(got)} rows {took:.1f}s", flush=True)
                continue
            started = time.time()
            cursor = duck.execute(oracle[name])
            columns = [c[0] for c in cursor.description]
            want = rows_of(columns, cursor.fetchall())
            duck_took = time.time() - started
            if sorted(frame.columns) != sorted(columns):
                print(f"COLS  {name} spark={sorted(frame.columns)} sql={sorted(columns)}")
                bad += 1
            elif got != want:
                bad += 1
                extra = [r for r in got if r not in set(want)][:2]
                lacking = [r for r in want if r not in set(got)][:2]
                print(f"DIFF  {name} spark={len(got)} sql={len(want)} {sorted(columns)}")
                print("   only spark:", str(extra)[:700])
                print("   only sql:  ", str(lacking)[:700])
            else:
                print(f"OK    {name} {len(got)} rows {took:.1f}s sql {duck_took:.1f}s", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name} {type(error).__name__}: {str(error)[:900]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("problems:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
