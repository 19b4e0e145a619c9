"""Run registered queries beside their SQL twins in DuckDB.

Usage: python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "item"):
        return _cell(value.item())
    return value


def _rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = [tuple(_cell(x) for x in row) for row in frame[columns].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """The first difference between two results, or None."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    differing = [(a, b) for a, b in zip(_rows(left), _rows(right), strict=True) if a != b]
    if differing:
        return f"{len(differing)} rows differ over {sorted(left.columns)}: {differing[:2]}"
    return None


def main() -> None:
    from assayer.plans import all_plans
    from assayer.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    plans, twins = all_plans()
    names = sys.argv[2:] or list(plans)
    spark = build_session(cores="8", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            mine = plans[name](spark, folder).toPandas()
            spent = time.time() - started
            if name not in twins:
                print(f"rows  {name}: {len(mine)} rows {spent:.1f}s", flush=True)
                continue
            started = time.time()
            theirs = connection.execute(twins[name]).df()
            problem = difference(mine, theirs)
        except Exception as error:  # report and go on with the next query
            problem, spent = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - started
        bad += problem is not None
        status = "FAIL" if problem else "ok  "
        print(f"{status}  {name}: {len(mine) if not problem else problem} {spent:.1f}s duck {time.time() - started:.1f}s", flush=True)
    print(f"{bad} of {len(names)} differ")
    spark.stop()


if __name__ == "__main__":
    main()
