"""Compare every registered query with its SQL over the given tables.

usage: python tests/oracle_check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item") and not hasattr(value, "__len__"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "__len__") and not isinstance(value, (str, bytes, dict)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, norm(v)) for k, v in value.items())
    return value


def rows(frame: pd.DataFrame):
    cols = sorted(frame.columns)
    out = [tuple(norm(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, query in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir)
            if got.columns != list(dict.fromkeys(got.columns)):
                raise ValueError(f"repeated columns {got.columns}")
            frame = got.toPandas()
            spent = time.time() - start
            if name not in oracles:
                print(f"rows-only {name:28s} {len(frame):8d} rows {spent:6.1f}s", flush=True)
                if not len(frame):
                    bad.append(name)
                continue
            start = time.time()
            want = con.execute(oracles[name]).df()
            spent2 = time.time() - start
            a, b = rows(frame), rows(want)
            if a == b:
                print(f"ok        {name:28s} {len(frame):8d} rows {spent:6.1f}s / {spent2:.1f}s", flush=True)
                if not len(frame):
                    print("          ^ no rows")
            else:
                bad.append(name)
                print(f"MISMATCH  {name} {len(frame)} vs {len(want)} rows; {a[0]} vs {b[0]}")
                if a[0] == b[0]:
                    left, right = set(a[1]) - set(b[1]), set(b[1]) - set(a[1])
                    print("   spark only", len(left), [r for r in sorted(left, key=repr)[:3]])
                    print("   sql only  ", len(right), [r for r in sorted(right, key=repr)[:3]], flush=True)
        except Exception as err:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR     {name}: {type(err).__name__}: {str(err)[:1500]}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
