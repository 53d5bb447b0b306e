"""Side-by-side check of the registered queries against their comparison SQL.

    python tests/parity.py [scale] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return float(x)
    return str(x)


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_plain(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    ra, rb = rows_of(a), rows_of(b)
    if len(ra) != len(rb):
        return f"rows {len(ra)} vs {len(rb)}"
    bad = [(x, y) for x, y in zip(ra, rb) if x != y]
    return f"{len(bad)} of {len(ra)} rows differ, first {sorted(a.columns)}: {bad[0]}" if bad else ""


def main() -> int:
    import __spark_entry__ as entry
    from tarmetric.session import local_session

    args = sys.argv[1:]
    scale = args[0] if args else "0.01"
    prefixes = tuple(args[1:])
    sf_dir = f"/root/testdata/sf{scale}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = connect(sf_dir), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001 - a report over all queries
            failed.append(name)
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in oracle:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            why = differences(got, con.execute(oracle[name]).df())
        except Exception as e:  # noqa: BLE001
            why = f"SQL: {str(e)[:800]}"
        failed += [name] if why else []
        print(f"{'FAIL ' if why else 'ok   '} {name}: {len(got)} rows spark {took:.1f}s sql {time.time() - start:.1f}s {why[:900]}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
