"""Run registered queries against their comparison SQL: ``python tests/compare.py [sf] [names…]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from bindery.session import get_spark  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, float) and math.isfinite(value):
        return round(value, 9)
    return value


def rows_of(records, columns):
    """Rows with columns in name order, sorted, nulls last."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(plain(r[i]) for i in at) for r in records]
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark, sf_dir: str, names: list[str] | None = None) -> list[str]:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    failed, oracles = [], entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            ours = rows_of(df.collect(), df.columns)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {str(e)[:600]}", flush=True)
            failed.append(name)
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name} {len(ours)} {took:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(oracles[name])
            columns = [d[0] for d in cur.description]
            theirs = rows_of(cur.fetchall(), columns)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle {str(e)[:600]}", flush=True)
            failed.append(name)
            continue
        same = sorted(columns) == sorted(df.columns) and ours == theirs
        print(f"{'ok  ' if same else 'DIFF'} {name} {len(ours)}/{len(theirs)} {took:.1f}s", flush=True)
        if not same:
            failed.append(name)
            print("   columns", sorted(df.columns), sorted(columns))
            a, b = set(ours) - set(theirs), set(theirs) - set(ours)
            for label, part in (("ours", a), ("sql ", b)):
                for r in sorted(part, key=str)[:2]:
                    print("   ", label, str(r)[:300])
    return failed


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    session = get_spark(cores=os.environ.get("COMPARE_CPUS", "*"))
    session.sparkContext.setLogLevel("OFF")
    bad = compare(session, f"/root/testdata/sf{sf}", sys.argv[2:] or None)
    print("failed:", bad)
