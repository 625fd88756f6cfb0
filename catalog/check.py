"""Runs registered queries on Spark and their check SQL on the second engine and compares the rows.

    python -m catalog.check [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from pregonero.session import build_session

from . import CHECKS, QUERIES
from .inputs import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{v}"


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    got = normalised(df.columns, [tuple(r) for r in df.collect()])
    if name not in CHECKS:
        return True, f"{len(got[1])} rows, no check SQL"
    rel = con.execute(CHECKS[name])
    want = normalised([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:1]
        only = (list(set(got[1]) - set(want[1]))[:2], list(set(want[1]) - set(got[1]))[:2])
        return False, f"{len(got[1])} vs {len(want[1])} rows\n   spark {only[0]}\n   check {only[1]} {diff if not any(only) else ''}"
    return True, f"{len(got[1])} rows"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(
        "check", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                    "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} ({time.time() - start:.1f}s) {note[:1800]}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
