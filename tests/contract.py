"""Runs registered queries next to their SQL and compares the rows.

    python tests/contract.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = Path("/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> tuple[str, int]:
    df = fn(spark, sf_dir)
    table = df.toArrow()
    columns = table.column_names
    rows = list(zip(*[c.to_pylist() for c in table.columns])) if table.num_columns else []
    if sql is None:
        return ("rows only" if rows else "EMPTY"), len(rows)
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    names, got = _rows(columns, rows)
    expected_names, want = _rows(expected_columns, expected)
    if names != expected_names:
        return f"COLUMNS {names} != {expected_names}", len(rows)
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}", len(rows)
    for a, b in zip(got, want):
        if a != b:
            return f"VALUES\n   {a!r:.600}\n   {b!r:.600}", len(rows)
    return ("equal" if rows else "equal but EMPTY"), len(rows)


def main() -> int:
    from memlake.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = str(DATA / f"sf{sf}")
    spark = local_session(8)
    con = duck(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            verdict, n = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as error:  # report and go on with the other queries
            verdict, n = f"ERROR {type(error).__name__}: {str(error).splitlines()[0][:600] if str(error) else ''}", -1
        bad += verdict not in ("equal", "rows only")
        print(f"{name:32} {n:8} {time.time() - start:6.1f}s  {verdict}", flush=True)
    print("differences:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
