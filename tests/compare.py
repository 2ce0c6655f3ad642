"""Run a query and its reference SQL on the same tables and compare rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(shaped, key=repr)


def compare(spark, con, folder, fn, sql) -> str:
    """Empty text when equal, else what differs first."""
    got = fn(spark, folder)
    a_cols, a = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cursor = con.execute(sql)
    b_cols, b = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if len(a) != len(b):
        extra = [r for r in a if r not in set(b)][:2] if len(a) < 20000 else []
        return f"rows {len(a)} != {len(b)} e.g. {str(extra)[:300]}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"row {str(x)[:500]} != {str(y)[:500]}"
    return ""


def main(argv):
    from conftest import session

    folder = argv[0]
    from pressmill.queries import ORACLES, QUERIES

    spark, con = session(), connect(folder)
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                outcome = compare(spark, con, folder, QUERIES[name], ORACLES[name])
            else:
                outcome = "" if QUERIES[name](spark, folder).count() >= 0 else "?"
        except Exception as exc:
            outcome = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += bool(outcome)
        mark = "ok " if not outcome else "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in ORACLES else '(rows only) '}{outcome}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent))
    main(sys.argv[1:])
