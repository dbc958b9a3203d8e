"""Run registered queries next to their SQL and compare whole results.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def plain(value):
    """A value as something two engines agree on."""
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    listed = [tuple(plain(row[i]) for i in order) for row in rows]
    return names, sorted(listed, key=repr)


def duck(sf_dir):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def difference(spark_frame, db, sql):
    """None if both results are equal, else a short text."""
    left_names, left = rows_of(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    found = db.execute(sql)
    right_names, right = rows_of([c[0] for c in found.description], found.fetchall())
    if left_names != right_names:
        return f"columns {left_names} / {right_names}"
    kinds = {name: KINDS.get(kind, kind) for name, kind in spark_frame.dtypes}
    other = {c[0]: str(c[1]) for c in found.description}
    if kinds != other:
        return f"types {kinds} / {other}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"values {a} / {b}"
    return None


def main():
    import __spark_entry__ as entry
    from repoloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session()
    db = duck(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            problem = difference(frame, db, sql[name]) if name in sql else f"{frame.count()} rows, no SQL"
        except Exception as failure:  # report and go on with the next query
            problem = f"{type(failure).__name__}: {str(failure)[:700]}"
        bad += problem is not None
        print(f"{name}: {problem or 'equal'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{bad} not equal")


if __name__ == "__main__":
    main()
