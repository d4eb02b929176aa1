"""Runs registered queries beside their SQL twins in DuckDB.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, con, sf_dir: str, run, sql: str) -> str | None:
    """None where both give the same columns and rows, else what differs."""
    df = run(spark, sf_dir)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    theirs = _rows(columns, cursor.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ: {str(wrong[0][0])[:600]} vs {str(wrong[0][1])[:600]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry

    from prefloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    session, con = local_session(), connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                verdict = f"{entry.queries()[name](session, folder).count()} rows, no SQL"
            else:
                verdict = differences(session, con, folder, entry.queries()[name], sql)
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:400]}"
        failed += verdict is not None and not verdict.endswith("no SQL")
        print(f"{name:28s} {time.time() - start:6.2f}s  {verdict or 'ok'}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
