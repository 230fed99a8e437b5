"""Runs a query and its SQL side by side: ``python tests/compare.py SF_DIR NAME...``"""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 9)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty if the rows agree, else what differs."""
    got = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    want = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; only here {[r for r in got if r not in want][:2]}, only there {[r for r in want if r not in got][:2]}"
    differ = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(differ)} of {len(got)} rows differ, first {differ[0]}" if differ else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__
    from floodlake.session import local_session

    spark = local_session()
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    names = sys.argv[2:] or list(queries)
    con = connect(sys.argv[1])
    for name in names:
        for match in [q for q in queries if q == name or name.endswith("*") and q.startswith(name[:-1])]:
            began = time.time()
            try:
                df = queries[match](spark, sys.argv[1])
                said = compare(df, con, oracles[match]) if match in oracles else f"(no SQL) {df.count()} rows"
                print(match, said or "agree", f"{time.time() - began:.1f}s", flush=True)
            except Exception as e:
                print(match, "FAILED", str(e)[:1500], flush=True)
