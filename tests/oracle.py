"""Compares queries with their DuckDB SQL: ``python tests/oracle.py [sf_dir] [names]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return value + 0.0
    if hasattr(value, "item"):
        return plain(value.item())
    return str(value) if not isinstance(value, (int, bool, str, bytes)) else value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(spark, name: str, sf_dir: str, con) -> list[str]:
    """What differs between a query and its SQL; empty if nothing does."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    mine = df.collect()
    sql = entry.oracle_sql()[name]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    a, b = rows(df.columns, mine), rows(names, theirs)
    if len(a) != len(b):
        return [f"{len(a)} and {len(b)} rows", f"only Spark: {[x for x in a if x not in b][:3]}", f"only SQL: {[x for x in b if x not in a][:3]}"]
    return [f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y][:3]


if __name__ == "__main__":
    from conftest import session

    import __spark_entry__ as entry

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, bad = session(), connection(where), []
    for key in sys.argv[2:] or entry.queries():
        began = time.time()
        try:
            if key in entry.oracle_sql():
                found = differences(spark, key, where, con)
            else:
                found = [] if entry.queries()[key](spark, where).count() >= 0 else ["?"]
        except Exception as e:  # the report goes on with the next query
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        if found:
            bad.append(key)
        print(f"{'FAIL' if found else 'ok'} {key} {time.time() - began:.1f}s", *[x[:700] for x in found], sep="\n    " if found else " ", flush=True)
    print(f"{len(bad)} differ: {bad}")
