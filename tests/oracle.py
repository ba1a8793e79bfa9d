"""Compare registered queries with their DuckDB counterpart: ``python tests/oracle.py [sf_dir] [names...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if value is None:
        return "null"
    return f"{type(value).__name__}:{value}"


def difference(spark, con, name, sf_dir):
    """None when equal, else a short text."""
    frame = contract.queries()[name](spark, sf_dir)
    ours = frame.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None if ours else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(columns)}"
    order = sorted(columns)
    left = sorted([tuple(cell(row[c]) for c in order) for row in ours])
    at = [columns.index(c) for c in order]
    right = sorted([tuple(cell(row[i]) for i in at) for row in theirs])
    if len(left) != len(right):
        return f"{len(left)} rows vs {len(right)}"
    if not left:
        return "no rows"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        bad = {c for a, b in wrong for c, x, y in zip(order, a, b) if x != y}
        return f"{len(wrong)}/{len(left)} rows differ in {sorted(bad)}; first {wrong[0]}"
    return None


if __name__ == "__main__":
    from annolake.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session()
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    names = sys.argv[2:] or list(contract.queries())
    failed = 0
    for query_name in names:
        begin = time.time()
        try:
            result = difference(session, connection, query_name, sf_dir)
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:600]}"
        failed += result is not None
        kind = "sql " if query_name in contract.oracle_sql() else "rows"
        print(f"{'ok  ' if result is None else 'FAIL'} {kind} {time.time() - begin:6.2f}s {query_name} {result or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} passed")
