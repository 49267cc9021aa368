"""Run registered queries next to their SQL counterparts: python tests/check_oracle.py [sf] [name ...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from bidmatrix.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, name: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    df = entry.queries()[name](spark, sf)
    ours = bag(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if ours[1] else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = bag(columns, cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}"
    diff = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if diff:
        return f"{len(diff)} of {len(ours[1])} rows differ, first {diff[0]}"
    return None if ours[1] else "no rows on either side"


def main():
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf, name)
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        mark = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {mark:4} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    spark.stop()
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
