"""Compares registered queries with their SQL: ``python tests/check.py FOLDER [NAME...]``."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from decimal import Decimal

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return f"{value.normalize():f}" if value else "0"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def expected(folder: str, sql: str):
    import duckdb

    con = duckdb.connect()
    import fixtures

    for t in fixtures.TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def compare(df, folder: str, sql: str) -> str:
    """'' when both give the same rows, else what differs."""
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want_columns, want = expected(folder, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} instead of {want_columns}"
    if got == want:
        return ""
    surplus, lacking = list((got - want).items()), list((want - got).items())
    return (
        f"{sum(got.values())} rows instead of {sum(want.values())}; columns {got_columns}; "
        f"{len(surplus)} surplus {surplus[:3]}; {len(lacking)} lacking {lacking[:3]}"
    )


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from pricelake.runtime import build_session

    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                found = compare(df, folder, sql[name])
                n = "" if found else df.count()
            else:
                found, n = "", f"{df.count()} rows, not compared"
        except Exception as error:
            found, n = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += bool(found)
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - start:.1f}s {n} {found}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
