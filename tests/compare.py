"""Run registered queries next to their SQL and compare the values.

    python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "documents pages benchmark embeddings labels conversations events".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(value)
    if isinstance(value, Decimal):
        return repr(float(value))
    return "NULL" if value is None else str(value)


def normal(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> str:
    start = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if sql is None:
        return f"ROWS {len(rows)} {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected_rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} vs {sorted(names)}"
    got, want = normal(df.columns, rows), normal(names, expected_rows)
    if got == want:
        return f"ok {len(got)} {took:.1f}s"
    only_got, only_want = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
    return f"FAIL rows {len(got)} vs {len(want)}\n   spark only {str(only_got)[:700]}\n   sql only   {str(only_want)[:700]}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from corpusengine.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark_sql_shuffle_partitions=os.environ.get("PARTITIONS", "8"), spark_ui_enabled="false", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf_dir), oracle_sql()
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            print(name, compare(spark, con, sf_dir, fn, sqls.get(name)), flush=True)
        except Exception as failure:
            print(name, "ERROR", type(failure).__name__, str(failure)[:600], flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
