"""Spark results against DuckDB on the same tables.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def cell(v):
    """One value in a form both engines share; kinds stay apart."""
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return "nan" if v != v else ("float", repr(v))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return ("date", v.isoformat())
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return repr(v)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def duck_rows(con, sql: str):
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def difference(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    columns, rows = duck_rows(con, sql)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, rows)
    if ours == theirs:
        return None
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} and {sum(theirs.values())} rows; only Spark {sum(only_ours.values())}: "
        f"{list(only_ours)[:3]}; only DuckDB {sum(only_theirs.values())}: {list(only_theirs)[:3]}"
    )


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidewire.session import get_spark

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark = get_spark(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sql:
                found = difference(df, con, sql[name]) or "equal"
            else:
                found = f"rows only: {df.count()}"
        except Exception as error:  # report and go on
            found = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        good = found == "equal" or found.startswith("rows only")
        bad += not good
        print(f"{name:28s} {time.time() - start:6.2f}s {found[:900]}", flush=True)
    print(f"{bad} not equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
