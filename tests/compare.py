"""Runs registered queries next to their SQL and compares the rows.

    python tests/compare.py [--sf 0.01] [names...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def data_dir(sf: str) -> str:
    return os.path.join(os.environ.get("TESTDATA", "/root/testdata"), f"sf{sf}")


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (decimal.Decimal, datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """What differs, or None."""
    got = rows_of(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    kinds = {n: str(d[1]) for n, d in zip(names, cursor.description)}
    for field in spark_df.schema:
        kind = field.dataType.simpleString()
        expected = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
        if kinds[field.name] not in (expected.get(kind, kind), "VARCHAR" if kind == "string" else ""):
            print(f"   type {field.name}: {kind} vs {kinds[field.name]}")
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first {[g for g in got[:2000] if g not in want][:1]} | {[w for w in want[:2000] if w not in got][:1]}"
    for g, w in zip(got, want):
        if g != w:
            return f"\n   got  {str(g)[:700]}\n   want {str(w)[:700]}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    import __spark_entry__ as contract
    from corpusflow.session import build_session

    folder = data_dir(options.sf)
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql, bad = connect(folder), contract.queries(), contract.oracle_sql(), 0
    for name in options.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                fault = difference(df, con, sql[name])
                state = "same" if fault is None else f"DIFFERENT {fault}"
            else:
                state = f"{df.count()} rows, no SQL"
        except Exception as error:
            state = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        bad += not (state == "same" or state.endswith("no SQL"))
        print(f"{name:28s} {time.time() - start:6.1f}s  {state}", flush=True)
    print(f"{bad} bad; SQL without query: {sorted(set(sql) - set(queries))}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
