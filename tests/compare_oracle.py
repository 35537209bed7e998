"""Run the registered queries and their SQL side by side.

python tests/compare_oracle.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Names of types that hold the same values in both engines.
_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def differences(spark_df, connection, sql: str) -> list[str]:
    """What differs in columns, types, row count or values; empty when equal."""
    found = []
    relation = connection.sql(sql)
    ours = {name: _TYPES.get(kind, kind) for name, kind in spark_df.dtypes}
    theirs = {name: str(kind) for name, kind in zip(relation.columns, relation.types)}
    if ours != theirs:
        found.append(f"schema {ours} != {theirs}")
    columns = sorted(ours)
    if columns != sorted(theirs):
        return found
    left = sorted([tuple(_cell(row[c]) for c in columns) for row in spark_df.collect()])
    places = [relation.columns.index(c) for c in columns]
    right = sorted([tuple(_cell(row[p]) for p in places) for row in relation.fetchall()])
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    if left != right:
        pairs = [(a, b) for a, b in zip(left, right) if a != b][:1]
        found.append(f"values differ, first: {pairs}"[:1500])
    return found


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tablelink.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.monotonic()
        try:
            df = fn(spark, folder)
            found = differences(df, connection, sqls[name]) if name in sqls else ["no SQL"]
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1200]}"]
        bad += bool(found)
        print(f"{'BAD' if found else 'ok ':3} {name} {time.monotonic() - started:.1f}s", *found, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
