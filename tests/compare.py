"""Order-free comparison of a Spark result with the same query in SQL."""

from __future__ import annotations

import datetime
import glob
import math
import os
from collections import Counter

import duckdb


def database(sf: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(
        tuple((type(r[n]).__name__, _plain(r[n])) for n in names) for r in df.collect()
    )


def rows_of_sql(connection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), Counter(
        tuple((type(r[i]).__name__, _plain(r[i])) for i in order) for r in cursor.fetchall()
    )


# DuckDB's name of each Spark type the queries return.
SQL_TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def types_of(df) -> dict[str, str]:
    return {f.name: SQL_TYPES[f.dataType.simpleString()] for f in df.schema.fields}


def types_of_sql(connection, sql: str) -> dict[str, str]:
    rows = connection.execute(f"DESCRIBE {sql}").fetchall()
    return {r[0]: r[1] for r in rows}
