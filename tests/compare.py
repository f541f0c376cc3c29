"""Run a query on Spark and its oracle on DuckDB and compare names, types and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

NUMERIC = {"tinyint", "smallint", "int", "bigint", "TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT"}
KINDS = {"string": "text", "VARCHAR": "text", "double": "double", "DOUBLE": "double", "boolean": "bool", "BOOLEAN": "bool"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def kind(type_name: str) -> str:
    return "int" if type_name in NUMERIC else KINDS.get(type_name, type_name)


def canonical(rows: list[list]) -> list[list[str]]:
    """Rows as text in a fixed order. Exact to the last digit, and to the sign of a zero."""
    assert not any(isinstance(v, float) and math.isnan(v) for row in rows for v in row)
    return sorted([repr(value) for value in row] for row in rows)


def spark_result(df: DataFrame) -> tuple[dict[str, str], list[list[str]]]:
    names = sorted(df.columns)
    kinds = {name: kind(dtype) for name, dtype in df.dtypes}
    rows = df.select(*[f"`{name}`" for name in names]).collect()
    return {n: kinds[n] for n in names}, canonical([list(row) for row in rows])


def oracle_result(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[dict[str, str], list[list[str]]]:
    relation = connection.sql(sql)
    kinds = {name: kind(str(dtype)) for name, dtype in zip(relation.columns, relation.types)}
    names = sorted(relation.columns)
    positions = [relation.columns.index(name) for name in names]
    rows = [[row[i] for i in positions] for row in relation.fetchall()]
    return {n: kinds[n] for n in names}, canonical(rows)
