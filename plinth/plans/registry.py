"""Where plans register their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with DuckDB SQL for the same rows if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of constant rows; columns as "name type, ..."."""
    names, kinds = zip(*[c.rsplit(" ", 1) for c in columns.split(", ")], strict=True)
    cast = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    body = ", ".join("(" + ", ".join(f"{literal(v)}::{cast[k]}" for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS t({', '.join(f'"{n}"' for n in names)}))"
