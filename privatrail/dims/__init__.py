"""Reference tables as small DataFrames. Every size is fixed by the lists in this package;
user-supplied lists (trackers, sites) are ordinary tables and are never assumed small."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}e0"
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: Iterable[Sequence[object]], columns: str) -> str:
    """``SELECT * FROM (VALUES ...)`` text that both Spark and ANSI engines accept."""
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS dim({columns})"


def dimension(spark: SparkSession, rows: Iterable[Sequence[object]], columns: str) -> DataFrame:
    """A constant table as a local relation: its size is known to the optimizer."""
    names = [c.strip() for c in columns.split(",")]
    rows = [tuple(r) for r in rows]
    if any(isinstance(v, str) and ("\\" in v or "'" in v) for r in rows for v in r):
        return spark.createDataFrame(rows, schema=names)
    return spark.sql(values_sql(rows, columns))
