"""The registered queries, each with the SQL that gives the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, folder of the tables) under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Common table expressions of the SQL: one row of each key.
ONCE = {
    "c": "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_key ORDER BY ingested_at DESC) = 1)",
    "n": "n AS (SELECT * FROM nlp_chunks QUALIFY row_number() OVER (PARTITION BY chunk_key) = 1)",
    "f": "f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1)",
}
