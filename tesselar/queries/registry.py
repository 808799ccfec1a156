"""Where queries register, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselar import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = False) -> Callable[[Query], Query]:
    """Registers a function under its name. graph: the SQL refers to the tables `nodes` and `edges` of the graph."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {tables.SQL}{', ' if sql.lstrip().upper().startswith('WITH') else ''}" + sql.lstrip().removeprefix("WITH RECURSIVE ").removeprefix("WITH ")) if graph else sql
        return f

    return add
