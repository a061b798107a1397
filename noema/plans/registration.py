"""Registration of queries with the DuckDB text that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noema.plans import graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None, on_graph: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its name; ``oracle`` follows the graph's tables unless it stands alone."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = graph.oracle(oracle) if on_graph else oracle
        return fn

    return register
