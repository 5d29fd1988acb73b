"""All queries of the engine's own operators, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


from stoa.plans import captions, chunks, clouds, colours, editing, files, geometry, graphs, intake, labels, masks, objects, plans, poses, robots, rooms, scenes, streams, texts  # noqa: E402, F401  each registers its queries
