"""The registry of queries: a Spark callable and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(run, sql)
        return run
    return register


def load_all() -> dict[str, Query]:
    from verification import history_queries, profile_queries, repair_queries, report_queries  # noqa: F401
    return QUERIES
