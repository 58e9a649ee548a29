"""Named queries over the benchmark tables, each with the same result in plain SQL where SQL can say it."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pulse.plans import views


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, uses: str = "posts"):
    """Register a function (spark, folder) -> DataFrame; `uses` names the views the SQL reads."""

    def add(run):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(run, views.select(uses.split(), sql) if sql else None)
        return run

    return add
