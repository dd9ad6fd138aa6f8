"""Registry of runnable queries and, where SQL can say the same, their ANSI-SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from opslens.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: tuple[str, ...] = (), sql: str | None = None, recursive: bool = False):
    """Register a query. `uses` names derived views put in front of `sql` as common table expressions.

    The tables hold UTC wall-clock times, so every query runs with the session in UTC.
    """

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(uses, sql, recursive)
        return fn

    return add


def with_views(uses: tuple[str, ...], sql: str, recursive: bool = False) -> str:
    ctes = [f"{v} AS ({views.duck_sql(v)})" for v in uses]
    body = sql.strip()
    word = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("SELECT"):
        return (word + ", ".join(ctes) + " " + body) if ctes else body
    return word + ", ".join(ctes + [body])
