"""Named queries over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from assayer.session import ship_package

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
TWINS: dict[str, str] = {}


def shipped(function: Plan) -> Plan:
    """The query with the package sent to the workers before it runs."""

    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return function(spark, folder)

    return run


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a query, with the ANSI SQL that must return the same rows."""

    def register(function: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name!r} is registered twice")
        PLANS[name] = shipped(function)
        if sql is not None:
            TWINS[name] = sql
        return function

    return register
