"""Evaluating an expensive expression exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read instead of repeating.

    The optimizer substitutes a projected expression into every predicate it
    pushes down, so a parsed JSON value or a regex result would be computed
    again per use. A one-element explode keeps the row count and is a boundary
    that predicates on its output do not cross.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
