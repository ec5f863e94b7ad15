"""H: set operations the plain DataFrame methods do not already say in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """H1."""
    return a.unionByName(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """H2."""
    return a.unionByName(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """H3."""
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """H4."""
    return a.subtract(b)


def distinct_in_order(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """H5: each key once, placed where it came first."""
    return df.groupBy(key).agg(F.min(ordinal).alias(ordinal)).orderBy(ordinal, key)


def dropped_dependencies(everything: DataFrame, resolved: DataFrame, on: list[str]) -> DataFrame:
    """H6: dependencies whose coordinates did not survive resolution."""
    return everything.join(resolved.select(*on), on, "left_anti")
