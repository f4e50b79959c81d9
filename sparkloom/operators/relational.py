"""The relational operators that the plan interpreter and the queries compose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {
    "count": lambda c: F.count(c), "sum": lambda c: F.sum(c), "avg": lambda c: F.avg(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c),
    "collect": lambda c: F.sort_array(F.collect_list(c)),
}


def join(left: DataFrame, right: DataFrame, on: Column | str | list, how: str = "inner") -> DataFrame:
    return left.join(right, on, how)


def semi(left: DataFrame, right: DataFrame, on: Column | str | list) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column | str | list) -> DataFrame:
    return left.join(right, on, "left_anti")


def aggregate(df: DataFrame, keys: list[str], aggs: list[tuple[str, str, str]]) -> DataFrame:
    """aggs: (function, column, name)."""
    return df.groupBy(*keys).agg(*(AGGREGATES[f](c).alias(name) for f, c, name in aggs))


def union(parts: list[DataFrame], distinct: bool = False) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if distinct else out


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
