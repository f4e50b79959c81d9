"""The SQL front end: Spark SQL over named frames, with VECTOR_DISTANCE and MATCH ... RETURN.

``VECTOR_DISTANCE(column, [1.0, 2.0], 'cosine')`` becomes an expression of higher-order functions, so the optimizer
sees no function of ours.  ``MATCH (a:X)-[:T]->(b:Y) WHERE a.name = 'n' RETURN a, b`` becomes the joins of ``graph.match``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import graph

_DISTANCE = re.compile(r"VECTOR_DISTANCE\(\s*([\w.]+)\s*,\s*\[([^\]]*)\]\s*,\s*'(\w+)'\s*\)", re.IGNORECASE)
_MATCH = re.compile(r"^\s*MATCH\s+(.*?)(?:\s+WHERE\s+(.*?))?\s+RETURN\s+(.*?)(?:\s+LIMIT\s+(\d+))?\s*;?\s*$", re.IGNORECASE | re.DOTALL)


def _distance(found: re.Match) -> str:
    column, vector, metric = found[1], ", ".join(f"{float(x)!r}D" for x in found[2].split(",")), found[3].lower()
    a, b = f"cast({column} as array<double>)", f"array({vector})"
    total = lambda step: f"aggregate(zip_with({a}, {b}, (x, y) -> {step}), 0D, (s, x) -> s + x)"
    if metric == "dot":
        return f"(-{total('x * y')})"
    if metric == "cosine":
        return f"(1 - {total('x * y')} / (sqrt({total('x * x')}) * sqrt({total('y * y')})))"
    if metric == "manhattan":
        return total("abs(x - y)")
    if metric == "euclidean":
        return f"sqrt({total('(x - y) * (x - y)')})"
    raise ValueError(f"no such metric: {metric}")


def run(spark: SparkSession, text: str, frames: dict[str, DataFrame]) -> DataFrame:
    """The statement's rows.  MATCH reads the frames ``nodes`` and ``edges``; a condition of its WHERE is on one variable."""
    found = _MATCH.match(text)
    if not found:
        return _over(spark, _DISTANCE.sub(_distance, text), frames)
    where: dict = {}
    for part in re.split(r"\s+AND\s+", found[2] or "", flags=re.IGNORECASE):
        if part:
            names = set(re.findall(r"\b(\w+)\.\w+", part))
            if len(names) != 1:
                raise ValueError(f"a condition is on one variable: {part}")
            (name,) = names
            condition = F.expr(re.sub(rf"\b{name}\.", "", part))
            where[name] = where[name] & condition if name in where else condition
    out = graph.match(frames["nodes"], frames["edges"], found[1], [x.strip() for x in found[3].split(",")], where)
    return out.limit(int(found[4])) if found[4] else out


def _over(spark: SparkSession, text: str, frames: dict[str, DataFrame]) -> DataFrame:
    # frames are passed as arguments, so no view is left behind
    return spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in frames else m[0], text, flags=re.IGNORECASE), **frames)
