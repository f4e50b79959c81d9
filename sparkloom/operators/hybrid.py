"""Ranking by several signals, and joins across models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import traverse


def normalized(scores: DataFrame, id_col: str, score: str, lower_is_better: bool = False) -> DataFrame:
    """Scores of a candidate list (a top-k) brought to 0..1 by their least and largest value; equal scores become 1."""
    every = Window.partitionBy()
    lo, hi = F.min(score).over(every), F.max(score).over(every)
    unit = F.when(hi == lo, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo))
    if lower_is_better:
        unit = F.when(hi == lo, F.lit(1.0)).otherwise((hi - F.col(score)) / (hi - lo))
    return scores.select(id_col, unit.alias(score))


def combine(signals: list[tuple[DataFrame, str, float, bool]], id_col: str, k: int) -> DataFrame:
    """The k best ids by the weighted sum of normalized signals.

    signals: (top-k frame, score column, weight, lower is better).  A missing signal counts 0.
    """
    out = None
    for frame, score, _, lower in signals:
        n = normalized(frame, id_col, score, lower)
        out = n if out is None else out.join(n, id_col, "full_outer")
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(s), F.lit(0.0)) * w for _, s, w, _ in signals])
    return out.select(id_col, F.round(total, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def proximity(start: DataFrame, edges: DataFrame, max_depth: int, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """(id, proximity): 1 / (1 + hops) for the nodes within ``max_depth`` hops of the start nodes."""
    return traverse(start, edges, max_depth, direction, kinds).select("id", (1 / (1 + F.col("depth"))).alias("proximity"))


def rerank(candidates: DataFrame, score: Column, id_col: str, k: int) -> DataFrame:
    """The k best of a candidate list by another score."""
    return candidates.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), id_col).limit(k)
