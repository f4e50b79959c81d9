"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


HUBS = 1000  # nodes with over 1 / HUBS of all edge ends, fewer than HUBS, are joined by broadcast
HUB_ENDS = 100_000  # so many ends of one node do no harm


def _with_least(edges: DataFrame, ends: int) -> DataFrame:
    """``edges`` (a, b), ``ends`` in number, with m, the least b of each a.  A hub's edges stay where they are."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if ends <= HUB_ENDS:
        return edges.join(least.drop("n"), "a")
    hub = (F.col("n") > HUB_ENDS) & (F.col("n") * HUBS > ends)
    hubs = F.broadcast(least.filter(hub).drop("n"))
    rest = edges.join(hubs, "a", "left_anti").join(least.filter(~hub).drop("n"), "a")
    return edges.join(hubs, "a").unionByName(rest)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = _with_least(both, 2 * n).withColumn("m", F.least("a", "m"))
    return known.filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    # edges (``n`` or fewer) point from the larger id to the smaller, and each node's least end stays its own
    known = _with_least(edges, n)
    return known.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node that an edge (a, b) touches; component is the least id reachable.

    Self-links and repeated edges are harmless; edges with a null end are ignored.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    state = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == state or not new[0]:
            break
        state = new
        old, now = now, stored(_small_star(_large_star(now, new[0]), 2 * new[0]), tag)
        discard(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
