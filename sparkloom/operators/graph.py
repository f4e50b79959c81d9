"""Graph operators over nodes (id, label, ...) and edges (src, dst, type, ...).

Traversals are bounded loops of joins.  A frontier holds nodes, not paths, so repeated visits collapse in
an aggregate each hop.  Each hop cuts the lineage, as the next one reads the frontier twice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.scratch import cut


def scan_nodes(nodes: DataFrame, label: str | None = None) -> DataFrame:
    """Nodes with a label; a node has one (label) or several (labels)."""
    if label is None:
        return nodes
    return nodes.filter(F.array_contains("labels", label) if "labels" in nodes.columns else F.col("label") == label)


def node_property(name: str, kind: str = "string") -> Column:
    """A property of a node or edge whose properties are a map of texts (props); null where it has none."""
    return F.try_element_at("props", F.lit(name)).try_cast(kind)


def scan_edges(edges: DataFrame, kind: str | None = None) -> DataFrame:
    return edges if kind is None else edges.filter(F.col("type") == kind)


def directed(edges: DataFrame, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """(src, dst, type) in the direction of travel: out, in, or both."""
    e = edges.select("src", "dst", "type")
    e = e.filter(F.col("type").isin(*kinds)) if kinds else e
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return e if direction == "out" else back if direction == "in" else e.union(back)


def expand(rows: DataFrame, edges: DataFrame, at: str = "id", direction: str = "out", kinds: list[str] | None = None, to: str = "neighbor", optional: bool = False) -> DataFrame:
    """A hop from the nodes in column ``at``; optional keeps rows without one."""
    e = directed(edges, direction, kinds).select(F.col("src").alias("_src"), F.col("dst").alias(to), F.col("type").alias(f"{to}_type"))
    return rows.join(e, F.col(at) == F.col("_src"), "left" if optional else "inner").drop("_src")


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def get_edges(edges: DataFrame, src: str, dst: str, kind: str | None = None) -> DataFrame:
    return scan_edges(edges.filter((F.col("src") == src) & (F.col("dst") == dst)), kind)


def put_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes created, or replaced where the id exists."""
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(new.select(*nodes.columns))


def put_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges created, or replaced where (src, dst, type) exists; an edge needs both its nodes, others are left out."""
    # only the ids that the new edges name: the nodes are filtered where they are, if those are few
    named = new.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ids = nodes.select("id").join(named, "id", "left_semi").distinct()
    sound = new.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    return edges.join(sound.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti").unionByName(sound.select(*edges.columns))


def traverse(start: DataFrame, edges: DataFrame, max_depth: int, direction: str = "out", kinds: list[str] | None = None, nodes: DataFrame | None = None, edge_filter: Column | None = None) -> DataFrame:
    """(id, depth): every node within ``max_depth`` hops of ``start`` (id), at its least depth.

    With ``nodes``, a hop only reaches nodes that are in it; with ``edge_filter``, it only takes edges that satisfy it.
    """
    edges = edges if edge_filter is None else edges.filter(edge_filter)
    e = directed(edges, direction, kinds).select("src", "dst")
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for hop in range(1, max_depth + 1):
        nxt = frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        if nodes is not None:
            nxt = nxt.join(nodes.select("id"), "id", "left_semi")
        frontier = nxt.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(hop))
        frontier = cut(frontier) if hop < max_depth else frontier
        seen = seen.union(frontier)
    return seen


def shortest_path_length(edges: DataFrame, start: DataFrame, target: str, max_depth: int, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    return traverse(start, edges, max_depth, direction, kinds).filter(F.col("id") == target).select(F.col("id").alias("target"), "depth")


def has_path(edges: DataFrame, start: DataFrame, target: str, max_depth: int, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    return shortest_path_length(edges, start, target, max_depth, direction, kinds).agg((F.count("*") > 0).alias("found"))


def find_paths(edges: DataFrame, start: DataFrame, target: str, max_depth: int, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """(path, depth): simple paths of at most ``max_depth`` hops; nodes that can't reach the target in time are cut first."""
    e = directed(edges, direction, kinds).select("src", "dst").distinct()
    back = {"out": "in", "in": "out", "both": "both"}[direction]
    goal = edges.sparkSession.createDataFrame([(target,)], "id string")
    room = traverse(goal, edges, max_depth, back, kinds).select(F.col("id").alias("dst"), F.col("depth").alias("left"))
    useful = e.join(room, "dst")
    paths = start.select(F.array("id").alias("path"), F.col("id").alias("at"))
    found = None
    for hop in range(1, max_depth + 1):
        step = paths.join(useful, F.col("at") == F.col("src")).filter((F.col("left") <= max_depth - hop) & ~F.array_contains("path", F.col("dst")))
        paths = cut(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
        done = paths.filter(F.col("at") == target).select("path", F.lit(hop).alias("depth"))
        found = done if found is None else found.union(done)
        paths = paths.filter(F.col("at") != target)
    return found


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given ids; incident edges go too."""
    ids = gone.select("id").distinct()
    left = edges.join(ids, F.col("src") == F.col("id"), "left_anti").join(ids, F.col("dst") == F.col("id"), "left_anti")
    return nodes.join(ids, "id", "left_anti"), left


_NODE = re.compile(r"\((\w+)(?::(\w+))?\)")
_EDGE = re.compile(r"(<?)-\[(?:(\w+))?(?::(\w+))?\]-(>?)")


def match(nodes: DataFrame, edges: DataFrame, pattern: str, returns: list[str] | None = None, where: dict[str, Column] | None = None) -> DataFrame:
    """Rows of node ids, a column per variable, for a pattern such as ``(a:Customer)-[:PLACED]->(b:Order)``.

    Edges may repeat within a match.  A variable that occurs again must be the same node.  ``where`` holds, by
    variable, a condition on that node's columns; it applies before the joins.
    """
    text, at = pattern.replace(" ", ""), 0
    node = _NODE.match(text, at)
    if not node:
        raise ValueError(f"not a pattern: {pattern}")

    def labelled(label: str | None, name: str, as_: str | None = None) -> DataFrame:
        found = scan_nodes(nodes, label)
        return (found.filter(where[name]) if where and name in where else found).select(F.col("id").alias(as_ or name))

    here = node[1]
    rows, bound, at = labelled(node[2], here), {here}, node.end()
    while at < len(text):
        edge = _EDGE.match(text, at)
        after = edge and _NODE.match(text, edge.end())
        if not after:
            raise ValueError(f"not a pattern: {pattern}")
        direction = "in" if edge[1] else "out" if edge[4] else "both"
        name = after[1]
        there = name if name not in bound else f"_{name}_again"
        rows = expand(rows, edges, here, direction, [edge[3]] if edge[3] else None, there)
        rows = rows.withColumnRenamed(f"{there}_type", edge[2]) if edge[2] else rows.drop(f"{there}_type")
        if after[2] or (where and name in where):
            rows = rows.join(labelled(after[2], name, there), there, "left_semi")
        if there != name:
            rows = rows.filter(F.col(there) == F.col(name)).drop(there)
        bound.add(name)
        here, at = name, after.end()
    return rows.select(*returns) if returns else rows


def construct_paths(rows: DataFrame, node_columns: list[str], edge_columns: list[str]) -> DataFrame:
    return rows.withColumn("path", F.struct(F.array(*node_columns).alias("nodes"), F.array(*edge_columns).alias("edges")))
