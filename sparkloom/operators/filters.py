"""Filter trees, JSON queries and document operations."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.catalog import distinct_or_raise

_COMPARE = {
    "eq": lambda c, v: c == F.lit(v), "ne": lambda c, v: c != F.lit(v), "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v), "lt": lambda c, v: c < F.lit(v), "lte": lambda c, v: c <= F.lit(v),
    "in": lambda c, v: c.isin(*v), "not_in": lambda c, v: ~c.isin(*v), "like": lambda c, v: c.like(v), "regex": lambda c, v: c.rlike(v),
    "contains": lambda c, v: F.array_contains(c, v), "contains_all": lambda c, v: F.size(F.array_except(F.array(*map(F.lit, v)), c)) == 0,
    "contains_any": lambda c, v: F.arrays_overlap(c, F.array(*map(F.lit, v))),
}


def field(path: str) -> Column:
    """A column, a struct field (``a.b``), or a path into a JSON text (``col:$.a.b[0]``)."""
    if ":" in path:
        column, inner = path.split(":", 1)
        return F.get_json_object(F.col(column), inner)
    return F.col(path)


def compile_filter(tree: dict) -> Column:
    """A filter tree such as ``{"and": [{"gt": ["price", 5]}, {"is_null": "note"}]}`` as a Column."""
    (op, arg), = tree.items()
    if op in ("and", "or"):
        parts = [compile_filter(x) for x in arg]
        return reduce(lambda a, b: a & b if op == "and" else a | b, parts)
    if op == "not":
        return ~compile_filter(arg)
    if op == "is_null":
        return field(arg).isNull()
    if op == "is_not_null":
        return field(arg).isNotNull()
    if op == "nested":
        return compile_filter(_below(*arg))
    if op in _COMPARE:
        return _COMPARE[op](field(arg[0]), arg[1])
    raise ValueError(f"no such filter: {op}")


def _below(path: str, tree: dict) -> dict:
    """A tree whose fields lie below a JSON column, or a path in one."""
    (op, arg), = tree.items()
    inside = lambda name: f"{path}:$.{name}" if ":" not in path else f"{path}.{name}"
    if op in ("and", "or"):
        return {op: [_below(path, x) for x in arg]}
    if op == "not":
        return {op: _below(path, arg)}
    if op == "nested":
        return _below(inside(arg[0]), arg[1])
    return {op: inside(arg)} if op in ("is_null", "is_not_null") else {op: [inside(arg[0]), *arg[1:]]}


def run_query(table: DataFrame, query: dict | str) -> DataFrame:
    """source, then filter, projection, sort, offset and limit, in that order."""
    q = json.loads(query) if isinstance(query, str) else query
    out = table
    if q.get("filter"):
        out = out.filter(compile_filter(q["filter"]))
    sort = [F.col(s["field"]).desc() if s.get("order") == "desc" else F.col(s["field"]).asc() for s in q.get("sort", [])]
    if q.get("projection"):
        out = out.select(*q["projection"], *(s["field"] for s in q.get("sort", []) if s["field"] not in q["projection"]))
    if sort:
        out = out.orderBy(*sort)
    if q.get("offset"):
        out = out.offset(q["offset"])
    if q.get("limit") is not None:
        out = out.limit(q["limit"])
    return out.select(*q["projection"]) if q.get("projection") else out


def insert_documents(docs: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """With new documents; raises when the result is read if one's key exists or comes twice."""
    return distinct_or_raise(docs.unionByName(new), key, "document exists")


def update_documents(docs: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Whole documents replaced by key; keys that don't exist are ignored."""
    known = changed.join(docs.select(key), key, "left_semi")
    return docs.join(known.select(key), key, "left_anti").unionByName(known.select(*docs.columns))


def delete_documents(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return docs.join(keys.select(key), key, "left_anti")


def unset_fields(docs: DataFrame, keys: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Documents with some fields null where the key is among ``keys``."""
    out = docs.join(keys.select(key).distinct().withColumn("_unset", F.lit(True)), key, "left")
    return out.select(*(F.when(F.col("_unset").isNull(), F.col(c)).alias(c) if c in fields else F.col(c) for c in docs.columns))


def patch_documents(docs: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Documents with the patches' non-null fields written over theirs."""
    named = patches.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in patches.columns if c != key))
    out = docs.join(named, key, "left")
    return out.select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if f"_new_{c}" in out.columns else F.col(c) for c in docs.columns))
