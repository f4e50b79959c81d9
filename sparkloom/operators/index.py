"""Secondary indexes as derived frames (indexed_value, primary_key, included...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kv import KeyRange, scan


class UniqueViolation(Exception):
    """Two primary keys claim one indexed value."""


def build(table: DataFrame, value: str, primary_key: str, included: list[str] | None = None, sparse: bool = True) -> DataFrame:
    """An index frame.  A sparse index has no entry for a null value; composite keys are structs."""
    out = table.select(F.col(value).alias("indexed_value"), F.col(primary_key).alias("primary_key"), *(included or []))
    return out.filter("indexed_value is not null") if sparse else out


def save(index: DataFrame, name: str, buckets: int = 64) -> None:
    """Persist an index as a table bucketed and sorted by value, so that look-ups and joins on it don't shuffle."""
    index.write.bucketBy(buckets, "indexed_value").sortBy("indexed_value").mode("overwrite").saveAsTable(name)


def range_scan(index: DataFrame, keys: KeyRange) -> DataFrame:
    return scan(index, keys, "indexed_value")


def exact(index: DataFrame, value) -> DataFrame:
    return index.filter(F.col("indexed_value") == F.lit(value))


def count_range(index: DataFrame, keys: KeyRange) -> DataFrame:
    return index.filter(keys.holds(F.col("indexed_value"))).agg(F.count("*").alias("entries"))


def extremes(index: DataFrame) -> DataFrame:
    return index.agg(F.min("indexed_value").alias("min_key"), F.max("indexed_value").alias("max_key"))


def violations(index: DataFrame) -> DataFrame:
    """Values that more than one primary key claims."""
    return index.groupBy("indexed_value").agg(F.countDistinct("primary_key").alias("owners")).filter("owners > 1")


def insert_unique(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with new entries; raises when an entry's value belongs to another primary key."""
    both = index.unionByName(rows).dropDuplicates(["indexed_value", "primary_key"])
    if violations(both).limit(1).count():
        raise UniqueViolation("an indexed value has two primary keys")
    return both


def fetch(index: DataFrame, table: DataFrame, primary_key: str) -> DataFrame:
    """Index entries joined back to the rows they stand for."""
    return index.join(table, F.col("primary_key") == F.col(primary_key))


def update(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries of the rows' primary keys replaced by the rows."""
    return index.join(rows.select("primary_key"), "primary_key", "left_anti").unionByName(rows, allowMissingColumns=True)


def stats(index: DataFrame) -> DataFrame:
    width = F.octet_length(F.col("indexed_value").cast("string")) + F.octet_length(F.col("primary_key").cast("string"))
    return index.agg(F.count("*").alias("entries"), F.sum(width).cast("long").alias("bytes"), F.round(F.avg(width), 6).alias("avg_entry_bytes"), F.countDistinct("indexed_value").alias("distinct_values"))


def get(index: DataFrame, primary_key) -> DataFrame:
    """The entries of a primary key."""
    return index.filter(F.col("primary_key") == F.lit(primary_key))


def delete(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The index without the entries of some primary keys (primary_key)."""
    return index.join(keys.select("primary_key"), "primary_key", "left_anti").select(*index.columns)


def build_composite(table: DataFrame, values: list[str], primary_key: str) -> DataFrame:
    """An index over several columns, in their order; entries with a null in any are left out."""
    out = table.select(F.struct(*values).alias("indexed_value"), F.col(primary_key).alias("primary_key"))
    return out.filter(" and ".join(f"indexed_value.{c} is not null" for c in values))


class HashIndex:
    """An index for exact look-ups alone."""

    def __init__(self, index: DataFrame):
        self.index = index

    def exact(self, value) -> DataFrame:
        return exact(self.index, value)

    def range_scan(self, keys: KeyRange) -> DataFrame:
        raise TypeError("a hash index has no order: ranges need an ordered index")


def query(index: DataFrame, q: dict) -> DataFrame:
    """The entries that {"exact": v}, {"exists": v}, {"prefix": p} or {"range": KeyRange} asks for; ``exists`` gives one row (found)."""
    (kind, arg), = q.items()
    if kind == "range":
        return range_scan(index, arg)
    if kind == "prefix":
        return scan(index, KeyRange.prefix(arg), "indexed_value")
    found = exact(index, arg)
    return found.agg((F.count("*") > 0).alias("found")) if kind == "exists" else found
