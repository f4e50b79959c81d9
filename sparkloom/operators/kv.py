"""Ordered key-value operators over DataFrames with a key column."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.keys import valid_key


@dataclass(frozen=True)
class KeyRange:
    """Bounds of a scan; None is unbounded.  ``reverse`` turns the order before ``limit`` applies."""

    start: object = None
    end: object = None
    include_start: bool = True
    include_end: bool = False
    limit: int | None = None
    reverse: bool = False
    starts_with: str | None = None

    @classmethod
    def all(cls) -> KeyRange:
        return cls()

    @classmethod
    def from_to(cls, start, end) -> KeyRange:
        return cls(start, end)

    @classmethod
    def prefix(cls, text: str) -> KeyRange:
        """Keys that start with ``text``; the empty prefix is every key."""
        return cls(starts_with=text)

    def with_limit(self, n: int) -> KeyRange:
        return replace(self, limit=n)

    def reversed(self) -> KeyRange:
        return replace(self, reverse=not self.reverse)

    def holds(self, key: Column) -> Column:
        out = F.lit(True)
        if self.start is not None:
            out = out & ((key >= F.lit(self.start)) if self.include_start else (key > F.lit(self.start)))
        if self.end is not None:
            out = out & ((key <= F.lit(self.end)) if self.include_end else (key < F.lit(self.end)))
        if self.starts_with:
            out = out & key.startswith(self.starts_with)
        return out


def scan(table: DataFrame, keys: KeyRange, key: str = "k") -> DataFrame:
    """Rows in key order.  Plain bounds on a stored column reach the Parquet scan."""
    out = table.filter(keys.holds(F.col(key)))
    out = out.orderBy(F.col(key).desc() if keys.reverse else F.col(key).asc())
    return out if keys.limit is None else out.limit(keys.limit)


def scan_prefix(table: DataFrame, prefix: str, limit: int | None = None, key: str = "k") -> DataFrame:
    keys = KeyRange.prefix(prefix)
    return scan(table, keys if limit is None else keys.with_limit(limit), key)


def seek(table: DataFrame, at, n: int, key: str = "k", after: bool = False) -> DataFrame:
    """The next ``n`` rows from the first key >= ``at`` (or > ``at``: the page after a last key)."""
    return scan(table, KeyRange(start=at, include_start=not after, limit=n), key)


def get(table: DataFrame, value, key: str = "k") -> DataFrame:
    return table.filter(F.col(key) == F.lit(value))


def exists(table: DataFrame, value, key: str = "k") -> DataFrame:
    return get(table, value, key).agg((F.count("*") > 0).alias("found"))


def batch_get(table: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    """A row for each row of ``keys`` (ordinal, key), with nulls for keys that are missing."""
    return keys.join(table, key, "left")


def key_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("key_count"))


def shard_stats(table: DataFrame, key: str = "k", value: str = "v", shard: str = "shard") -> DataFrame:
    return table.groupBy(shard).agg(F.count("*").alias("key_count"), F.sum(F.octet_length(key) + F.octet_length(value)).cast("long").alias("data_bytes"))


def checked_keys(rows: DataFrame, key: str = "k") -> DataFrame:
    """``rows``; reading them raises at a key that may not be stored."""
    bad = F.raise_error(F.concat(F.lit("invalid key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.withColumn(key, F.when(F.coalesce(valid_key(F.col(key).cast("string")), F.lit(False)), F.col(key)).otherwise(bad.cast(rows.schema[key].dataType)))


def put(table: DataFrame, rows: DataFrame, key: str = "k", order: str | None = None) -> DataFrame:
    """The table with ``rows`` written over it; of rows with one key the last by ``order`` wins.

    Invalid keys raise when the result is read, and so do keys that come twice without an ``order``.
    """
    rest = [c for c in rows.columns if c not in (key, order)]
    rows = checked_keys(rows, key)
    if order:
        rows = rows.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in rest))
    else:
        n, twice = F.col("_n"), F.raise_error(F.concat(F.lit("key written twice without an order: "), F.col(key).cast("string")))
        rows = rows.groupBy(key).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in rest))
        rows = rows.withColumn(key, F.when(n == 1, F.col(key)).otherwise(twice.cast(table.schema[key].dataType))).drop("_n")
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_one(table: DataFrame, value, key: str = "k") -> tuple[DataFrame, DataFrame]:
    """The table without a key, and whether the key was there."""
    return table.filter(F.col(key) != F.lit(value)), exists(table, value, key)


def delete_count(table: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    """How many of the keys existed."""
    return table.join(keys.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("deleted"))


def last_by_key(log: DataFrame, key: str, order: list[str], tombstone: Column | None = None) -> DataFrame:
    """The newest row of each key; keys whose newest row is a tombstone are gone.  One hash aggregate."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))
    return newest if tombstone is None else newest.filter(~tombstone)


def top_per_key(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
