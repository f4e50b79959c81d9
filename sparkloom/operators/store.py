"""Writes through the front door: permission, key check, route, then apply; and shards as objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.keys import valid_key
from sparkloom.operators import catalog, kv
from sparkloom.sources.scratch import cut


def outcomes(writes: DataFrame, grants: DataFrame, implied: DataFrame, path: str) -> DataFrame:
    """``writes`` (seq, principal, op, k, v) with status: ``denied`` without write permission at ``path``, ``invalid`` for
    keys that may not be stored, else ``ok``."""
    asked = writes.groupBy("principal").agg(F.count("*").alias("_n"))
    asked = asked.join(F.broadcast(asked.agg(F.sum("_n").alias("_all"))), F.lit(True)).select("principal", (F.col("_n") * 1000 > F.col("_all")).alias("_heavy"))
    asked = cut(asked.withColumn("permission", F.lit("write")).withColumn("path", F.lit(path)))
    allowed = catalog.permitted(asked.drop("_heavy"), grants, implied).join(asked.select("principal", "_heavy"), "principal")
    status = F.when(~F.col("allowed"), "denied").when(~valid_key(F.col("k")), "invalid").otherwise("ok")
    # principals of over a thousandth of the writes, fewer than a thousand, are not shuffled by their names
    heavy, light = (allowed.filter(f).select("principal", "allowed") for f in ("_heavy", "not _heavy"))
    rest = writes.join(F.broadcast(heavy.select("principal")), "principal", "left_anti")
    judged = writes.join(F.broadcast(heavy), "principal").unionByName(rest.join(light, "principal"))
    return judged.withColumn("status", status).drop("allowed")


def apply(table: DataFrame, judged: DataFrame) -> DataFrame:
    """The table (k, v) after the writes with status ``ok``; of a key's writes the last by seq holds."""
    last = kv.last_by_key(judged.filter("status = 'ok'").select("k", "seq", "op", "v"), "k", ["seq"])
    kept = table.join(last.select("k"), "k", "left_anti")
    return kept.unionByName(last.filter("op = 'put'").select(*table.columns))


def routed(rows: DataFrame, route: Column) -> DataFrame:
    return rows.withColumn("shard", route)


def list_shards(table: DataFrame, shards: DataFrame) -> DataFrame:
    """Every shard that exists (shard), with its number of keys: 0 for empty ones."""
    held = table.groupBy("shard").agg(F.count("*").alias("n"))
    return shards.join(held, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).cast("long").alias("n_keys"))


def shard_exists(shards: DataFrame, shard) -> DataFrame:
    return shards.filter(F.col("shard") == F.lit(shard)).agg((F.count("*") > 0).alias("found"))


def create_shard(shards: DataFrame, shard) -> DataFrame:
    """The shards with one more; raises when the result is read if it existed."""
    new = shards.sparkSession.range(1).select(F.lit(shard).cast(shards.schema["shard"].dataType).alias("shard"))
    return catalog.distinct_or_raise(shards.select("shard").unionByName(new), "shard", "shard exists")


def drop_shard(table: DataFrame, shards: DataFrame, shard) -> tuple[DataFrame, DataFrame]:
    """Table and shards without a shard and its keys."""
    keep = F.col("shard") != F.lit(shard)
    return table.filter(keep), shards.filter(keep)


def clear(table: DataFrame, shard=None) -> DataFrame:
    """The table without its rows, or without those of a shard."""
    return table.filter(F.lit(False) if shard is None else F.col("shard") != F.lit(shard))
