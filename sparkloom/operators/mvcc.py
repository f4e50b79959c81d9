"""Multi-version operators over an append-only version log (key, value, commit_ts, seq).

A null value is a tombstone; commit_ts 0 or null is uncommitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kv import KeyRange, scan


def _at(log: DataFrame, ts: Column, key: str) -> DataFrame:
    visible = log.filter((F.col("commit_ts") > F.lit(0)) & (F.col("commit_ts") <= ts))
    newest = F.max_by(F.struct("v", "commit_ts"), F.struct("commit_ts", "seq")).alias("_row")
    return visible.groupBy(key).agg(newest).select(key, "_row.v", "_row.commit_ts")


def snapshot(log: DataFrame, ts, key: str = "k") -> DataFrame:
    """Every live key at ``ts`` with its newest value."""
    return _at(log, F.lit(ts), key).filter("v is not null")


def exists_at(log: DataFrame, ts, key: str = "k") -> DataFrame:
    """(key, found) for every key of the log that has a version at ``ts``."""
    return _at(log, F.lit(ts), key).select(key, F.col("v").isNotNull().alias("found"))


def conflicts(log: DataFrame, writes: DataFrame, snapshot_ts, key: str = "k") -> DataFrame:
    """Keys of the write set that someone else wrote after the snapshot, or has not yet committed."""
    late = log.filter((F.col("commit_ts") > F.lit(snapshot_ts)) | F.col("commit_ts").isNull() | (F.col("commit_ts") == 0))
    return writes.select(key).distinct().join(late.select(key), key, "left_semi")


def collect_garbage(log: DataFrame, watermark, key: str = "k") -> DataFrame:
    """Versions that some snapshot at or after the watermark may read: the newest committed, all after the
    watermark, and the newest at or before it; uncommitted versions stay."""
    order = Window.partitionBy(key, "_old").orderBy(F.desc("commit_ts"), F.desc("seq"))
    live = F.coalesce(F.col("commit_ts"), F.lit(0)) == 0
    marked = log.withColumn("_old", ~live & (F.col("commit_ts") <= F.lit(watermark)))
    return marked.withColumn("_n", F.row_number().over(order)).filter("not _old or _n = 1").drop("_old", "_n")


def compact(log: DataFrame, key: str = "k") -> DataFrame:
    """A full rewrite: the newest version of each key, without tombstones."""
    newest = log.groupBy(key).agg(F.max_by(F.struct("v", "commit_ts"), F.struct("commit_ts", "seq")).alias("_row"))
    return newest.select(key, "_row.v", "_row.commit_ts").filter("v is not null")


class Conflict(Exception):
    """A key of the write set changed after the transaction's snapshot."""


class Transaction:
    """A buffered transaction on a version log: snapshot reads, own writes first, first committer wins."""

    def __init__(self, log: DataFrame, snapshot_ts, key: str = "k"):
        self.log, self.ts, self.key = log, snapshot_ts, key
        self.writes: dict = {}

    def put(self, k, v) -> None:
        self.writes[k] = v

    def delete(self, k) -> None:
        self.writes[k] = None

    def rollback(self) -> None:
        self.writes.clear()

    def _buffer(self) -> DataFrame:
        spark = self.log.sparkSession
        kind, value = self.log.schema[self.key].dataType.simpleString(), self.log.schema["v"].dataType.simpleString()
        return spark.createDataFrame(list(self.writes.items()), f"{self.key} {kind}, v {value}")

    def view(self) -> DataFrame:
        base = snapshot(self.log, self.ts, self.key).select(self.key, "v")
        if not self.writes:
            return base
        return overlay(base, self._buffer(), self.key)

    def scan(self, keys: KeyRange) -> DataFrame:
        return scan(self.view(), keys, self.key)

    def commit(self, ts) -> DataFrame:
        """The log with the writes appended at ``ts``."""
        if not self.writes:
            return self.log
        buffer = self._buffer()
        if conflicts(self.log, buffer, self.ts, self.key).limit(1).count():
            raise Conflict(f"changed since {self.ts}")
        new = buffer.withColumn("commit_ts", F.lit(ts)).withColumn("seq", F.lit(0).cast(self.log.schema["seq"].dataType))
        return self.log.unionByName(new.select(*self.log.columns))


def begin(log: DataFrame, key: str = "k") -> Transaction:
    """A transaction at the log's newest commit."""
    return Transaction(log, log.agg(F.max("commit_ts")).first()[0] or 0, key)


def commit_next(tx: Transaction, log: DataFrame) -> DataFrame:
    """``log`` (what is committed by now) with the transaction's writes one tick after its newest commit; raises Conflict."""
    tx.log = log
    return tx.commit((log.agg(F.max("commit_ts")).first()[0] or 0) + 1)


def overlay(base: DataFrame, pending: DataFrame, key: str = "k") -> DataFrame:
    """``base`` as a transaction with the pending writes (null: delete) sees it."""
    return base.join(pending.select(key), key, "left_anti").unionByName(pending.filter("v is not null").select(*base.columns))


def read_committed(log: DataFrame, key: str = "k") -> DataFrame:
    """What a read-committed transaction sees at each statement: the newest committed version of each key."""
    newest = log.agg(F.max("commit_ts")).first()[0]
    return snapshot(log, newest, key) if newest is not None else log.limit(0)


def watermark(snapshots: DataFrame) -> DataFrame:
    """The time up to which versions may be collected: the least of the open snapshots (ts, open)."""
    return snapshots.filter("open").agg(F.min("ts").alias("watermark"))


def with_retry(run, most: int = 3, wait: float = 0.01):
    """``run()``, again after a conflict up to ``most`` times, waiting longer each time."""
    import time

    for turn in range(most + 1):
        try:
            return run()
        except Conflict:
            if turn == most:
                raise
            time.sleep(wait * (turn + 1))
