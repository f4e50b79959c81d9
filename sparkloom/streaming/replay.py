"""Replay of change logs, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.operators.kv import last_by_key
from sparkloom.sources import scratch


def tail(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the log's records, file by file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay(log: DataFrame, key: str = "k", order: tuple = ("lsn",), kind: str = "kind") -> DataFrame:
    """The state a log leads to: the last write of each key, without deleted keys.  Batch or stream."""
    return last_by_key(log, key, list(order), F.col(kind) == "delete")


def apply_commands(state: DataFrame, commands: DataFrame) -> DataFrame:
    """State (k, v) after commands (lsn, ops), in the order of lsn; ops is an array of (op, k, v), and a batch's later
    operations hold over its earlier ones.  Each command applies whole."""
    ops = commands.select("lsn", F.posexplode("ops").alias("_place", "_op")).select("lsn", "_place", "_op.*")
    last = last_by_key(ops, "k", ["lsn", "_place"])
    return state.join(last.select("k"), "k", "left_anti").unionByName(last.filter("op = 'put'").select(*state.columns))


def replay_into(stream: DataFrame, path: str, checkpoint: str, key: str = "k", order: str = "lsn", kind: str = "kind"):
    """Run a stream to its end, merging each micro-batch into versioned state folders under ``path``.

    A batch that is run again writes the same folder again, so the state is exactly-once.  The last two
    folders are kept.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("_r")).select(key, "_r.*")
        if epoch > 0:
            old = spark.read.parquet(f"{path}/{epoch - 1}")
            newest = old.join(newest.select(key), key, "left_anti").unionByName(newest.select(*old.columns))
        newest.write.mode("overwrite").parquet(f"{path}/{epoch}")
        # a batch that runs again reads the epoch before it, and none earlier
        scratch.remove(spark, f"{path}/{epoch - 2}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def state(spark: SparkSession, path: str, epoch: int, kind: str = "kind") -> DataFrame:
    return spark.read.parquet(f"{path}/{epoch}").filter(F.col(kind) != "delete")


def tumbling(events: DataFrame, width: str, keys: list[str], late: str | None = None, ts: str = "ts") -> DataFrame:
    """Counts and sums by window; ``late`` sets a watermark (streams)."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_ts", late) if late else e
    return e.groupBy(F.window("_ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, late: str | None = None, ts: str = "ts") -> DataFrame:
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_ts", late) if late else e
    return e.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
