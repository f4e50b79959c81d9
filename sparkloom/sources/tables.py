"""Readers and writers: tables, key-value dumps, change logs, import and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions.keys import checksum
from sparkloom.operators.filters import run_query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_any(spark: SparkSession, path: str, format: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """parquet, json, csv or orc; a schema spares the pass that infers one."""
    reader = spark.read.format(format).options(**({"header": "true"} if format == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).load(path)


def export(df: DataFrame, path: str, format: str, query: dict | None = None, mode: str = "errorifexists", compression: str | None = None) -> None:
    """Write a table, or the part of it that a query (filter, projection, sort, offset, limit) selects."""
    out = run_query(df, query) if query else df
    writer = out.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", "true")
    if compression:
        writer = writer.option("compression", compression)
    writer.save(path)


def save_sharded(df: DataFrame, path: str, shard: str = "shard", key: str = "k", bloom: bool = True) -> None:
    """A key-value table by shard, sorted by key, with Bloom filters for point reads."""
    writer = df.repartition(shard).sortWithinPartitions(key).write.mode("overwrite").partitionBy(shard)
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append change records (lsn, kind, key, value, ...) to a log folder; each append is atomic."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, from_lsn: int | None = None) -> DataFrame:
    log = spark.read.parquet(path)
    return (log if from_lsn is None else log.filter(F.col("lsn") >= from_lsn)).orderBy("lsn")


def with_checksum(log: DataFrame) -> DataFrame:
    """Records with the CRC-32 of their key and value."""
    return log.withColumn("crc", F.crc32(F.concat_ws("\u0000", "k", "v").cast("binary")))


def sound_log(log: DataFrame) -> DataFrame:
    """The records before the first torn or corrupt one (lsn, k, v, crc): what a reader may trust."""
    bad = log.filter(~F.coalesce(F.col("crc") == F.crc32(F.concat_ws("\u0000", "k", "v").cast("binary")), F.lit(False))).agg(F.min("lsn").alias("_stop"))
    return log.join(F.broadcast(bad), F.lit(True)).filter(F.col("_stop").isNull() | (F.col("lsn") < F.col("_stop"))).drop("_stop")


def truncate_log(spark: SparkSession, path: str, out: str, before_lsn: int) -> None:
    """The log without records before ``before_lsn``, in a new folder."""
    spark.read.parquet(path).filter(F.col("lsn") >= before_lsn).write.parquet(out)


def evolve(df: DataFrame, schema: dict[str, tuple[str, object]], aliases: dict[str, str] | None = None) -> DataFrame:
    """A table in a newer schema {name: (type, default)}: renamed by alias, widened, filled with defaults."""
    for old, new in (aliases or {}).items():
        df = df.withColumnRenamed(old, new)
    return df.select(*((F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d)).cast(t).alias(c) for c, (t, d) in schema.items()))


def encrypt(df: DataFrame, column: str, key: bytes) -> DataFrame:
    """AES-GCM of a column; the key is 16, 24 or 32 bytes."""
    return df.withColumn(column, F.aes_encrypt(F.col(column), F.lit(key), F.lit("GCM")))


def decrypt(df: DataFrame, column: str, key: bytes) -> DataFrame:
    return df.withColumn(column, F.aes_decrypt(F.col(column), F.lit(key), F.lit("GCM")).cast("string"))


def checked(df: DataFrame, columns: list[str], kind: str = "crc32") -> DataFrame:
    return df.withColumn("checksum", checksum(columns, kind))


def corrupt(df: DataFrame, columns: list[str], kind: str = "crc32") -> DataFrame:
    """The rows whose checksum is missing or does not fit their columns."""
    return df.filter(~F.coalesce(F.col("checksum") == checksum(columns, kind), F.lit(False)))


def measured(df: DataFrame, key: str, value: str, name: str = "reads") -> tuple[DataFrame, Observation]:
    """``df`` with an observation of what is read through it: rows, bytes of keys and of values.  Costs no pass of its own."""
    seen = Observation(name)
    size = lambda c: F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).cast("long")
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), size(key).alias("key_bytes"), size(value).alias("value_bytes")), seen
