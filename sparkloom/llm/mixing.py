"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Every source shuffles its documents by a hash of the id and queues them twice, one pass after the
other.  A queued copy's virtual finish time is the source's cumulative size up to it, divided by the
source's target.  Copies leave in order of finish time until the total budget is spent; as the targets
add up to the budget, each source leaves off near its own target.

Both running sums (within a source, and over all copies) are taken in three steps: sums of buckets and of
wide buckets of them, running sums over either, and a running sum inside each bucket.  Buckets follow the shuffling hash
or the finish time, so a source with a third of all rows is as many buckets as its size asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
ROWS_PER_BUCKET = 4096
BUCKETS = 4096  # in a wide bucket


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target, budget) from (source, source_size).

    The budget is ``share`` times all sizes.  Sources in code point order, null last, take ``weights``
    in turn; a target stops at ``cap`` times its source's size and the excess is shared again by weight
    until none is above.  That ends at target = min(cap * size, level * weight) for the one level at which
    the targets add up to the budget.  It is found by a running sum in order of cap * size / weight: the
    sources that stop are the first ones.  There is a row per source here, not per document.
    """
    one = Window.partitionBy()
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", pick).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("ratio", F.col("full") / F.col("weight"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(one) * F.lit(float(share)))
    s = s.withColumn("full_before", F.coalesce(F.sum("full").over(upto), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    s = s.withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("weight_left"))
    # the first source, in this order, that its level does not fill sets the level of all after it
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(one)["level"]
    return s.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("full")).otherwise(F.col("level") * F.col("weight")).alias("target"), "budget")


def _running(df: DataFrame, keys: list[str], bucket: str, wide: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` by ``keys`` in order of ``bucket`` and then ``order``; null keys are groups too.

    The sums of the buckets are summed up in two steps themselves, by ``wide`` buckets of up to BUCKETS.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum")).withColumn("_wide", wide)
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    tops = sums.groupBy(*keys, "_wide").agg(F.sum("_sum").alias("_sum"))
    tops = tops.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_wide").alias("_top"), F.coalesce(F.sum("_sum").over(upto(*keys).orderBy("_wide")), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("_sum").over(upto(*keys, "_wide").orderBy(bucket)), F.lit(0))
    same = F.col("_wide") == F.col("_top")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    sums = sums.withColumn("_inner", inner).join(tops, same)
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(bucket).alias("_bucket"), (F.col("_inner") + F.col("_base")).alias("_before"))
    on = F.lit(True) & (F.col(bucket) == F.col("_bucket"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_inside", inside).join(sums, on).withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_bucket", *(f"_{k}" for k in keys))


def mix_sources(docs: DataFrame, share: float = 1.5, cap: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken.

    Returns per row: the id, size (words), source_size, target (its source's) and taken (words that the
    mix takes: size times 0, 1 or ``cap`` at most).  The result depends on the rows alone, not on their
    order or partitions.

    Null and empty texts have size 0 and nothing to take.  A null source is a source of its own, last
    in order.  Rows with equal ids queue next to each other, smaller sizes first; equal rows are alike
    and share what is taken in either order.  A table without words has targets 0.  An empty table gives
    an empty result.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = stored(rows, "mix-sizes")  # the texts are read once; several steps need the sizes
    taken = _taken(rows, share, cap, seed)
    out = taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def _taken(rows: DataFrame, share: float, cap: int, seed: str) -> DataFrame:
    """``rows`` (doc_id, source, size, ...) with source_size, target and copies."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = rows.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / ROWS_PER_BUCKET + 1, 16)))
    targets = source_targets(sizes, share, cap).select(F.col("source").alias("_source"), "source_size", "target", "budget")
    # one row per source, checked by AQE's size limit before it is broadcast
    q = rows.withColumn("shuffle", F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))).withColumn("bucket", F.substring("shuffle", 1, digits))
    q = q.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = [F.col("shuffle"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    q = _running(q, ["source"], "bucket", F.substring("bucket", 1, max(1, digits - 3)), order, "size", "upto")
    # copy 0 ends at upto, copy 1 at upto + source_size, and so on
    keys = [*rows.columns, "source_size", "target", "budget", "shuffle", "upto"]
    copies = q.filter("size > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("copy"))
    copies = copies.withColumn("finish", (F.col("upto") + F.col("copy") * F.col("source_size")) / F.col("target"))
    slots = max(1, math.ceil(n * cap / ROWS_PER_BUCKET))
    copies = copies.withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(float(cap))) * slots).cast("long"))
    leaving = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("copy"), *order]
    copies = _running(copies, [], "slot", F.floor(F.col("slot") / BUCKETS).cast("long"), leaving, "size", "spent")
    # a source's running sum tells its rows with a size apart
    mixed = copies.groupBy(*keys).agg(F.count_if(F.col("spent") <= F.col("budget")).alias("copies"))
    out = [*rows.columns, "source_size", "target", "copies"]
    return mixed.select(*out).unionByName(q.filter("size = 0").withColumn("copies", F.lit(0).cast("long")).select(*out))


def mixed_documents(docs: DataFrame, share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = stored(rows, "mix-sizes")
    # rows that agree in id, source and size are numbered on both sides
    counted = _taken(rows, share, cap, seed).withColumn("__loom_n", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("copies")))).filter("copies > 0")
    left = docs.withColumn("__loom_size", word_count(F.col("text")))
    left = left.withColumn("__loom_n", F.row_number().over(Window.partitionBy("doc_id", "source", "__loom_size").orderBy(F.xxhash64(*docs.columns))))
    right = counted.select(F.col("doc_id").alias("__loom_d"), F.col("source").alias("__loom_s"), F.col("size").alias("__loom_z"), F.col("__loom_n").alias("__loom_m"), F.col("copies").alias("__loom_copies"))
    on = left["doc_id"].eqNullSafe(right["__loom_d"]) & left["source"].eqNullSafe(right["__loom_s"]) & (left["__loom_size"] == right["__loom_z"]) & (left["__loom_n"] == right["__loom_m"])
    return left.join(right, on).withColumn("__loom_copy", F.explode(F.sequence(F.lit(1), F.col("__loom_copies").cast("int")))).select(*docs.columns)
