"""Exact dedup: tree-merge of sorted digest runs.

Each input partition sorts its texts' SHA-256 digests into runs.  Runs then meet in binomial rounds, as in a
hypercube: in round ``k`` each run is cut into ``fan_in`` slices of its range of the digest space, and the
slices of ``fan_in`` neighbouring runs for the same range are merged into one run.  So there are as many runs
in every round, of about the same size, each round sends ``fan_in`` slices a run, and after
``log(runs)`` rounds one run per range is left.  A merge keeps one entry per digest: the row that stays, and the
group's size, after checking that text lengths agree.  Equal texts collapse at the lowest round that sees
them, so a text that a third of all rows share costs one entry per run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, tune

RUN_ROWS = 250_000
HEAVY = 1000  # groups of over 1 / HEAVY of all rows, fewer than HEAVY, are joined by broadcast
RUNS = "range long, run long, digests binary, lens binary, ids binary, named binary, sizes binary"


class Run(NamedTuple):
    """Entries in the order of their digests: the text's length, the id that stays (where named), the group's size."""

    digests: np.ndarray  # S32: trailing zeros are cut, on all sides alike
    lens: np.ndarray
    ids: np.ndarray
    named: np.ndarray
    sizes: np.ndarray

    def take(self, at) -> Run:
        return Run(*(x[at] for x in self))

    def row(self, rng: int, run: int) -> tuple:
        return rng, run, *(np.ascontiguousarray(x).tobytes() for x in self)


def _load(row) -> Run:
    kinds = ("S32", "<i8", "<i8", "?", "<i8")
    return Run(*(np.frombuffer(x, k) for x, k in zip((row.digests, row.lens, row.ids, row.named, row.sizes), kinds)))


def _one_each(run: Run, keep: str) -> Run:
    """A sorted run with one entry per digest."""
    if not len(run.digests):
        return run
    new = np.concatenate([[True], run.digests[1:] != run.digests[:-1]])
    first = np.flatnonzero(new)
    if (run.lens != run.lens[first][np.cumsum(new) - 1]).any():
        raise ValueError("texts of different lengths share a digest")
    worst = np.iinfo(np.int64).max if keep == "min" else np.iinfo(np.int64).min
    best = (np.minimum if keep == "min" else np.maximum).reduceat(np.where(run.named, run.ids, worst), first)
    return Run(run.digests[first], run.lens[first], best, np.logical_or.reduceat(run.named, first), np.add.reduceat(run.sizes, first))


def merged(runs: list[Run], keep: str) -> Run:
    """Sorted runs as one, by merging neighbours until one is left; equal digests meet on the way."""
    while len(runs) > 1:
        pairs = []
        for a, b in zip(runs[::2], runs[1::2]):
            place = np.empty(len(a.digests) + len(b.digests), np.int64)
            place[np.arange(len(a.digests)) + np.searchsorted(b.digests, a.digests, "left")] = np.arange(len(a.digests))
            place[np.arange(len(b.digests)) + np.searchsorted(a.digests, b.digests, "right")] = len(a.digests) + np.arange(len(b.digests))
            pairs.append(_one_each(Run(*(np.concatenate(x) for x in zip(a, b))).take(place), keep))
        runs = pairs + runs[len(runs) & ~1 :]
    return runs[0]


def _sliced(run: Run, number: int, n_ranges: int) -> list[tuple]:
    """Rows of RUNS: the slices of a run for the ranges of the next round."""
    first = np.frombuffer(run.digests.tobytes(), ">u8")[::4]
    # 31 leading bits of the digest times the number of ranges
    ranges = (first >> np.uint64(33)).astype(np.int64) * n_ranges >> 31
    return [run.take(slice(a, b)).row(r, number) for r, a, b in slices(ranges)]


def exact_dedup(docs: DataFrame, keep: str = "min", fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts.

    Returns one row per input row: the id, keep_id (the least id of its group, or the largest with
    ``keep="max"``), group_size, kept (this row stays) and text_sha256.  Null texts count as empty.
    Texts are compared as they are, without any change.

    Rows with a null id belong to their group and count in its size but never stay, unless the whole
    group has null ids: keep_id is then null and the rows are kept.  Rows that repeat an id together
    with its text are one document given twice: both show the same keep_id and kept.  An empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(text, 256).alias("sha"), F.octet_length(text).alias("len"))
    rows = stored(rows, "exact-digests")
    # a run holds at most RUN_ROWS rows, so a partition may have several
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).agg(F.max("part").alias("last"), F.max("n").alias("most"), F.sum("n").alias("n")).first()
    per_part = max(1, math.ceil((parts["most"] or 0) / RUN_ROWS))
    n_rows, n_runs = parts["n"] or 0, ((parts["last"] or 0) + 1) * per_part
    names = [x.split()[0] for x in RUNS.split(", ")]
    n_ranges = fan_in if n_runs > 1 else 1

    def packed(held: list[Run], run: int) -> pa.RecordBatch:
        whole = Run(*(np.concatenate(x) for x in zip(*held)))
        out = _sliced(_one_each(whole.take(np.argsort(whole.digests, kind="stable")), keep), run, n_ranges)
        types = [pa.int64(), pa.int64(), *(pa.binary() for _ in names[2:])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, n = TaskContext.get().partitionId() * per_part, [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, RUN_ROWS):
                b = batch.slice(k, RUN_ROWS)
                if n + b.num_rows > RUN_ROWS:
                    # rows left over join the partition's last run
                    if run % per_part < per_part - 1:
                        yield packed(held, run)
                        run, held, n = run + 1, [], 0
                digests = np.frombuffer(bytes.fromhex("".join(b.column(1).to_pylist())), "S32")
                lens = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                ids, named = pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False), pc.is_valid(b.column(0)).to_numpy(zero_copy_only=False)
                held.append(Run(digests, lens, ids, named, np.ones(b.num_rows, np.int64)))
                n += b.num_rows
        if held:
            yield packed(held, run)

    def merge_to(n_ranges: int):
        def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_sliced(merged([_load(r) for r in pdf.itertuples(index=False)], keep), int(key[1]), n_ranges), columns=names)

        return merge

    level = rows.mapInArrow(runs, RUNS)
    while n_runs > 1:
        n_runs = math.ceil(n_runs / fan_in)
        n_ranges = n_ranges * fan_in if n_runs > 1 else n_ranges

        level = level.groupBy("range", F.floor(F.col("run") / fan_in).cast("long").alias("run")).applyInPandas(merge_to(n_ranges), RUNS)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                run = _load(row)
                raw = run.digests.tobytes()
                yield pd.DataFrame({"sha": [raw[j : j + 32].hex() for j in range(0, len(raw), 32)], "best": pd.array(run.ids, "Int64"), "named": run.named, "group_size": run.sizes})

    groups = level.mapInPandas(entries, "sha string, best long, named boolean, group_size long").withColumn("best", F.when(F.col("named"), F.col("best"))).drop("named")
    groups = stored(groups, "exact-groups")
    heavy = F.broadcast(groups.filter(F.col("group_size") * HEAVY > n_rows))
    light = rows.join(heavy, "sha", "left_anti").join(groups.filter(F.col("group_size") * HEAVY <= n_rows), "sha")
    out = rows.join(heavy, "sha").unionByName(light)
    return out.select(F.col("id").alias(id_col), F.col("best").alias("keep_id"), "group_size", F.col("id").eqNullSafe(F.col("best")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each text: that with the least (or largest) id; of its repeats, one."""
    kept = exact_dedup(docs, keep, id_col=id_col, text_col=text_col).filter("kept or keep_id is null").select(F.col(id_col).alias("__loom_id"), F.col("text_sha256").alias("__loom_sha")).distinct()
    rows = docs.withColumn("__loom_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col("__loom_id")) & (F.col("__loom_hash") == F.col("__loom_sha")), "left_semi")
    return rows.dropDuplicates([id_col, "__loom_hash"]).select(*docs.columns)
