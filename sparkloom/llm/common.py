"""Shared pieces of the training-data operators: scratch tables, text blocks, key exchange.

Scratch tables are Parquet files in the folder named by ``spark.checkpoint.dir`` (a store that the
driver and every executor share); they cut lineage, so a lost executor costs a re-read and no more.

*Blocks* pack about ``BLOCK_BYTES`` of consecutive documents into one row.  The *key exchange* sends
each block's distinct 64- or 128-bit keys, with their counts, to shards of the key space and returns the
total of each key over all blocks, or its class by thresholds.  A block sends a key once however often it
holds it, so a key shared by a third of all rows costs a shard one entry per block.  A block makes a row for
each shard that it has keys for.  Beyond ``FAN`` shards the exchange takes two levels, so that the rows do
not grow as blocks times shards: blocks ask coarse shards, and a relay for each coarse shard and bundle of
blocks merges what its bundle asks, asks the fine shards, and hands the answers back.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
SHARD_BYTES = 12 << 20
BLOCK_SCHEMA = "block long, n_docs int, ids binary, nulls binary, lens binary, payload binary"


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts can't fill a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def tidy() -> None:
    """Give freed memory back: Python workers stay for later stages, and share their executor's memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode, where none need be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return base.rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read back.  What is left there goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _WRITTEN.append((spark, path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            _delete(df.sparkSession, path)
            _WRITTEN[:] = [w for w in _WRITTEN if w[1] != path]


def written() -> int:
    """How many scratch tables there are: a mark for ``release``."""
    return len(_WRITTEN)


def release(since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the scratch tables written after a mark, but for ``keep``: their results have been written."""
    kept = getattr(keep, "_scratch_path", None)
    for spark, path in _WRITTEN[since:]:
        if path != kept:
            _delete(spark, path)
    _WRITTEN[since:] = [w for w in _WRITTEN[since:] if w[1] == kept]


@atexit.register
def _release_all() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        release()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- blocks


def _block_row(block: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    import zstandard

    raw = np.array([0 if i is None else i for i in ids], dtype="<i8").tobytes()
    nulls = np.packbits(np.array([i is None for i in ids], dtype=bool)).tobytes()
    lens = np.array([len(t) for t in texts], dtype="<i4").tobytes()
    body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([len(ids)], pa.int32()), *(pa.array([x], pa.binary()) for x in (raw, nulls, lens, body))],
        names=["block", "n_docs", "ids", "nulls", "lens", "payload"],
    )


def unpack(row) -> tuple[list, list[bytes]]:
    """(ids, texts) of a block row; a null id is None."""
    import zstandard

    n = int(row.n_docs)
    ids = np.frombuffer(row.ids, dtype="<i8").tolist()
    gone = np.unpackbits(np.frombuffer(row.nulls, dtype=np.uint8), count=n)
    ids = [None if g else i for i, g in zip(ids, gone.tolist())]
    body = zstandard.ZstdDecompressor().decompress(row.payload, max_output_size=max(1, int(np.frombuffer(row.lens, dtype="<i4").sum())))
    ends = np.cumsum(np.frombuffer(row.lens, dtype="<i4")).tolist()
    return ids, [body[a:b] for a, b in zip([0, *ends], ends)]


def to_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of consecutive documents; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t or b""
                ids.append(i)
                texts.append(t)
                size += len(t) + 16
                if size >= block_bytes:
                    yield _block_row(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield _block_row(number, ids, texts)
        tidy()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, BLOCK_SCHEMA)


# ---------------------------------------------------------------- key exchange

REQUEST = "shard int, part int, block long, n int, keys binary, counts binary"
REPLY = "block long, part int, shard int, n int, totals binary, known long, mass long"
FAN = 512


class Shards(NamedTuple):
    """The shards of a key space, and how many (coarse) shards blocks ask."""

    n: int
    fan: int


def shards_for(spark: SparkSession, total_bytes: float) -> Shards:
    n = max(partitions(spark), math.ceil(total_bytes / SHARD_BYTES), 1)
    return Shards(n, n if n <= FAN else math.isqrt(n - 1) + 1)


def shard_of(first: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each key, by the key's first 64 bits and in their order."""
    return (first >> np.uint64(33)).astype(np.int64) * n_shards >> 31


def slices(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(number, start, end) of the runs of equal numbers."""
    if not len(numbers):
        return []
    ends = np.concatenate([np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]])
    starts = np.concatenate([[0], ends[:-1]])
    return list(zip(numbers[starts].tolist(), starts.tolist(), ends.tolist()))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys: (n, w) of uint64.  Sorted distinct rows, and the inverse."""
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys[:, 0])
    s = keys[order]
    if keys.shape[1] > 1 and ((s[1:, 0] == s[:-1, 0]) & (s[1:] != s[:-1]).any(axis=1)).any():
        order = np.lexsort(keys.T[::-1])
        s = keys[order]
    new = np.ones(n, bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], inverse


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of (n, w) keys, and how often each came."""
    uniq, inverse = distinct(keys)
    return uniq, np.bincount(inverse, minlength=len(uniq))


def _squeezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _stretched(data: bytes, size: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, size))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the first words as differences, byte by byte (the leading bytes are mostly zero)."""
    steps = np.diff(keys[:, 0], prepend=np.uint64(0)).astype("<u8")
    first = _squeezed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())
    return len(first).to_bytes(4, "little") + first + np.ascontiguousarray(keys[:, 1:], "<u8").tobytes()


def unpack_keys(data: bytes, n: int, width: int) -> np.ndarray:
    size = 4 + int.from_bytes(data[:4], "little")
    flat = np.frombuffer(_stretched(data[4:size], 8 * n), np.uint8)
    out = np.empty((n, width), np.uint64)
    out[:, 0] = np.cumsum(np.ascontiguousarray(flat.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)
    out[:, 1:] = np.frombuffer(data, "<u8", offset=size).reshape(n, width - 1)
    return out


def pack_ints(values: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2**63, in the least of 1, 2, 4 or 8 bytes that holds them all."""
    most = int(values.max()) if len(values) else 0
    size = next(k for k in (1, 2, 4, 8) if most < 1 << (8 * k - (k == 8)))
    return bytes([size]) + _squeezed(values.astype(f"<u{size}").tobytes())


def unpack_ints(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(_stretched(data[1:], data[0] * n), f"<u{data[0]}").astype(np.int64)


def request_rows(block: int, keys: np.ndarray, counts: np.ndarray, shards: Shards, part: int = 0) -> list[dict]:
    """Rows of REQUEST for a block's sorted distinct keys."""
    return [
        {"shard": s, "part": part, "block": block, "n": b - a, "keys": pack_keys(keys[a:b]), "counts": pack_ints(counts[a:b])}
        for s, a, b in slices(shard_of(keys[:, 0], shards.fan))
    ]


def _merged(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the requests of a shard: sorted distinct keys, their sums, each entry's key, and the ends of the requests."""
    ns = pdf["n"].to_numpy(np.int64)
    keys = np.concatenate([unpack_keys(k, int(n), width) for k, n in zip(pdf["keys"], ns)])
    counts = np.concatenate([unpack_ints(c, int(n)) for c, n in zip(pdf["counts"], ns)])
    uniq, inverse = distinct(keys)
    # sums are exact below 2**53
    return uniq, np.bincount(inverse, weights=counts, minlength=len(uniq)).astype(np.int64), inverse, np.cumsum(ns)


def _replies(pdf: pd.DataFrame, values: np.ndarray, ends: np.ndarray, known: int, mass: int) -> pd.DataFrame:
    rest = [0] * (len(pdf) - 1)
    totals = [pack_ints(values[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist())]
    return pd.DataFrame({"block": pdf["block"].to_numpy(), "part": pdf["part"].to_numpy(), "shard": pdf["shard"].to_numpy(), "n": pdf["n"].to_numpy(), "totals": totals, "known": [known, *rest], "mass": [mass, *rest]})


def exchange(requests: DataFrame, shards: Shards, width: int, classes: tuple = (), skip: int | None = None) -> DataFrame:
    """REPLY rows for REQUEST rows: the total of each requested key, or the number of ``classes`` (rising
    thresholds) that the total reaches.

    The rows of a shard hold, once, known (its distinct keys with a total above 0) and mass (the sum of their
    totals); the key ``skip`` counts for neither.
    """

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        uniq, total, inverse, ends = _merged(pdf, width)
        own = total > 0 if skip is None else (total > 0) & (uniq[:, 0] != np.uint64(skip))
        value = np.searchsorted(np.array(classes), total, side="right") if classes else total
        return _replies(pdf, value[inverse], ends, int(own.sum()), int(total[own].sum()))

    if shards.fan == shards.n:
        return requests.groupBy("shard", "part").applyInPandas(answer, REPLY)
    n_bundles = math.ceil(shards.n / shards.fan)

    def relay(pdf: pd.DataFrame) -> pd.DataFrame:
        uniq, total, _, _ = _merged(pdf, width)
        number, part = int(pdf["shard"].iloc[0]) * n_bundles + int(pdf["bundle"].iloc[0]), int(pdf["part"].iloc[0])
        rows = [
            {"shard": s, "part": part, "block": number, "n": b - a, "keys": pack_keys(uniq[a:b]), "counts": pack_ints(total[a:b])}
            for s, a, b in slices(shard_of(uniq[:, 0], shards.n))
        ]
        return pd.DataFrame(rows)

    def back(asked: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        _, _, inverse, ends = _merged(asked, width)
        return _replies(asked, totals_of(got)[inverse], ends, int(got["known"].sum()), int(got["mass"].sum()))

    held = stored(requests.withColumn("bundle", F.pmod(F.xxhash64("block"), F.lit(n_bundles)).cast("int")), "exchange-held", "none")
    fine = held.groupBy("shard", "part", "bundle").applyInPandas(relay, REQUEST).groupBy("shard", "part").applyInPandas(answer, REPLY)
    fine = fine.selectExpr("*", f"cast(block div {n_bundles} as int) as c", "part as p", f"cast(block % {n_bundles} as int) as b")
    return held.groupBy("shard", "part", "bundle").cogroup(fine.groupBy("c", "p", "b")).applyInPandas(back, REPLY)


def totals_of(replies: pd.DataFrame) -> np.ndarray:
    """Replies to a block (or relay) in key order, as one array."""
    if not len(replies):
        return np.zeros(0, np.int64)
    r = replies.sort_values("shard")
    return np.concatenate([unpack_ints(t, int(n)) for t, n in zip(r["totals"], r["n"])])


def per_block(blocks: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(row) -> list of dicts``, over blocks, a row at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = fn(row)
                if len(out):
                    yield out if isinstance(out, pd.DataFrame) else pd.DataFrame(out, columns=names)
        tidy()

    return blocks.mapInPandas(run, schema)


def with_replies(blocks: DataFrame, replies: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(row, replies) -> DataFrame or list of dicts``, once per block."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [fn(row, right) for row in left.itertuples(index=False)]
        parts = [p if isinstance(p, pd.DataFrame) else pd.DataFrame(p, columns=names) for p in parts if len(p)]
        tidy()
        return pd.concat(parts) if parts else pd.DataFrame(columns=names)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, schema)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads the bits of uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        import xxhash

        self.limit, self.hash = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.hash(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_WORDS: list[WordHashes] = []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words, by a cache that lives as long as the Python worker."""
    if not _WORDS:
        _WORDS.append(WordHashes())
    return _WORDS[0].of(words)


_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def rolling(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Mixed polynomial hashes, modulo 2**64, of every run of ``width`` values."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    m = np.uint64(_MULTIPLIERS[which])
    inv = np.uint64(pow(_MULTIPLIERS[which], -1, 1 << 64))
    up, down = np.full(n, m), np.full(n - width + 1, inv)
    up[0], down[0] = 1, 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    up *= values
    np.add.accumulate(up, out=up)
    sums = up[width - 1 :].copy()
    sums[1:] -= up[: n - width]
    return mix(sums * down)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the positions that runs of ``width`` from ``starts`` cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + width, n), 1)
    return np.cumsum(edge[:n]) > 0
