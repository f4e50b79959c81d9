"""Key functions: FNV-1a, order-preserving encodings, key checks, shard routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the 64-bit FNV-1a hash: offset basis 0xcbf29ce484222325, prime 0x100000001b3
FNV_BASIS_HIGH, FNV_BASIS_LOW = 0xCBF29CE4, 0x84222325
FNV_PRIME_LOW = 0x1B3
_LIMB = 0xFFFFFFFF


def fnv1a(key: Column) -> Column:
    """FNV-1a of a string's or binary's bytes, as struct(hi, lo) of 32-bit limbs (no overflow under ANSI)."""
    text = F.hex(key.cast("binary"))
    size = (F.length(text) / 2).cast("int")

    def step(state: Column, i: Column) -> Column:
        byte = F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        low = state["lo"].bitwiseXOR(byte)
        product = low * FNV_PRIME_LOW
        high = (state["hi"] * FNV_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(_LIMB))
        return F.struct(high.alias("hi"), product.bitwiseAND(F.lit(_LIMB)).alias("lo"))

    start = F.struct(F.lit(FNV_BASIS_HIGH).cast("long").alias("hi"), F.lit(FNV_BASIS_LOW).cast("long").alias("lo"))
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step)


def hash_shard(key: Column, shards: int) -> Column:
    """FNV-1a modulo the number of shards."""
    h = fnv1a(key)
    return ((h["hi"] % shards) * ((1 << 32) % shards) + h["lo"]) % shards


def range_shard(key: Column, ranges: list[tuple]) -> Column:
    """Number of the first [lo, hi) range that holds the key, else 0; None is an open end."""
    out = F.lit(0)
    for i, (lo, hi) in reversed(list(enumerate(ranges))):
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (key >= F.lit(lo))
        if hi is not None:
            inside = inside & (key < F.lit(hi))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def list_shard(key: Column, lists: list[list]) -> Column:
    """Number of the first list that holds the key, else 0."""
    out = F.lit(0)
    for i, members in reversed(list(enumerate(lists))):
        out = F.when(key.isin(*members), F.lit(i)).otherwise(out)
    return out


def time_shard(seconds: Column, interval: int, shards: int) -> Column:
    """abs((seconds / interval) mod shards), both truncated toward zero; null times go to shard 0."""
    quotient = F.when(seconds < 0, F.ceil(seconds / interval)).otherwise(F.floor(seconds / interval))
    return F.coalesce(F.abs(quotient % shards), F.lit(0)).cast("int")


def valid_key(key: Column) -> Column:
    """User keys are not empty and do not start with a zero byte."""
    return (F.octet_length(key) > 0) & (F.substring(F.hex(key.cast("binary")), 1, 2) != "00")


def route_table(key: Column, sharding: dict) -> Column:
    """Shard of a row by its table's sharding: {"single": 0}, or one of {"hash": shards}, {"range": ranges}, {"list": lists}
    and {"time": (interval, shards)}."""
    (kind, arg), = sharding.items()
    if kind == "single":
        return F.lit(arg)
    if kind == "time":
        return time_shard(key, *arg)
    return {"hash": hash_shard, "range": range_shard, "list": list_shard}[kind](key, arg).cast("int")


def checksum(columns: list[str], kind: str = "crc32") -> Column:
    """Checksum of some columns: CRC-32 of their JSON text, or the 64-bit xxHash of their values."""
    return F.crc32(F.to_json(F.struct(*columns)).cast("binary")) if kind == "crc32" else F.xxhash64(*columns)


def encode_long(x: Column) -> Column:
    """Hex of a long whose order as text is the order of the numbers."""
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
