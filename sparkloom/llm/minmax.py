"""Near-duplicate documents by min-max hashing of word shingles.

Each permutation of the shingles gives two values of the signature, the least and the largest, so 128
values cost 64 hash evaluations a shingle.  Two permutations (four values) make a band.  At a similarity
of 0.75 the chance that no band of 32 agrees is (1 - 0.75**4)**32, about five in a million, for large sets.  In small sets the least and the largest
value go together: of 3 shingles inside 4 both agree with a chance of 0.5, so the miss is 0.75**32, 1e-4.

Documents with equal shingle sets are one class from the start, and only classes are compared.  In a
bucket (classes that agree in a band) the first comparison is of each class with the most central one,
which shares the largest buckets.  Links are confirmed on whole sets, and classes that are linked already
need no comparison.  Then, in the buckets that still hold several components, every class outside the
bucket's largest component is compared with every class of another component: all of them on whole sets,
but for pairs that sizes or parities (see ``parities``) prove to be below the threshold.  These bounds are
exact, so only the bands can miss a link, no candidate is capped, and a bucket of copies costs a pair per
class, not per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, rolling, stored, tidy, tune, word_hashes
from .components import components

PERMUTATIONS = 64
PERMS_PER_BAND = 2
_CHUNK = 1 << 16


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    if len(words) < width:
        return mix(rolling(h, len(words)) + np.uint64(len(words)))
    return np.unique(rolling(h, width))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, 2 * PERMUTATIONS) of uint32: least and largest value under each permutation.  No set is empty."""
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values, out = np.concatenate(sets), np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    for p, m in enumerate(_multipliers()):
        x = values * m
        out[:, 2 * p] = np.minimum.reduceat(x, at) >> np.uint64(32)
        out[:, 2 * p + 1] = np.maximum.reduceat(x, at) >> np.uint64(32)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """(documents, bands) of int64 bucket keys."""
    n_bands = PERMUTATIONS // PERMS_PER_BAND
    parts = sig.reshape(len(sig), n_bands, 2 * PERMS_PER_BAND).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, n_bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(2 * PERMS_PER_BAND):
        key = mix(key ^ parts[:, :, i])
    return key.view(np.int64)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _signed(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, held = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                sets.append(shingles(t or b"", width))
                held += len(sets[-1])
                if held >= _CHUNK:
                    yield emit(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield emit(ids, sets)
        tidy()

    def emit(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        rows = iter(signatures(full)) if full else iter(())
        prints = [_fingerprint(s) for s in sets]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()), pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
            names=["doc_id", "n_shingles", "fp1", "fp2", "sig"],
        )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary")


def _banded(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bands(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1))
                reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(reps)], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, set) of the wanted classes, from the texts of the documents that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                sub = batch.slice(a, 100)
                sets = [shingles(t or b"", width) for t in sub.column(1).to_pylist()]
                prints = [_fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [sub.column(0), pa.array([x for x, _ in prints], pa.int64()), pa.array([x for _, x in prints], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rep", "fp1", "fp2", "set"]
                )
        tidy()

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("binary").alias("text")).join(wanted.hint("merge"), "rep", "left_semi")
    return texts.mapInArrow(run, "rep long, fp1 long, fp2 long, set array<long>").join(classes.select("rep", "fp1", "fp2"), ["rep", "fp1", "fp2"], "left_semi").dropDuplicates(["rep", "fp1", "fp2"]).select("rep", "set")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets agree: percent * union <= 100 * intersection."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = pairs.join(left, "a").filter(F.size("x") > 0).join(right, "b")
    near = near.filter((100 * F.least(F.size("x"), F.size("y")) >= percent * F.greatest(F.size("x"), F.size("y"))))
    return near.filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that links of similarity ``percent`` / 100 or more hold together.

    A document's set: its distinct shingles of ``width`` words (runs of bytes other than ASCII white space,
    A-Z as a-z); with fewer words the whole sequence is its one shingle.  Returns one row per input row:
    the id, n_shingles, component_id (the least id reachable by links, its own included) and kept (the id
    is its component's).

    Null and empty texts have empty sets and link with nothing; documents with equal sets always link.
    Rows with a null id get the component of their set but never name or join one; with no other row in
    it, component_id is null and kept is false.  Rows that repeat an id are one node.  An empty table
    gives an empty result; other columns are not read.
    """
    tune(docs.sparkSession)
    signed = stored(_signed(docs, width, id_col, text_col), "minmax-signed")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "minmax-classes")
    # ids that stand in several classes (repeated with other texts) tie them together
    same_id = full.select("doc_id", "fp1", "fp2").distinct().join(classes.select("fp1", "fp2", "rep"), ["fp1", "fp2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    banded = _banded(classes)
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(banded.join(shared, "key"), "minmax-buckets")
    # the texts that copies were made from share large buckets in most bands: they are the best pivots
    central = buckets.groupBy("rep").agg(F.sum("n").alias("weight"))
    buckets = stored(buckets.join(central, "rep"), "minmax-buckets")
    sets = stored(_sets(docs, classes, buckets.select("rep").distinct(), width, id_col, text_col), "minmax-sets", "none")

    rows = buckets.withColumn("component", F.col("rep"))
    order = F.struct("weight", -F.col("rep"))
    tried, links = _pivoted(rows, order, None, sets, percent)
    rows = _labelled(buckets, links)
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    major = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"))
    sketched = rows.join(_keys(classes), "rep").join(_sketches(sets), "rep").join(major, "key")
    minor = sketched.filter("component <> major").select("key", F.col("rep").alias("r"), F.col("component").alias("c"), F.col("sketch").alias("other"), F.col("keys").alias("their_keys"), F.col("n_shingles").alias("m"))
    sketched = sketched.select("key", "rep", "component", "major", "sketch", "keys", "n_shingles")
    on = (sketched["key"] == minor["key"]) & (F.col("component") != F.col("c")) & ((F.col("component") == F.col("major")) | (F.col("rep") > F.col("r")))
    on = on & (100 * F.least("n_shingles", "m") >= percent * F.greatest("n_shingles", "m"))
    # sets of that similarity have at most this many shingles that only one of them holds
    on = on & ((100 + percent) * _differing(F.col("sketch"), F.col("other")) <= (100 - percent) * (F.col("n_shingles") + F.col("m")))
    # a pair that shares several buckets meets in the least one
    on = on & (F.array_min(F.array_intersect("keys", "their_keys")) == sketched["key"])
    rest = sketched.join(minor, on).select(F.greatest("rep", "r").alias("a"), F.least("rep", "r").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    links = links.union(_confirmed(rest, sets, percent))
    found = components(links.union(same_id), "minmax-components")
    named = classes.select("fp1", "fp2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("sig").join(named, ["fp1", "fp2"], "left")
    alone = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select(F.col("doc_id").alias(id_col), "n_shingles", alone.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _pivoted(rows: DataFrame, order, tried: DataFrame | None, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of each class with its bucket's pivot, the row that is last in ``order``, and those that are links."""
    pivot = rows.groupBy("key").agg(F.max_by(F.struct("rep", "component"), order).alias("p"))
    pairs = rows.join(pivot, "key").filter("component <> p.component").select(F.greatest("rep", "p.rep").alias("a"), F.least("rep", "p.rep").alias("b")).distinct()
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    pairs = stored(pairs, "minmax-pairs")
    return pairs, stored(_confirmed(pairs, sets, percent), "minmax-links")


_MOST_BITS = 1 << 16


def _keys(classes: DataFrame) -> DataFrame:
    """(rep, keys): the bucket keys of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bands(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(keys), pa.list_(pa.int64()))], names=["rep", "keys"])

    return classes.select("rep", "sig").mapInArrow(run, "rep long, keys array<long>")


def parities(s: np.ndarray) -> np.ndarray:
    """A power of two of bits, two to four a shingle, as int64 words: whether an odd number of shingles falls on each.

    Two sets' parities, folded to the same length, differ in no more bits than there are shingles that only
    one of the sets holds.
    """
    n_bits = min(max(64, 1 << (2 * len(s) - 1).bit_length()), _MOST_BITS)
    odd = np.bincount((s & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sketches(sets: DataFrame) -> DataFrame:
    """(rep, sketch, n_shingles): the parities of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                sub = batch.slice(a, 100)
                held = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in sub.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [sub.column(0), pa.array([parities(s) for s in held], pa.list_(pa.int64())), pa.array([len(s) for s in held], pa.int64())], names=["rep", "sketch", "n_shingles"]
                )

    return sets.select("rep", "set").mapInArrow(run, "rep long, sketch array<long>, n_shingles long")


def _differing(x, y):
    """How many bits of two parities differ, at the length of the shorter; 0 where one is over twice as long."""
    w = F.least(F.size(x), F.size(y))

    def folded(z):
        halves = F.zip_with(F.slice(z, F.lit(1), w), F.slice(z, w + 1, w), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(z) == w, z).otherwise(halves)

    bits = F.aggregate(F.zip_with(folded(x), folded(y), lambda a, b: a.bitwiseXOR(b)), F.lit(0), lambda n, a: n + F.bit_count(a))
    return F.when(F.greatest(F.size(x), F.size(y)) <= 2 * w, bits).otherwise(0)


def _labelled(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """(key, rep, component) of the buckets that hold several components."""
    found = components(links, "minmax-components")
    rows = buckets.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    open_keys = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return stored(rows.join(open_keys, "key", "left_semi"), "minmax-open")


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` does not keep.

    Rows that repeat an id stay or go together.  Rows with a null id stay.
    """
    groups = near_duplicates(docs, percent, width, id_col, text_col)
    gone = stored(groups.filter(F.col(id_col).isNotNull() & ~F.col("kept")).select(F.col(id_col).alias("__loom_gone")).distinct(), "minmax-gone")
    rest = docs.join(gone, F.col(id_col).cast("long") == F.col("__loom_gone"), "left_anti")
    return rest.select(*docs.columns)
