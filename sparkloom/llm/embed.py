"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c.  A rotation spreads that distance over
the dimensions; cut into blocks, it must leave some block within its proportional share of it.  So each
block is joined under its own budget.  Distinct vectors are packed once into chunks, and every two chunks
meet in a tile.  In a tile and block, the right chunk's vectors are dealt to cells by the sides of the
medians that their coordinates lie on; a left vector meets the cells that its budget reaches, and the
block's distances there give the candidates.  Each is verified by the exact cosine in double precision.
A pair counts in the first block whose budget it keeps, so the union needs no pairs to be written: a tile
returns link counts and a spanning forest of its links.

Tiles read the stored chunks as a Cartesian product, so nothing is written for a tile but its links: a
vector is shuffled once and stored once, as it came (in single precision if that holds it).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, tune
from .components import components

CHUNK = 32768  # vectors
CHUNK_BYTES = 8 << 20
MIN_CHUNKS = 8  # so that small tables keep several cores busy
CELL = 128  # vectors of a chunk in a cell, about
STRIP = 8192
_ROUNDING = 1e-5  # of a squared distance: turned vectors travel in single precision
_SLACK = 1e-4  # of a squared distance: single precision is only used to propose candidates


def _rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(71).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _parts(dims: int, n_blocks: int) -> list[slice]:
    edges = [dims * i // n_blocks for i in range(n_blocks + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _printed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dims, fp1, fp2, vec): dims 0 for vectors that link with nothing; vec as 32-bit floats if they hold it, or 64-bit ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.array([], np.float64)
                if v.is_valid and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                if not (len(x) and np.isfinite(x).all() and x.any()):
                    out.append((i, 0, 0, 0, None))
                    continue
                d = xxhash.xxh3_128_digest(x.tobytes())
                with np.errstate(over="ignore", under="ignore"):
                    short = x.astype("<f4")
                out.append((i, len(x), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), (short if (short == x).all() else x).tobytes()))
            if out:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["vec_id", "dims", "fp1", "fp2", "vec"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(run, "vec_id long, dims int, fp1 long, fp2 long, vec binary")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision whatever their scale."""
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _chunked(classes: DataFrame, rows: int) -> DataFrame:
    """Chunks of up to ``rows`` classes of the same dims and precision, as they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, sizes = TaskContext.get().partitionId() << 32, {}, {}

        def packed(key: tuple[int, int]) -> pd.DataFrame:
            nonlocal number
            g = pd.concat(held.pop(key))
            del sizes[key]
            number += 1
            longs = {c: g[c].to_numpy("<i8").tobytes() for c in ("rep", "weight", "fp1", "fp2")}
            return pd.DataFrame([{"cid": number, "dims": key[0], **longs, "named": g["named"].to_numpy("u1").tobytes(), "vecs": b"".join(g["vec"])}])

        for pdf in batches:
            for key, g in pdf.groupby(["dims", pdf["vec"].map(len)]):
                limit = max(1, min(rows, CHUNK_BYTES // key[1]))
                while len(g):
                    free = limit - sum(map(len, held.get(key, ())))
                    held.setdefault(key, []).append(g.iloc[:free])
                    sizes[key] = sizes.get(key, 0) + key[1] * min(free, len(g))
                    if free <= len(g):
                        yield packed(key)
                    g = g.iloc[free:]
            while sum(sizes.values()) > 4 * CHUNK_BYTES:  # vectors of many lengths
                yield packed(max(sizes, key=sizes.get))
        for key in list(held):
            yield packed(key)

    return classes.mapInPandas(run, "cid long, dims int, rep binary, weight binary, fp1 binary, fp2 binary, named binary, vecs binary")


def _listed(chunks: DataFrame) -> DataFrame:
    """The classes of chunks, without their vectors: (dims, fp1, fp2, rep, weight, named)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                longs = {c: np.frombuffer(getattr(row, c), "<i8") for c in ("fp1", "fp2", "rep", "weight")}
                yield pd.DataFrame({"dims": row.dims, **longs, "named": np.frombuffer(row.named, "u1").astype(bool)})

    return chunks.drop("cid", "vecs").mapInPandas(run, "dims int, fp1 long, fp2 long, rep long, weight long, named boolean")


class _Chunk:
    def __init__(self, cid: int, dims: int, reps: bytes, weights: bytes, vecs: bytes):
        self.cid, self.reps, self.weights = cid, np.frombuffer(reps, "<i8"), np.frombuffer(weights, "<i8")
        n = len(self.reps)
        self.unit = _unit(np.frombuffer(vecs, f"<f{len(vecs) // (n * dims)}").reshape(n, dims).astype(np.float64))
        self.turned = (self.unit @ _rotation(dims)).astype(np.float32)


def _cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Rows of x dealt to cells: the splits of its first coordinates, the rows in the order of their cells, the side of each
    split that a cell is on, and where it starts and ends."""
    k = min(x.shape[1], max(0, (len(x) // CELL).bit_length() - 1))
    split = np.median(x[:, :k], axis=0).astype(np.float32)
    code = (x[:, :k] >= split) @ (1 << np.arange(k))
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    sides = (code[order[starts], None] >> np.arange(k) & 1).astype(np.float32)
    return split, order, sides, list(zip(starts.tolist(), [*starts[1:].tolist(), len(x)]))


def _candidates(left: np.ndarray, right: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of left and right whose squared distance may be within ``budget``."""
    split, order, sides, bounds = _cells(right)
    k, wide = len(split), left.astype(np.float64)
    # x.y - |x|^2/2 - |y|^2/2 + budget/2 >= 0, as one product
    a = np.concatenate([left, (budget / 2 - np.einsum("ij,ij->i", wide, wide) / 2)[:, None], np.ones((len(left), 1))], axis=1).astype(np.float32)
    wide = right.astype(np.float64)
    b = np.concatenate([right, np.ones((len(right), 1)), -np.einsum("ij,ij->i", wide, wide)[:, None] / 2], axis=1).astype(np.float32)
    columns = []
    for s, e in bounds:
        cell = np.zeros((a.shape[1], -(s - e) + -(e - s) % 8), np.float32)  # eight hits are told at once
        cell[:, : e - s] = b[order[s:e]].T
        cell[-1, e - s :] = -1e30
        columns.append(cell)
    for t in range(0, len(left), STRIP):
        off = left[t : t + STRIP, :k] - split
        far, near = np.minimum(off, 0) ** 2, np.maximum(off, 0) ** 2  # to the upper side, and to the lower
        reached = sides @ far.T + (1 - sides) @ near.T <= budget + _SLACK
        for cell, (s, _), reach in zip(columns, bounds, reached):
            rows = np.flatnonzero(reach)
            # of a small chunk, or a cell at many copies' place: not all at once
            for u in range(0, len(rows), step := max(1, (1 << 22) // cell.shape[1])):
                some = rows[u : u + step] + t
                hit = (a.take(some, axis=0) @ cell >= -_SLACK).reshape(-1, 8)
                eights = np.flatnonzero(hit.view(np.uint64).ravel() != 0)
                if len(eights):
                    at, bit = np.nonzero(hit[eights])
                    i, j = np.divmod(eights[at] * 8 + bit, cell.shape[1])
                    yield some[i], order[s + j]


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels, each of which is its own, after the links (u, v)."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _tile(left: _Chunk, right: _Chunk, n_blocks: int, threshold: float) -> pd.DataFrame:
    """(a, b, links) of a tile: links counted for a, or an edge (a, b)."""
    same, dims, n = left.cid == right.cid, left.unit.shape[1], len(left.reps)
    shift = 0 if same else n
    ids, weights = (left.reps, left.weights) if same else (np.concatenate([left.reps, right.reps]), np.concatenate([left.weights, right.weights]))
    parts = _parts(dims, n_blocks)
    budgets = [(2 - 2 * threshold) * (p.stop - p.start) / dims + _ROUNDING for p in parts]
    counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    step = max(1, (1 << 20) // dims)

    def verify(block: int, i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        for t in range(0, len(i), step):
            p, q = i[t : t + step], j[t : t + step]
            ok = np.einsum("ij,ij->i", left.unit[p], right.unit[q]) >= threshold
            p, q = p[ok], q[ok]
            # which block a pair counts in is told by the same single-precision numbers in every block
            gap = (left.turned[p].astype(np.float64) - right.turned[q]) ** 2
            first = np.full(len(p), -1)
            for k in range(len(parts) - 1, -1, -1):
                first[gap[:, parts[k]].sum(axis=1) <= budgets[k]] = k
            mine = first == block
            u, v = p[mine], q[mine] + shift
            if len(u):
                np.add.at(counts, u, weights[v])
                np.add.at(counts, v, weights[u])
                label = _joined(label, u, v)

    for block, own in enumerate(parts):
        held, size = [], 0
        for i, j in _candidates(left.turned[:, own], right.turned[:, own], budgets[block]):
            if same:
                i, j = i[i < j], j[i < j]
            held.append((i, j))
            size += len(i)
            if size >= step:
                verify(block, *map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            verify(block, *map(np.concatenate, zip(*held)))
    some, tied = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(label)))
    edges = pd.DataFrame({"a": ids[tied], "b": ids[label[tied]], "links": 0})
    return pd.concat([pd.DataFrame({"a": ids[some], "b": None, "links": counts[some]}), edges]).astype({"b": "Int64"})


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, n_blocks: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links between vectors whose cosine is ``threshold`` or more, and their components.

    Returns one row per input row: the id, n_links (other vectors linked directly), component_id (the least
    id reachable by links, its own included) and kept (the id is its component's).

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and so
    do vectors of different lengths.  Equal vectors are one class, so copies cost no pairs; rows that
    repeat an id are counted as vectors of their own.  Rows with a null id are links to others but never
    name a component.  An empty table gives an empty result; other columns are not read.  ``threshold``
    must be positive.
    """
    tune(vectors.sparkSession)
    # vectors are read twice, not stored twice
    whole = _printed(vectors, id_col, vec_col)
    printed = stored(whole.drop("vec"), "embed-prints")
    n = max(printed.filter("dims > 0").count(), 1)
    n_chunks = max(math.ceil(n / CHUNK), min(MIN_CHUNKS, math.ceil(n / CELL)))
    classes = whole.filter("dims > 0").groupBy("dims", "fp1", "fp2").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    # a class is named by its print where all its ids are null: no component takes that name
    classes = classes.withColumn("rep", F.coalesce(F.col("first"), F.col("fp1"))).withColumn("named", F.col("first").isNotNull())
    # few tasks, and a fifth of room: small rests of chunks would make many tiles
    chunks = stored(_chunked(classes.drop("first").coalesce(n_chunks), min(CHUNK, math.ceil(1.2 * n / n_chunks))), "embed-chunks", "none")
    classes = stored(_listed(chunks), "embed-classes")
    body = chunks.select("cid", "dims", "rep", "weight", "vecs")
    second = body.toDF("cid2", "dims2", "rep2", "weight2", "vecs2")
    # no equality: a product reads the chunks where they are, an equi-join would write them for each tile
    joined = body.join(second.hint("shuffle_replicate_nl"), F.expr("cid <= cid2 and dims between dims2 and dims2"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if left is None or left.cid != row.cid:
                    left = _Chunk(row.cid, row.dims, row.rep, row.weight, row.vecs)
                right = left if row.cid2 == row.cid else _Chunk(row.cid2, row.dims2, row.rep2, row.weight2, row.vecs2)
                out = _tile(left, right, n_blocks, threshold)
                if len(out):
                    yield out

    found = stored(joined.mapInPandas(compare, "a long, b long, links long"), "embed-links")
    discard(chunks)
    counts = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    unnamed = classes.filter("not named").select("rep")
    groups = components(found.filter("b is not null"), "embed-components")
    # a component's name: its least true id
    ids = groups.join(unnamed.select(F.col("rep").alias("node")), "node", "left_anti").groupBy("component").agg(F.min("node").alias("name"))
    groups = groups.join(ids, "component", "left").select("node", "name")
    out = classes.withColumn("first", F.when(F.col("named"), F.col("rep"))).join(counts, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    out = out.select("dims", "fp1", "fp2", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("name", "first").alias("name"))
    rows = printed.join(out, ["dims", "fp1", "fp2"], "left")
    rows = rows.select(F.col("vec_id").alias(id_col), F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).alias("n_links"), F.when(F.col("dims") > 0, F.col("name")).otherwise(F.col("vec_id")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
