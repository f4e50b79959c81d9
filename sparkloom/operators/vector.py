"""Vector operators: exact and approximate nearest neighbours, range search, statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column, metric: str) -> Column:
    """Lower is nearer.  euclidean, cosine (1 - cosine), dot (negated product), manhattan."""
    a, b = _double(a), _double(b)
    if metric == "dot":
        return -dot(a, b)
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    if metric == "manhattan":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(d: Column, metric: str) -> Column:
    """A score in 0..1 from a distance: 1 - d/2 for cosine, 1/(1+d) otherwise."""
    return 1 - d / 2 if metric == "cosine" else 1 / (1 + d)


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def vector_of(table: DataFrame, vec_id: int, id_col: str = "vec_id", vec_col: str = "embedding") -> Column:
    """The stored vector of an id, as a literal."""
    row = table.filter(F.col(id_col) == vec_id).select(vec_col).first()
    if row is None or row[0] is None:
        raise LookupError(f"no vector {vec_id}")
    return literal(row[0])


def put(table: DataFrame, rows: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Vectors added, or replaced where the id exists."""
    return table.join(rows.select(id_col), id_col, "left_anti").unionByName(rows.select(*table.columns))


def remove(table: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return table.join(ids.select(id_col), id_col, "left_anti")


def knn(table: DataFrame, query: Column, k: int, metric: str = "euclidean", where: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows that satisfy ``where`` (a filter before the search)."""
    rows = table if where is None else table.filter(where)
    d = distance(F.col(vec_col), query, metric)
    rest = [c for c in table.columns if c not in (id_col, vec_col)]
    return rows.select(id_col, *rest, F.round(d, 6).alias("distance")).orderBy("distance", id_col).limit(k)


def within(table: DataFrame, query: Column, radius: float, metric: str = "euclidean", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    d = distance(F.col(vec_col), query, metric)
    return table.select(id_col, F.round(d, 6).alias("distance")).filter(F.col("distance") <= radius)


def vector_stats(table: DataFrame, vec_col: str = "embedding") -> DataFrame:
    v = F.col(vec_col)
    return table.agg(F.count("*").alias("vectors"), F.max(F.size(v)).alias("dimensions"), F.round(F.avg(norm(v)), 6).alias("avg_magnitude"))


CHUNK, STRIPE, STRIP = 8192, 32, 256  # vectors of a chunk, chunks of a stripe, queries that are compared at a time
_LAST = np.finfo(float).max  # the key of a distance that is not a number


def _keys(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) of numbers that order like distances, up to rounding."""
    if metric == "dot":
        return -q @ v.T
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            out = (q / -np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
        out += 1
        return out
    if metric == "manhattan":
        out = np.zeros((len(q), len(v)))
        for x, y in zip(q.T, v.T):
            out += np.abs(x[:, None] - y)
        return out
    # one product gives squared distances: -2 q v + |q|^2 + |v|^2
    ones = np.ones((len(q), 1)), np.ones((len(v), 1))
    return np.hstack([-2 * q, (q**2).sum(1)[:, None], ones[0]]) @ np.hstack([v, ones[1], (v**2).sum(1)[:, None]]).T


def _paired(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to rows: equal vectors have equal ones, wherever they stand."""
    if metric == "dot":
        return -(q * v).sum(1)
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))
    if metric == "manhattan":
        return np.abs(q - v).sum(1)
    return np.sqrt(((q - v) ** 2).sum(1))


def _slack(q: np.ndarray, v: np.ndarray, metric: str) -> float:
    """More than the rounding of ``_keys``."""
    return 1e-12 if metric == "cosine" else 1e-12 * max(1.0, (np.abs(q).max(initial=0) + np.abs(v).max(initial=0)) ** 2) * q.shape[1]


class _Best:
    """The best of the chunks that a block of queries has met."""

    def __init__(self, ids, q, keep, metric, among, codes):
        self.keep, self.metric, self.among, self.codes = keep, metric, among, codes
        self.strips = [(ids[i : i + STRIP], q[i : i + STRIP]) for i in range(0, len(ids), STRIP)]
        self.wanted = [among[0](x) if among else None for _, x in self.strips]
        self.tables = [codes[0](x) if codes else None for _, x in self.strips]
        # query, key, id and distance of what is kept, and the key that a row must not be beyond
        self.held = [(np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))] * len(self.strips)
        self.cuts = [np.full(len(x), _LAST) for _, x in self.strips]

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        marks = self.among[1](v) if self.among else None
        coded = self.codes[1](v) if self.codes else None
        for s, (own, q) in enumerate(self.strips):
            key = self.codes[2](self.tables[s], coded) if self.codes else _keys(q, v, self.metric)
            slack = 0.0 if self.codes else _slack(q, v, self.metric)
            if np.isnan(key.min()):
                key[np.isnan(key)] = _LAST
            same = np.flatnonzero(np.isin(ids, own))
            if len(same):
                key[:, same] = np.where(own[:, None] == ids[same], np.inf, key[:, same])
            cut = self.cuts[s]
            few = (cut == _LAST).any()
            if few and self.among:
                key[~self.among[2](self.wanted[s], marks)] = np.inf
            if few and len(ids) > self.keep:
                cut = np.minimum(cut, np.partition(key, self.keep - 1, axis=1)[:, self.keep - 1])
            i, j = np.divmod(np.flatnonzero(key <= np.minimum(cut + slack, _LAST)[:, None]), len(ids))
            if self.among and not few:  # what is near enough is little
                marked = self.among[3](self.wanted[s], marks, i, j)
                i, j = i[marked], j[marked]
            if not len(i):
                continue
            key = key[i, j]
            if self.codes:  # only what is kept needs a distance
                at = self._first(i, key, ids[j])
                i, j, key = i[at], j[at], key[at]
            far = np.concatenate([_paired(q[i[n : n + 65536]], v[j[n : n + 65536]], self.metric) for n in range(0, len(i), 65536)])
            i, key, far, found = (np.concatenate(x) for x in zip((self.held[s][0], self.held[s][1], self.held[s][3], self.held[s][2]), (i, key if self.codes else far, far, ids[j])))
            at = self._first(i, key, found)
            i, key, far, found = i[at], key[at], far[at], found[at]
            self.held[s] = i, key, found, far
            ends = np.cumsum(np.bincount(i, minlength=len(own)))
            full = np.diff(ends, prepend=0) == self.keep
            last = key[ends[full] - 1]
            self.cuts[s][full] = np.nan_to_num(last**2 if self.metric == "euclidean" and not self.codes else last, nan=_LAST)

    def _first(self, i: np.ndarray, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of each query's first ``keep`` by key, then id."""
        at = np.lexsort((ids, key, i))
        i = i[at]
        return at[np.arange(len(i)) - np.searchsorted(i, i) < self.keep]

    def rows(self):
        """(query_id, id, distance, key) arrays, a strip at a time."""
        for (own, _), (i, key, ids, far) in zip(self.strips, self.held):
            yield own[i], ids, far, key


def _packed(rows: DataFrame, size: int, group: int, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """Chunks of about ``size`` vectors as bytes (ids, vecs, at), dealt to partitions of ``group`` chunks; and how many rows there are."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    rows = rows.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    n = rows.count()
    chunks = max(1, -(-n // size))
    kind = np.float32 if rows.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64
    schema = pa.schema([("at", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary())])

    def pack(batches):
        ids, vecs, held = [], [], 0

        def chunk():
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([b"".join(ids)], pa.binary()), pa.array([b"".join(vecs)], pa.binary())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if len(pc.unique(pc.list_value_length(batch.column(1)))) > 1:
                raise ValueError("vectors of different lengths")
            ids.append(np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64).tobytes())
            vecs.append(np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), kind).tobytes())
            held += batch.num_rows
            if held >= 2 * size:
                yield chunk()
                ids, vecs, held = [], [], 0
        if held:
            yield chunk()

    parts = -(-chunks // group)
    # the second exchange keeps what is packed, as every block reads it
    return rows.repartition(chunks, "id").mapInArrow(pack, "at int, ids binary, vecs binary").repartitionById(parts, F.col("at") % parts), n


def neighbours_of_queries(table: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", among=None, codes=None, n_codes: int = 0) -> DataFrame:
    """Exact k nearest of every query: blocks of queries meet stripes of the table, and lists of k meet by query.

    Both sides are packed into chunks once, and every block is paired with every stripe (a Cartesian product of their
    partitions).  A task reads its stripe a chunk at a time and keeps each query's k best, so its memory doesn't grow
    with the table, and a query has k rows for each stripe.  The time is that of all pairs.

    An index narrows the search: ``among`` marks each query's candidates, and of these the ``n_codes`` least by ``codes``,
    where given, are ranked by distance.  Both are three functions: of queries, of rows, and of both results, the last
    giving a (queries, rows) matrix; ``among`` has a fourth, which marks given places of it.
    """
    import pyarrow as pa

    kind = np.float32 if table.schema[vec_col].dataType.elementType.simpleString() == "float" else np.float64
    q_kind = np.float32 if queries.schema[vec_col].dataType.elementType.simpleString() == "float" else np.float64
    blocks, _ = _packed(queries, block, 1, id_col, vec_col)
    stripes, _ = _packed(table, CHUNK, STRIPE, id_col, vec_col)
    pairs = blocks.toDF("_block", "_qids", "_qs").join(stripes.toDF("_at", "_ids", "_vs").hint("shuffle_replicate_nl"), F.lit(True)).select("_block", "_qids", "_qs", "_ids", "_vs")
    keep = n_codes if codes else k

    def lists(best):
        for q, ids, far, key in best.rows():
            if codes and len(q):  # a row for each query
                ends = np.flatnonzero(np.append(q[1:] != q[:-1], True)) + 1
                cuts = list(zip([0, *ends[:-1]], ends))
                packed = [np.stack([key[a:b].view(np.int64), ids[a:b], far[a:b].view(np.int64)]).tobytes() for a, b in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(q[ends - 1]), pa.array(packed, pa.binary())], ["query_id", "_list"])
            elif len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(far)], ["query_id", id_col, "distance"])

    def search(batches):
        at, best = None, None
        for batch in batches:
            for b, qids, qs, ids, vs in zip(*(c.to_pylist() if c.type == pa.int32() else c for c in batch.columns)):
                qids, ids = (np.frombuffer(x.as_buffer(), np.int64) for x in (qids, ids))
                if (b, qids[0], len(qids)) != at:
                    if best:
                        yield from lists(best)
                    at = b, qids[0], len(qids)
                    best = _Best(qids.copy(), np.frombuffer(qs.as_buffer(), q_kind).reshape(len(qids), -1).astype(float), keep, metric, among, codes)
                best.meet(ids, np.frombuffer(vs.as_buffer(), kind).reshape(len(ids), -1).astype(float))
        if best:
            yield from lists(best)

    def merged(batches):
        """The k nearest of each query's ``n_codes`` least; its lists follow each other."""

        def nearest(q, found):
            key, ids, far = np.concatenate(found, axis=1)
            least = np.lexsort((ids, key.view(float)))[:keep]
            ids, far = ids[least], far[least].view(float)
            near = np.lexsort((ids, far))[:k]
            return np.full(len(near), q), ids[near], far[near]

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done)], ["query_id", id_col, "distance"])

        at, found = None, []
        for batch in batches:
            done = []
            for q, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if q != at and found:
                    done.append(nearest(at, found))
                    found = []
                at = q
                found.append(np.frombuffer(packed.as_buffer(), np.int64).reshape(3, -1))
            if done:
                yield out(done)
        if found:
            yield out([nearest(at, found)])

    flat = f"query_id long, {id_col} long, distance double"
    if codes:
        parts = pairs.mapInArrow(search, "query_id long, _list binary").repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merged, flat)
    else:
        parts = pairs.mapInArrow(search, flat)
    order = Window.partitionBy("query_id").orderBy("distance", id_col)
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


SAMPLE = 20_000


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (2 * x @ c.T - (c**2).sum(1)).argmax(1)
        n = np.bincount(own, minlength=len(c))[:, None]
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


class IVF:
    """An inverted-file index: a coarse quantizer fitted on a bounded sample, every row indexed.

    ``n_lists`` and ``n_probe`` are the usual parameters; graph-index parameters have no counterpart here,
    and graph kinds are served by this index.  With ``sub_quantizers`` the lists hold product-quantized
    codes, and the best candidates are ranked again by their true distance.
    """

    def __init__(self, table: DataFrame, n_lists: int = 16, sub_quantizers: int = 0, id_col: str = "vec_id", vec_col: str = "embedding"):
        self.table, self.id_col, self.vec_col = table, id_col, vec_col
        n = table.count()
        share = min(1.0, SAMPLE / max(1, n))
        sample = table.filter(F.xxhash64(id_col).bitwiseAND(F.lit((1 << 63) - 1)) <= int(share * ((1 << 63) - 1024))).select(vec_col).toPandas()[vec_col]
        x = np.array([list(v) for v in sample], float).reshape(len(sample), -1)
        self.centres = _kmeans(x, n_lists) if len(x) else np.zeros((0, 0))
        self.sample = x
        self.books = []
        if sub_quantizers and len(x):
            self.books = [_kmeans(part, min(64, len(x)), seed=5 + i) for i, part in enumerate(np.array_split(x, sub_quantizers, axis=1))]
        self.rows = self._assigned(table)

    def _assigned(self, table: DataFrame) -> DataFrame:
        centres, vec = self.centres, self.vec_col

        def run(batches):
            for pdf in batches:
                x = np.array([list(v) for v in pdf[vec]], float)
                if len(x):
                    yield pdf.assign(list=(2 * x @ centres.T - (centres**2).sum(1)).argmax(1).astype(np.int32))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
        return table.mapInPandas(run, f"{kinds}, list int")

    def probes(self, query, n_probe: int) -> list[int]:
        q = np.asarray(query, float)
        return np.argsort(((self.centres - q) ** 2).sum(1), kind="stable")[:n_probe].tolist()

    def probes_for(self, target: float, k: int, queries: int = 256) -> int:
        """The least number of lists at which the mean recall of k neighbours is ``target``, estimated on the sample it was
        fitted on; codes are not part of the estimate."""
        x, n = self.sample, len(self.centres)
        own = (2 * x @ self.centres.T - (self.centres**2).sum(1)).argmax(1)
        q = np.random.default_rng(7).permutation(len(x))[:queries]
        far = (x[q] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[q] @ x.T
        far[np.arange(len(q)), q] = np.inf
        near = np.argsort(far, axis=1, kind="stable")[:, :k]
        order = np.argsort((self.centres**2).sum(1) - 2 * x[q] @ self.centres.T, axis=1, kind="stable")
        at = np.argsort(order, axis=1)[np.arange(len(q))[:, None], own[near]]  # when each neighbour's list is probed
        return next((p for p in range(1, n + 1) if (at < p).mean() >= target), n)

    def knn(self, query, k: int, n_probe: int = 4, metric: str = "euclidean") -> DataFrame:
        lists = self.rows.filter(F.col("list").isin(*self.probes(query, n_probe))).drop("list")
        if self.books:
            lists = self._by_codes(lists, query, 8 * k)
        return knn(lists, literal(query), k, metric, None, self.id_col, self.vec_col)

    def knn_of_queries(self, queries: DataFrame, k: int, n_probe: int = 4, metric: str = "euclidean", refine: int = 8) -> DataFrame:
        """(query_id, id, distance, rank) for many queries; with codes, ``refine`` * k candidates are ranked again."""
        centres, books = self.centres, self.books

        def probed(q):
            out = np.zeros((len(q), len(centres)), bool)
            near = np.argsort((centres**2).sum(1) - 2 * q @ centres.T, axis=1, kind="stable")[:, :n_probe]
            np.put_along_axis(out, near, True, axis=1)
            return out

        def tables(q):
            return [(b**2).sum(1) - 2 * x @ b.T + (x**2).sum(1, keepdims=True) for b, x in zip(books, np.array_split(q, len(books), axis=1))]

        def coded(v):
            return [(2 * y @ b.T - (b**2).sum(1)).argmax(1) for b, y in zip(books, np.array_split(v, len(books), axis=1))]

        def by_codes(q, v):
            out = np.zeros((len(q[0]), len(v[0])))
            for x, y in zip(q, v):
                out += np.take(x, y, axis=1, mode="clip")
            return out

        among = probed, lambda v: (2 * v @ centres.T - (centres**2).sum(1)).argmax(1), lambda q, v: q[:, v], lambda q, v, i, j: q[i, v[j]]
        codes = tables, coded, by_codes
        return neighbours_of_queries(self.table, queries, k, metric, id_col=self.id_col, vec_col=self.vec_col, among=among, codes=codes if books else None, n_codes=refine * k)

    def _by_codes(self, rows: DataFrame, query, n: int) -> DataFrame:
        books, vec = self.books, self.vec_col
        tables = [((b - q) ** 2).sum(1) for b, q in zip(books, np.array_split(np.asarray(query, float), len(books)))]

        def run(batches):
            for pdf in batches:
                x = np.array([list(v) for v in pdf[vec]], float)
                if len(x):
                    codes = [(2 * part @ b.T - (b**2).sum(1)).argmax(1) for part, b in zip(np.array_split(x, len(books), axis=1), books)]
                    yield pdf.assign(_code=sum(t[c] for t, c in zip(tables, codes)))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInPandas(run, f"{kinds}, _code double").orderBy("_code", self.id_col).limit(n).drop("_code")


def lsh_knn(table: DataFrame, query, k: int, planes: int = 6, tables: int = 12, seed: int = 9, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Approximate neighbours by random hyperplanes: rows that share a bucket with the query, ranked exactly."""
    q = np.asarray(query, float)
    normals = np.random.default_rng(seed).standard_normal((tables, planes, len(q)))
    near = None
    for t in range(tables):
        same = None
        for p in range(planes):
            side = dot(F.col(vec_col), literal(normals[t, p])) >= 0
            side = side if normals[t, p] @ q >= 0 else ~side
            same = side if same is None else same & side
        near = same if near is None else near | same
    return knn(table, literal(query), k, metric, near, id_col, vec_col)


def lsh_knn_of_queries(table: DataFrame, queries: DataFrame, k: int, planes: int = 6, tables: int = 12, seed: int = 9, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``lsh_knn`` for many queries: (query_id, id, distance, rank)."""

    def buckets(v):
        """A row for each table."""
        normals = np.random.default_rng(seed).standard_normal((tables, planes, v.shape[1]))
        kind = np.uint8 if planes <= 8 else np.int64
        return np.stack([((v @ n.T >= 0) @ (1 << np.arange(planes))).astype(kind) for n in normals])

    def shared(q, v):
        near, same = np.zeros((2, q.shape[1], v.shape[1]), bool)
        for x, y in zip(q, v):
            np.equal(x[:, None], y, out=same)
            np.logical_or(near, same, out=near)
        return near

    def meets(q, v, i, j):
        near = np.zeros(len(i), bool)
        for x, y in zip(q, v):
            near |= x[i] == y[j]
        return near

    return neighbours_of_queries(table, queries, k, metric, id_col=id_col, vec_col=vec_col, among=(buckets, buckets, shared, meets))


def recall(found: DataFrame, truth: DataFrame, id_col: str | list[str] = "vec_id") -> DataFrame:
    on = [id_col] if isinstance(id_col, str) else id_col
    hits = truth.select(*on).join(found.select(*on).withColumn("_hit", F.lit(1)), on, "left")
    return hits.agg(F.round(F.count("_hit") / F.count("*"), 6).alias("recall"))
