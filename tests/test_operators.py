"""Golden facts of the operators on tiny tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from sparkloom.functions import keys
from sparkloom.operators import catalog, embedding, filters, graph, index, kv, mvcc, spatial, store, text, vector
from sparkloom.operators.kv import KeyRange
from sparkloom.operators.text import Tokenizer
from sparkloom.plans import front
from sparkloom.plans.ir import Program
from sparkloom.sources import tables
from sparkloom.streaming import replay

SHOP = [("product:001", "Widget A"), ("product:002", "Widget B"), ("product:003", "Widget C"), ("user:001", "Alice"), ("user:002", "Bob")]
DOCS3 = [("doc1", "The quick brown fox jumps over the lazy dog"), ("doc2", "A fast brown fox runs through the forest"), ("doc3", "The lazy cat sleeps all day")]


def ids(df, c="doc_id"):
    return sorted(r[c] for r in df.collect())


@pytest.fixture()
def shop(spark):
    return spark.createDataFrame(SHOP, "k string, v string")


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS3, "doc_id string, text string")


def test_scans(shop):
    assert kv.scan_prefix(shop, "product:").count() == 3
    assert kv.scan(shop, KeyRange.from_to("product:002", "user:")).count() == 2
    back = [r.k for r in kv.scan(shop, KeyRange.all().reversed()).collect()]
    assert back[0] == "user:002" and back[-1] == "product:001" and len(back) == 5
    assert [r.k for r in kv.scan(shop, KeyRange.all().reversed().with_limit(2)).collect()] == ["user:002", "user:001"]
    assert [r.k for r in kv.seek(shop, "product:002", 2).collect()] == ["product:002", "product:003"]
    assert [r.k for r in kv.seek(shop, "product:002", 1, after=True).collect()] == ["product:003"]
    assert kv.scan_prefix(shop, "").count() == 5


def test_point_operations(spark, shop):
    assert kv.exists(shop, "user:001").first()[0] and not kv.exists(shop, "nobody").first()[0]
    wanted = spark.createDataFrame([(0, "user:001"), (1, "nobody"), (2, "user:001")], "ord int, k string")
    assert [r.v for r in kv.batch_get(shop, wanted).orderBy("ord").collect()] == ["Alice", None, "Alice"]
    gone = spark.createDataFrame([("user:001",), ("user:001",), ("nobody",)], "k string")
    assert kv.delete_count(shop, gone).first()[0] == 1
    assert kv.delete(shop, gone).count() == 4
    puts = spark.createDataFrame([("user:001", "x", 1), ("user:001", "y", 2), ("new", "z", 1)], "k string, v string, seq int")
    assert {r.k: r.v for r in kv.put(shop, puts, order="seq").collect()} == dict(SHOP) | {"user:001": "y", "new": "z"}
    for bad in ([("", "bad", 1)], [(None, "bad", 1)]):
        with pytest.raises(Exception, match="invalid key"):
            kv.put(shop, spark.createDataFrame(bad, "k string, v string, seq int"), order="seq").collect()
    with pytest.raises(Exception, match="written twice"):
        kv.put(shop, puts.drop("seq")).collect()


def test_catalogue_and_front_end_raise(spark):
    have = spark.createDataFrame([("/a/t", "table", "x", 1)], "path string, kind string, body string, version int")
    with pytest.raises(Exception, match="object exists"):
        catalog.create_objects(have, have.drop("version")).collect()
    with pytest.raises(LookupError):
        catalog.call_function(have, "/a/t", have, "out")
    with pytest.raises(TypeError):
        index.HashIndex(have).range_scan(KeyRange.all())
    with pytest.raises(ValueError):
        front.run(spark, "MATCH (a)-[]->(b) WHERE a.x = b.x RETURN a", {"nodes": have, "edges": have})


def test_retries_after_conflicts():
    turns = []

    def run():
        turns.append(1)
        if len(turns) < 3:
            raise mvcc.Conflict("again")
        return "done"

    assert mvcc.with_retry(run, wait=0) == "done" and len(turns) == 3
    with pytest.raises(mvcc.Conflict):
        mvcc.with_retry(lambda: (_ for _ in ()).throw(mvcc.Conflict("never")), most=1, wait=0)


def test_embed_keeps_null_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in embedding.embed(docs, embedding.hashing_embedder(8), 1).collect()} == {1, 2, 3}


def test_routing(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % (1 << 64)
        return h

    words = ["", "a", "key1", "ключ", "x" * 50]
    df = spark.createDataFrame([(w,) for w in words], "k string").select("k", keys.fnv1a(F.col("k")).alias("h"), keys.hash_shard(F.col("k"), 7).alias("s"))
    for r in df.collect():
        assert (r.h.hi << 32 | r.h.lo) == fnv(r.k.encode()) and r.s == fnv(r.k.encode()) % 7
    t = spark.createDataFrame([(7200,), (-7300,), (None,)], "t long").select(keys.time_shard(F.col("t"), 3600, 4).alias("s"))
    assert [r.s for r in t.collect()] == [2, 2, 0]
    e = spark.createDataFrame([(5,), (-5,), (0,), (1 << 62,), (-(1 << 63),)], "x long").select("x", keys.encode_long(F.col("x")).alias("e"))
    assert [r.x for r in e.orderBy("e").collect()] == [-(1 << 63), -5, 0, 5, 1 << 62]


LOG = [("a", 1.0, 1, 0), ("a", 2.0, 5, 1), ("b", 3.0, 2, 2), ("b", None, 6, 3), ("c", 9.0, 0, 4)]


def test_versions(spark):
    log = spark.createDataFrame(LOG, "k string, v double, commit_ts long, seq long")
    assert {r.k: r.v for r in mvcc.snapshot(log, 5).collect()} == {"a": 2.0, "b": 3.0}
    assert {r.k: r.v for r in mvcc.snapshot(log, 6).collect()} == {"a": 2.0}
    assert {r.k: r.found for r in mvcc.exists_at(log, 6).collect()} == {"a": True, "b": False}
    kept = {(r.k, r.commit_ts) for r in mvcc.collect_garbage(log, 5).collect()}
    assert kept == {("a", 5), ("b", 2), ("b", 6), ("c", 0)}
    assert {r.k: r.v for r in mvcc.compact(log.filter("commit_ts > 0")).collect()} == {"a": 2.0}


def test_transactions(spark):
    log = spark.createDataFrame(LOG[:4], "k string, v double, commit_ts long, seq long")
    tx = mvcc.Transaction(log, 5)
    tx.put("z", 7.0)
    tx.delete("b")
    assert {r.k: r.v for r in tx.view().collect()} == {"a": 2.0, "z": 7.0}
    with pytest.raises(mvcc.Conflict):
        tx.commit(9)
    fine = mvcc.Transaction(log, 6)
    fine.put("z", 7.0)
    assert {r.k for r in mvcc.snapshot(fine.commit(9), 9).collect()} == {"a", "z"}
    tx.rollback()
    assert {r.k for r in tx.view().collect()} == {"a", "b"}


def test_indexes(spark):
    t = spark.createDataFrame([(f"key{i:02}", f"value{i:03}") for i in range(30)] + [("none", None)], "pk string, v string")
    i = index.build(t, "v", "pk")
    assert i.count() == 30
    assert index.range_scan(i, KeyRange("value005", "value010", include_end=True)).count() == 6
    assert index.range_scan(i, KeyRange("value010", "value020", include_end=True)).count() == 11
    assert tuple(index.extremes(i).first()) == ("value000", "value029")
    more = spark.createDataFrame([("value001", "other")], "indexed_value string, primary_key string")
    with pytest.raises(index.UniqueViolation):
        index.insert_unique(i, more)


def test_search(spark, docs):
    assert ids(text.search(docs, "fox")) == ["doc1", "doc2"]
    assert ids(text.search(docs, "lazy")) == ["doc1", "doc3"]
    assert ids(text.search(docs, "forest")) == ["doc2"]
    assert ids(text.phrase(docs, "quick brown")) == ["doc1"]
    assert ids(text.phrase(docs, "brown fox")) == ["doc1", "doc2"]
    assert ids(text.phrase(docs, "fox lazy")) == []
    assert ids(text.boolean_and(docs, ["brown", "quick"])) == ["doc1"]
    assert ids(text.boolean_or(docs, ["quick", "forest"])) == ["doc1", "doc2"]
    assert ids(text.boolean_not(docs, ["fox"])) == ["doc3"]
    assert text.search(docs, "...").count() == 0
    stop = Tokenizer(stop_words=("the",))
    assert ids(text.search(docs, "the", tok=stop)) == [] and ids(text.search(docs, "quick", tok=stop)) == ["doc1"]
    fox = spark.createDataFrame([("a", "fox fox fox"), ("b", "fox dog")], "doc_id string, text string")
    row = text.term_stats(fox, ["fox"]).first()
    assert (row.df, row.total_tf) == (2, 4)
    mark = text.search(fox, "dog", highlights=True).first().highlights[0]
    assert (mark.fragment, mark.start, mark.end) == ("dog", 1, 4)


def test_postings_of_the_whole_vocabulary():
    assert {"txt_postings", "txt_postings_all"} <= entry.queries().keys() and " IN (" not in entry.oracle_sql()["txt_postings_all"]


def test_postings_need_no_shuffle(spark):
    rows = [(1, "b a b"), (2, None), (3, ""), (4, "a, A  c"), (5, "...")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = text.postings(df)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in p.collect()) == [("a", 1, [1], 1), ("a", 4, [0, 1], 2), ("b", 1, [0, 2], 2), ("c", 4, [2], 1)]
    assert sorted(tuple(r) for r in text.postings(df, terms=["c", "zz", "c"]).collect()) == [("c", 4, [2], 1)]
    twice = text.postings(df.union(df.filter("doc_id = 4")))
    assert sorted(tuple(r) for r in twice.filter("doc_id = 4").collect()) == [("a", 4, [0, 0, 1, 1], 4), ("c", 4, [2, 2], 2)]
    assert list(text._spans([3, 3, 9, 1, 1], 5)) == [(0, 1), (1, 2), (2, 3), (3, 5)] and list(text._spans([])) == []


def test_stemming(spark):
    words = ["running", "king", "jumped", "red", "cats", "gas", "és", "ings", "sing"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s"))
    got = {r.w: r.s for r in df.collect()}
    assert got == {w: text._stem(w) for w in words}
    assert got["running"] == "runn" and got["king"] == "king" and got["jumped"] == "jump" and got["red"] == "red" and got["cats"] == "cat" and got["gas"] == "gas"


def test_vectors(spark):
    t = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])], "vec_id long, embedding array<float>")
    q = vector.literal([1.0, 0.0])
    assert [r.vec_id for r in vector.knn(t, q, 2).collect()] == [0, 2]
    assert [round(r.distance, 5) for r in vector.knn(t, q, 3, "cosine").collect()] == [0.0, 0.4, 1.0]
    assert [r.distance for r in vector.knn(t, q, 1, "dot").collect()] == [-1.0]
    assert ids(vector.within(t, q, 1.0), "vec_id") == [0, 2]
    assert vector.IVF(t, n_lists=2).knn([1.0, 0.0], 1, n_probe=2).first().vec_id == 0


def test_recall_of_the_index_queries(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    asked = e.filter("vec_id % 20 = 0")
    for name, metric in (("vec_ivf_knn", "euclidean"), ("vec_ivfpq_knn", "euclidean"), ("vec_lsh_knn", "cosine")):
        truth = {(r.query_id, r.vec_id) for r in vector.neighbours_of_queries(e, asked, 10, metric).collect()}
        found = {(r.query_id, r.vec_id) for r in entry.queries()[name](spark, folder).collect()}
        assert len(truth) == 10 * asked.count() and len(truth & found) >= 0.9 * len(truth), name
    assert {r.kind for r in entry.queries()["vec_recall"](spark, folder).collect() if r.recall >= 0.9} == {"ivf", "ivfpq", "lsh"}


def test_neighbours_in_stripes_of_chunks(spark, monkeypatch):
    """A query keeps a list for each stripe, not for each chunk; equal vectors go by their ids."""
    for name, size in (("CHUNK", 16), ("STRIPE", 4), ("STRIP", 8)):
        monkeypatch.setattr(vector, name, size)
    x = np.random.default_rng(0).standard_normal((300, 6))
    x[100:160] = x[0]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for metric in ("euclidean", "cosine", "dot", "manhattan"):
        found = vector.neighbours_of_queries(t, t.filter("vec_id < 40"), 5, metric, block=16)
        far = vector._paired(np.repeat(x[:40], 300, 0), np.tile(x, (40, 1)), metric).reshape(40, 300)
        want = [[i, *[int(j) for j in np.lexsort((np.arange(300), row)) if j != i][:5]] for i, row in enumerate(far)]
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, [r.query_id]).append(r.vec_id)
        assert [got[i] for i in range(40)] == want, metric
    ivf = vector.IVF(t, n_lists=4, sub_quantizers=2)
    own = (2 * x @ ivf.centres.T - (ivf.centres**2).sum(1)).argmax(1)
    code = sum(((b**2).sum(1) - 2 * y[:40] @ b.T + (y[:40] ** 2).sum(1, keepdims=True))[:, (2 * y @ b.T - (b**2).sum(1)).argmax(1)] for b, y in zip(ivf.books, np.array_split(x, 2, axis=1)))
    far = vector._paired(np.repeat(x[:40], 300, 0), np.tile(x, (40, 1)), "euclidean").reshape(40, 300)
    found = {(r.query_id, r["rank"]): r.vec_id for r in ivf.knn_of_queries(t.filter("vec_id < 40"), 5, n_probe=2, refine=4).collect()}
    for i in range(40):
        in_lists = [j for j in range(300) if j != i and own[j] in ivf.probes(x[i], 2)]
        best = sorted(sorted(in_lists, key=lambda j: (code[i, j], j))[:20], key=lambda j: (far[i, j], j))[:5]
        assert [found[i, n + 1] for n in range(len(best))] == best
    lists = spark.sparkContext.accumulator(0)

    class Counted(vector._Best):
        def rows(self):
            for out in super().rows():
                lists.add(len(out[0]))
                yield out

    monkeypatch.setattr(vector, "_Best", Counted)
    vector.neighbours_of_queries(t, t.filter("vec_id < 40"), 5, block=64).collect()
    assert 0 < lists.value <= 40 * 5 * 5  # of 19 chunks, in five stripes


def test_common_principals_are_not_shuffled_by_name(spark):
    """Writes of a principal that has most of them stay spread; rare and unknown principals are judged all the same."""
    who = F.when(F.col("id") == 7, "rare").when(F.col("id") == 8, "unknown").when(F.col("id") % 4 == 0, "reader").otherwise("writer")
    writes = spark.range(0, 8000, 1, 8).select(F.col("id").alias("seq"), who.alias("principal"), F.lit("put").alias("op"), F.when(F.col("id") % 5 == 0, "").otherwise("k").alias("k"), F.lit("v").alias("v"))
    grants = spark.createDataFrame([("writer", "write", "/a"), ("rare", "write", "/"), ("reader", "read", "/a")], "principal string, permission string, scope string")
    judged = store.outcomes(writes, grants, spark.createDataFrame([("write", "read")], "permission string, implies string"), "/a/b")
    want = {i: "denied" if i == 8 or (i % 4 == 0 and i != 7) else "invalid" if i % 5 == 0 else "ok" for i in range(8000)}
    assert {r.seq: r.status for r in judged.collect()} == want
    most = judged.filter("principal = 'writer'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 1000  # of 6000


def test_space(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 15.0, 5.0)], "id long, lat double, lon double")
    assert {r.id: r.distance for r in spatial.query_knn(p, (0, 0), 2).collect()} == {1: 0.0, 2: 5.0}
    assert ids(spatial.query_box(p, (0, 0, 10, 10)), "id") == [1, 2]
    assert ids(spatial.query_polygon(p, [(1, 1), (1, 10), (10, 10), (10, 1)]), "id") == [2]
    assert spatial.boxes_meet((0, 0, 1, 1), (1, 1, 2, 2)) and spatial.box_area(spatial.expand_box((0, 0, 1, 1), 3, 0)) == 3


EDGES = [("a", "b", "X"), ("b", "c", "X"), ("c", "d", "Y"), ("a", "d", "Y"), ("d", "a", "X")]


def test_graphs(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string, type string")
    n = spark.createDataFrame([(x, "L" if x in "ab" else "M") for x in "abcde"], "id string, label string")
    a = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in graph.traverse(a, e, 2).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert {r.id for r in graph.traverse(a, e, 3, kinds=["X"]).collect()} == {"a", "b", "c"}
    assert graph.shortest_path_length(e, a, "c", 3, "out").first().depth == 2
    assert not graph.has_path(e, a, "e", 3).first()[0]
    assert sorted(r.path for r in graph.find_paths(e, a, "d", 3, "out").collect()) == [["a", "b", "c", "d"], ["a", "d"]]
    assert [tuple(r) for r in graph.match(n, e, "(x:L)-[:X]->(y:L)").select("x", "y").collect()] == [("a", "b")]
    assert graph.match(n, e, "(x)-[:Y]->(y)-[:X]->(x)").count() == 1
    left = graph.delete_nodes(n, e, a)
    assert left[0].count() == 4 and left[1].count() == 2
    assert graph.expand(n, e, optional=True).filter("neighbor is null").count() == 1


def test_matches_reach_the_whole_graph(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    t = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    paths = t("lineitem").select("l_orderkey", "l_partkey").distinct().join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    assert entry.queries()["gr_match_2hop_all"](spark, folder).count() == paths.count()
    assert entry.queries()["gr_optional_expand_all"](spark, folder).select("id").distinct().count() == t("customer").count()


def test_filters_and_programs(spark, docs):
    t = spark.createDataFrame([(1, [1, 2], '{"a": {"b": 5}}'), (2, [3], '{"a": {}}'), (3, None, None)], "id int, tags array<int>, body string")
    f = lambda tree: ids(t.filter(filters.compile_filter(tree)), "id")
    assert f({"contains": ["tags", 2]}) == [1] and f({"contains_any": ["tags", [3, 9]]}) == [2] and f({"contains_all": ["tags", [1, 2]]}) == [1]
    assert f({"is_null": "tags"}) == [3] and f({"eq": ["body:$.a.b", "5"]}) == [1]
    out = Program({"docs": docs}).run([("FULLTEXT_SEARCH", {"in": "docs", "query": "fox", "out": "hits"}), ("PROJECT", {"in": "hits", "columns": {"id": "doc_id"}}), ("SORT", {"in": "hits", "keys": [("id", "desc")]}), ("LIMIT", {"in": "hits", "count": 1})])
    assert out.first().id in ("doc1", "doc2")
    with pytest.raises(ValueError):
        Program({}).run([("NO_SUCH", {})])


def test_sources(spark, shop, tmp_path):
    for fmt in ("parquet", "json", "csv", "orc"):
        tables.export(shop, f"{tmp_path}/{fmt}", fmt, {"filter": {"like": ["k", "user%"]}})
        assert tables.read_any(spark, f"{tmp_path}/{fmt}", fmt, "k string, v string").count() == 2
    tables.append_log(shop.withColumn("lsn", F.lit(1)), f"{tmp_path}/log")
    tables.append_log(shop.withColumn("lsn", F.lit(2)), f"{tmp_path}/log")
    assert tables.read_log(spark, f"{tmp_path}/log", 2).count() == 5
    newer = tables.evolve(shop, {"key": ("string", ""), "n": ("int", 3)}, {"k": "key"})
    assert newer.first().n == 3 and newer.columns == ["key", "n"]
    sealed = tables.encrypt(shop, "v", b"0123456789abcdef")
    assert ids(tables.decrypt(sealed, "v", b"0123456789abcdef"), "v") == sorted(v for _, v in SHOP)
    tables.save_sharded(shop.withColumn("shard", F.lit(0)), f"{tmp_path}/kv")
    assert kv.get(spark.read.parquet(f"{tmp_path}/kv"), "user:001").first().v == "Alice"


def test_stream_replay(spark, tmp_path):
    log = [(1, "put", "a", "1"), (2, "put", "b", "1"), (3, "delete", "a", None), (4, "put", "b", "2"), (5, "put", "c", "1")]
    df = spark.createDataFrame(log, "lsn long, kind string, k string, v string")
    for lsn in range(1, 6):
        tables.append_log(df.filter(F.col("lsn") == lsn).coalesce(1), f"{tmp_path}/log")
    stream = replay.tail(spark, f"{tmp_path}/log", df.schema, 2)
    q = replay.replay_into(stream, f"{tmp_path}/state", f"{tmp_path}/cp")
    last = max(p["batchId"] for p in q.recentProgress if p["numInputRows"])
    want = {r.k: r.v for r in replay.replay(df).collect()}
    assert {r.k: r.v for r in replay.state(spark, f"{tmp_path}/state", last).collect()} == want == {"b": "2", "c": "1"}
    assert last > 1 and sorted(x.name for x in (tmp_path / "state").iterdir()) == [str(last - 1), str(last)]


def test_embeddings(spark, docs):
    provider = embedding.hashing_embedder(8)
    rec = embedding.embed(docs, provider, 1)
    assert rec.count() == 3 and abs(sum(x * x for x in rec.first().embedding) - 1) < 1e-9
    assert embedding.stale(rec, docs, 1).count() == 0
    assert {r.reason for r in embedding.stale(rec, docs, 2).collect()} == {"version"}


def test_documents_and_checksums(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    with pytest.raises(Exception, match="document exists"):
        filters.insert_documents(docs, docs.limit(1), "id").collect()
    assert {tuple(r) for r in filters.unset_fields(docs, docs, "id", ["v"]).collect()} == {(1, None), (2, None)}
    for kind in ("crc32", "xxhash64"):
        whole = tables.checked(docs, ["id", "v"], kind)
        assert tables.corrupt(whole, ["id", "v"], kind).count() == 0
        assert tables.corrupt(whole.withColumn("checksum", F.lit(None).cast("long")), ["id", "v"], kind).count() == 2
