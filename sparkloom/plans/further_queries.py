"""Queries over table routing, checksums, logs, documents, transactions, boxes, properties, refreshed embeddings and re-ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.functions import keys
from sparkloom.operators import catalog, embedding, filters, graph, hybrid, index, mvcc, spatial, text, vector
from sparkloom.operators.kv import KeyRange
from sparkloom.plans.ir import Program
from sparkloom.plans.kv_queries import _log
from sparkloom.plans.model_queries import _DIST, _EDGES, _POINTS, _Q, _TERMS, _TEXT_TOP, _VEC_TOP, QUERY, _docs, _points, _search_sql, _start, _vectors, edges
from sparkloom.plans.registry import ORACLES, query
from sparkloom.sources import scratch, tables
from sparkloom.sources.tables import table
from sparkloom.streaming import replay

# ---------------------------------------------------------------- keys, checksums, files


@query(
    "tbl_route",
    """SELECT kind, shard, count(*) AS n FROM (SELECT 'single' AS kind, 0 AS shard FROM orders UNION ALL SELECT 'range', CASE WHEN o_orderkey < 100 THEN 0 WHEN o_orderkey < 1000 THEN 1 ELSE 2 END FROM orders
UNION ALL SELECT 'list', CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus IN ('O', 'P') THEN 1 ELSE 0 END FROM orders) GROUP BY ALL""",
)
def tbl_route(spark, d):
    o = table(spark, d, "orders")
    tables_of = {"single": ("o_orderkey", {"single": 0}), "range": ("o_orderkey", {"range": [(None, 100), (100, 1000), (1000, None)]}), "list": ("o_orderstatus", {"list": [["F"], ["O", "P"]]})}
    shards = F.array(*(F.struct(F.lit(kind).alias("kind"), keys.route_table(F.col(c), sharding).cast("int").alias("shard")) for kind, (c, sharding) in tables_of.items()))
    return o.select(F.inline(shards)).groupBy("kind", "shard").agg(F.count("*").alias("n"))


@query("io_checksum", "SELECT kind, o_orderkey FROM orders, (VALUES ('crc32'), ('xxhash64')) v(kind) WHERE o_orderkey % 11 = 0")
def io_checksum(spark, d):
    parts = []
    for kind in ("crc32", "xxhash64"):
        rows = tables.checked(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey", "o_orderstatus", "o_totalprice"], kind)
        hurt = rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
        parts.append(tables.corrupt(hurt, ["o_orderkey", "o_orderstatus", "o_totalprice"], kind).select(F.lit(kind).alias("kind"), "o_orderkey"))
    return parts[0].union(parts[1])


_CODECS = ("uncompressed", "snappy", "lz4_raw", "zstd", "gzip")


@query("io_compress", "SELECT codec, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders, (VALUES " + ", ".join(f"('{c}')" for c in _CODECS) + ") v(codec) GROUP BY codec")
def io_compress(spark, d):
    out = None
    for codec in _CODECS:
        path = scratch.folder(spark, f"compressed-{uuid.uuid4().hex}")
        tables.export(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, "parquet", compression=codec)
        rows = tables.read_any(spark, path, "parquet", "o_orderkey long, o_custkey long").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys")).select(F.lit(codec).alias("codec"), "n", "keys")
        out = rows if out is None else out.union(rows)
    return out


@query("kv_read_metrics", "SELECT count(*) AS n_rows, sum(strlen(o_orderkey::VARCHAR))::BIGINT AS key_bytes, sum(strlen(o_orderstatus))::BIGINT AS value_bytes FROM orders WHERE o_totalprice > 200000")
def kv_read_metrics(spark, d):
    rows, seen = tables.measured(table(spark, d, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", f"reads-{uuid.uuid4().hex}")
    rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["n_rows"], got["key_bytes"], got["value_bytes"])], "n_rows long, key_bytes long, value_bytes long")


@query("log_append_truncate", "SELECT o_orderkey AS lsn, o_orderstatus AS v FROM orders WHERE o_orderkey >= 500")
def log_append_truncate(spark, d):
    path, cut = (scratch.folder(spark, f"{name}-{uuid.uuid4().hex}") for name in ("log", "log-cut"))
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("lsn"), F.col("o_orderstatus").alias("v"))
    for part in (0, 1):
        tables.append_log(log.filter(F.col("lsn") % 2 == part), path)
    tables.truncate_log(spark, path, cut, 300)
    return tables.read_log(spark, cut, 500)


# ---------------------------------------------------------------- indexes, documents, transactions, state


@query("idx_query_adapter", """SELECT 'exact' AS kind, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'exists', max((c_mktsegment = 'BUILDING')::INT)::BIGINT FROM customer
UNION ALL SELECT 'prefix', count(*) FROM customer WHERE starts_with(c_mktsegment, 'MA') UNION ALL SELECT 'range', count(*) FROM customer WHERE c_mktsegment >= 'B' AND c_mktsegment < 'G'""")
def idx_query_adapter(spark, d):
    ix = index.build(table(spark, d, "customer"), "c_mktsegment", "c_custkey")
    n = F.count("*").alias("n")
    parts = [index.query(ix, q).agg(n).select(F.lit(kind).alias("kind"), "n") for kind, q in (("exact", {"exact": "BUILDING"}), ("prefix", {"prefix": "MA"}), ("range", {"range": KeyRange.from_to("B", "G")}))]
    found = index.query(ix, {"exists": "BUILDING"}).select(F.lit("exists").alias("kind"), F.col("found").cast("long").alias("n"))
    return parts[0].union(parts[1]).union(parts[2]).union(found)


@query("doc_life", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal
FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT -1, 'NEW', 2.5""")
def doc_life(spark, d):
    have = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    docs = filters.insert_documents(have, spark.createDataFrame([(-1, "NEW", 2.5)], have.schema), "c_custkey")
    changed = have.filter("c_custkey % 4 = 0").select("c_custkey", F.lit("UPDATED").alias("c_mktsegment"), F.lit(1.5).alias("c_acctbal"))
    docs = filters.update_documents(docs, changed.unionByName(changed.limit(1).withColumn("c_custkey", F.lit(-7).cast("long"))), "c_custkey")
    docs = filters.unset_fields(docs, have.filter("c_custkey % 5 = 0"), "c_custkey", ["c_acctbal"])
    return filters.delete_documents(docs, have.filter("c_custkey % 3 = 0"), "c_custkey")


@query("tx_begin_commit", "SELECT 1 AS later, count(*) AS n FROM (VALUES (1), (2)) v(k)")
def tx_begin_commit(spark, d):
    log = _log(spark, d)
    tx = mvcc.begin(log)
    tx.put(3, 33.0)
    tx.delete(5)
    after = mvcc.commit_next(tx, log)
    return after.filter(F.col("commit_ts") > tx.ts).groupBy((F.col("commit_ts") - tx.ts).cast("int").alias("later")).agg(F.count("*").alias("n"))


@query("stm_apply_batch", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 2 THEN 'last' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 4 <> 1""")
def stm_apply_batch(spark, d):
    o = table(spark, d, "orders")
    state = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    op = lambda kind, v: F.struct(F.lit(kind).alias("op"), F.col("o_orderkey").alias("k"), F.lit(v).alias("v"))
    ops = F.when(F.col("o_orderkey") % 4 == 1, F.array(op("put", "first"), op("delete", None))).otherwise(F.array(op("delete", None), op("put", "first"), op("put", "last")))
    commands = o.filter("o_orderkey % 4 in (1, 2)").select(F.col("o_orderkey").alias("lsn"), ops.alias("ops"))
    return replay.apply_commands(state, commands)


# ---------------------------------------------------------------- catalogue

_KINDS = ("tenant", "user", "database", "tablespace", "region", "server", "namespace", "index")


@query("cat_kinds", "SELECT kind, 'of ' || kind AS body, 1 AS version FROM (VALUES " + ", ".join(f"('{k}')" for k in _KINDS if k not in ("user", "server")) + ") v(kind) UNION ALL SELECT 'user', 'renamed', 2")
def cat_kinds(spark, d):
    have = spark.createDataFrame([], "path string, kind string, body string, version int")
    have = catalog.create_objects(have, spark.createDataFrame([(f"/sys/{k}/one", k, f"of {k}") for k in _KINDS], "path string, kind string, body string"))
    have = catalog.update_objects(have, spark.createDataFrame([("/sys/user/one", "renamed"), ("/sys/none", "lost")], "path string, body string"))
    return catalog.delete_objects(have, "/sys/server").select("kind", "body", "version")


# ---------------------------------------------------------------- space


@query("geo_boxes", f"""WITH b AS (SELECT id % 25 AS cell, min(lat) AS x1, min(lon) AS y1, max(lat) AS x2, max(lon) AS y2 FROM {_POINTS} GROUP BY 1)
SELECT cell, x1 <= -60 AND y1 <= 0 AND y2 >= -90 AND x2 >= -80 AS meets, round((greatest(x2, 85) - least(x1, 85)) * (greatest(y2, 10) - least(y1, 10)), 6) AS area FROM b""")
def geo_boxes(spark, d):
    boxes = spatial.boxes_of(_points(spark, d).withColumn("cell", F.col("id") % 25), "cell").withColumn("meets", spatial.meets((-80.0, -90.0, -60.0, 0.0)))
    return spatial.expanded(boxes, 85.0, 10.0).select("cell", "meets", F.round(spatial.area(), 6).alias("area"))


# ---------------------------------------------------------------- graph, text, vectors, ranking


@query("gr_labels_properties", "SELECT 'c' || c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS missing FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100")
def gr_labels_properties(spark, d):
    c = table(spark, d, "customer")
    n = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.array(F.lit("Customer"), "c_mktsegment").alias("labels"), F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string")).alias("props"))
    found = graph.scan_nodes(n, "BUILDING").filter(graph.node_property("balance", "double") > 100)
    return found.select("id", graph.node_property("balance", "double").alias("balance"), graph.node_property("none").alias("missing"))


@query("txt_custom_scorer", _search_sql(_TERMS, "bm25").replace("ln((st.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl.dl / st.avgdl))", "sqrt(tf) * st.n / (st.n + df) / sqrt(dl.dl + st.avgdl)"))
def txt_custom_scorer(spark, d):
    return text.search(_docs(spark, d), QUERY, 10, lambda tf, df, n, length, mean: F.sqrt(tf) * n / (n + df) / F.sqrt(length + mean))


@query("vec_recall_target", "SELECT true AS met")
def vec_recall_target(spark, d):
    e = _vectors(spark, d)
    asked = e.filter("vec_id % 20 = 0").select("vec_id", "embedding")
    ivf = vector.IVF(e.select("vec_id", "embedding"))
    found = ivf.knn_of_queries(asked, 10, ivf.probes_for(0.95, 10))
    return vector.recall(found, vector.neighbours_of_queries(e, asked, 10, "euclidean"), ["query_id", "vec_id"]).select((F.col("recall") >= 0.9).alias("met"))


@query("emb_refresh", "SELECT doc_id, 2 AS model_version, sha256(text) AS text_hash FROM documents WHERE doc_id % 13 <> 0 AND text IS NOT NULL")
def emb_refresh(spark, d):
    docs = _docs(spark, d).filter("text is not null")
    old = embedding.embed(docs.filter("doc_id % 5 <> 0"), embedding.hashing_embedder(8, 1), 1)
    current = embedding.embed(docs.filter("doc_id % 5 = 0"), embedding.hashing_embedder(8, 2), 2)
    kept = embedding.refresh(old.unionByName(current), docs.filter("doc_id % 13 <> 0"), embedding.hashing_embedder(8, 2), 2)
    return kept.select("doc_id", "model_version", "text_hash")


@query("ir_hybrid_program", ORACLES["hyb_text_vector"])
def ir_hybrid_program(spark, d):
    e = _vectors(spark, d).select("vec_id", "embedding")
    probe = [float(x) for x in e.filter("vec_id = 0").select("embedding").first()[0]]
    steps = [
        ("FULLTEXT_SEARCH", {"in": "docs", "query": QUERY, "limit": 50, "out": "t"}),
        ("VECTOR_SEARCH", {"in": "vectors", "query": probe, "k": 50, "metric": "cosine", "out": "v"}),
        ("PROJECT", {"in": "v", "columns": {"doc_id": "vec_id", "distance": "distance"}}),
        ("HYBRID_SEARCH", {"signals": [("t", "score", 0.6, False), ("v", "distance", 0.4, True)], "id": "doc_id", "k": 10, "out": "best"}),
    ]
    return Program({"docs": _docs(spark, d), "vectors": e}).run(steps)


@query("hyb_rerank", f"""WITH t AS ({_TEXT_TOP}) SELECT doc_id, round(score / (1 + n_chars / 1000.0::DOUBLE), 6) AS score FROM t JOIN documents USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 10""")
def hyb_rerank(spark, d):
    top = text.search(_docs(spark, d), QUERY, 50).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return hybrid.rerank(top, F.col("score") / (1 + F.col("n_chars") / 1000.0), "doc_id", 10).select("doc_id", "score")


_NEAR = f"{_EDGES}, w AS (SELECT src, dst FROM edges WHERE type IN ('IN_NATION', 'IN_REGION')), n AS (SELECT DISTINCT src AS id FROM w WHERE dst = 'r1')"


@query("hyb_graph_proximity", f"""WITH {_NEAR}, p AS (SELECT 'r1' AS id, 1.0::DOUBLE AS proximity UNION ALL SELECT id, 0.5 FROM n UNION ALL SELECT src, 1.0::DOUBLE / 3 FROM w WHERE dst IN (SELECT id FROM n))
SELECT id, round(proximity * 0.7 + c_acctbal / 10000 * 0.3, 6) AS score FROM p JOIN customer ON id = 'c' || c_custkey ORDER BY score DESC, id LIMIT 20""")
def hyb_graph_proximity(spark, d):
    near = hybrid.proximity(_start(spark, "r1"), edges(spark, d), 2, "in", ["IN_NATION", "IN_REGION"])
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), "c_acctbal")
    return hybrid.rerank(near.join(c, "id"), F.col("proximity") * 0.7 + F.col("c_acctbal") / 10000 * 0.3, "id", 20).select("id", "score")


@query("hyb_vector_path", f"""WITH {_NEAR}, c AS (SELECT src FROM w WHERE dst IN (SELECT id FROM n))
SELECT vec_id, round({_DIST['cosine']}, 6) AS distance FROM embeddings, {_Q} WHERE 'c' || vec_id IN (SELECT src FROM c) ORDER BY distance, vec_id LIMIT 15""")
def hyb_vector_path(spark, d):
    e = _vectors(spark, d).select("vec_id", "embedding")
    below = graph.traverse(_start(spark, "r1"), edges(spark, d), 2, "in", ["IN_NATION", "IN_REGION"]).select("id")
    inside = e.join(below, F.concat(F.lit("c"), F.col("vec_id").cast("string")) == F.col("id"), "left_semi")
    return vector.knn(inside, vector.vector_of(e, 0), 15, "cosine")
