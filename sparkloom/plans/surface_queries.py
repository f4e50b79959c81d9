"""Queries over writes, catalogue, stored indexes, mutations, logs and the SQL front end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import catalog, filters, graph, index, kv, mvcc, relational, store, text, vector
from sparkloom.operators.kv import KeyRange
from sparkloom.plans import front
from sparkloom.plans.kv_queries import _KV, _kv, _orders
from sparkloom.plans.model_queries import _EDGES, _NODES, _TERMS, _TOK, _docs, _search_sql, _start, edges, nodes
from sparkloom.plans.registry import query
from sparkloom.sources import scratch, tables
from sparkloom.sources.tables import table

# ---------------------------------------------------------------- writes


def _writes(spark: SparkSession, d: str) -> DataFrame:
    """A write per order: every third deletes, every tenth is by a reader, every 17th has an empty key."""
    o = table(spark, d, "orders")
    key = F.when(F.col("o_orderkey") % 17 == 0, "").otherwise(F.lpad((F.col("o_orderkey") % 5000).cast("string"), 12, "0"))
    return o.select(
        F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 10 == 0, "reader").otherwise("writer").alias("principal"),
        F.when(F.col("o_orderkey") % 3 == 0, "delete").otherwise("put").alias("op"), key.alias("k"), F.col("o_orderstatus").alias("v"),
    )


def _judged(spark: SparkSession, d: str) -> DataFrame:
    grants = spark.createDataFrame([("writer", "write", "/shop"), ("reader", "read", "/shop")], "principal string, permission string, scope string")
    implied = spark.createDataFrame([("write", "read")], "permission string, implies string")
    return store.outcomes(_writes(spark, d), grants, implied, "/shop/orders")


_WRITES = """w AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 10 = 0 THEN 'denied' WHEN o_orderkey % 17 = 0 THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN 'delete' ELSE 'put' END AS op, lpad((o_orderkey % 5000)::VARCHAR, 12, '0') AS k, o_orderstatus AS v FROM orders)"""


@query("tbl_write_outcomes", f"WITH {_WRITES} SELECT status, op, count(*) AS n FROM w GROUP BY ALL")
def tbl_write_outcomes(spark, d):
    return _judged(spark, d).groupBy("status", "op").agg(F.count("*").alias("n"))


@query("tbl_write_apply", f"WITH {_WRITES}, l AS (SELECT k, max_by(op, seq) AS op, max_by(v, seq) AS v FROM w WHERE status = 'ok' GROUP BY k) SELECT k, v FROM {_KV} WHERE k NOT IN (SELECT k FROM l) UNION ALL SELECT k, v FROM l WHERE op = 'put'")
def tbl_write_apply(spark, d):
    return store.apply(_kv(_orders(spark, d)), _judged(spark, d))


@query("kv_delete_one", "SELECT o_orderkey, true AS existed FROM orders WHERE o_orderkey <> 7")
def kv_delete_one(spark, d):
    left, existed = kv.delete_one(_orders(spark, d), 7, "o_orderkey")
    return left.select("o_orderkey").join(F.broadcast(existed), F.lit(True)).withColumnRenamed("found", "existed")


def _sharded(spark: SparkSession, d: str) -> DataFrame:
    return store.routed(_orders(spark, d), (F.col("o_orderkey") % 4).cast("int"))


@query("kv_shard_life", "SELECT s AS shard, CASE WHEN s = 9 THEN 0 ELSE (SELECT count(*) FROM orders WHERE o_orderkey % 4 = s) END::BIGINT AS n_keys FROM (VALUES (0), (1), (3), (9)) v(s)")
def kv_shard_life(spark, d):
    rows = _sharded(spark, d)
    shards = store.create_shard(spark.createDataFrame([(i,) for i in range(4)], "shard int"), 9)
    return store.list_shards(*store.drop_shard(rows, shards, 2))


@query("kv_clear_shard", "SELECT o_orderkey % 4 AS shard, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 1 GROUP BY 1")
def kv_clear_shard(spark, d):
    return store.clear(_sharded(spark, d), 1).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"))


@query("kv_shard_exists", "SELECT true AS found")
def kv_shard_exists(spark, d):
    return store.shard_exists(_sharded(spark, d).select("shard").distinct(), 3)


@query("kv_full_scan", f"SELECT k, v FROM {_KV} ORDER BY k")
def kv_full_scan(spark, d):
    return _kv(kv.scan(_orders(spark, d), KeyRange.all(), "o_orderkey"))


@query("mvcc_watermark", "SELECT min(o_orderkey) AS watermark FROM orders WHERE o_orderkey % 7 = 3 AND o_orderkey > 100")
def mvcc_watermark(spark, d):
    return mvcc.watermark(table(spark, d, "orders").filter("o_orderkey > 100").select(F.col("o_orderkey").alias("ts"), (F.col("o_orderkey") % 7 == 3).alias("open")))


# ---------------------------------------------------------------- catalogue


def _objects(spark: SparkSession, d: str) -> DataFrame:
    """A table object for each nation, below its region."""
    n = table(spark, d, "nation")
    return n.select(F.concat(F.lit("/r"), "n_regionkey", F.lit("/"), "n_name").alias("path"), F.lit("table").alias("kind"), F.concat(F.lit("v"), F.col("n_nationkey")).alias("body"), F.lit(1).alias("version"))


_OBJECTS = "o AS (SELECT '/r' || n_regionkey || '/' || n_name AS path, 'table' AS kind, 'v' || n_nationkey AS body, 1 AS version, n_regionkey FROM nation)"


@query("cat_get_object", f"WITH {_OBJECTS} SELECT path, kind, body, version FROM o WHERE body = 'v3'")
def cat_get_object(spark, d):
    path = table(spark, d, "nation").filter("n_nationkey = 3").select(F.concat(F.lit("/r"), "n_regionkey", F.lit("/"), "n_name")).first()[0]
    return catalog.get_object(_objects(spark, d), path)


@query("cat_list_namespace", f"WITH {_OBJECTS} SELECT path, body FROM o WHERE n_regionkey = 2")
def cat_list_namespace(spark, d):
    return catalog.objects_of(_objects(spark, d), "/r2", "table").select("path", "body")


@query("cat_object_life", f"WITH {_OBJECTS}, u AS (SELECT path, kind, CASE WHEN n_regionkey = 1 THEN 'new' ELSE body END AS body, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS version FROM o WHERE n_regionkey <> 4) SELECT * FROM u UNION ALL SELECT '/fn/gross', 'function', 'net * 1.2', 1")
def cat_object_life(spark, d):
    have = _objects(spark, d)
    have = catalog.create_objects(have, spark.createDataFrame([("/fn/gross", "function", "net * 1.2")], "path string, kind string, body string"))
    have = catalog.update_objects(have, have.filter("path like '/r1/%'").select("path", F.lit("new").alias("body")))
    return catalog.delete_objects(have, "/r4")


@query("cat_function_call", "SELECT o_orderkey, round(o_totalprice * 0.9 + 1, 6) AS price FROM orders")
def cat_function_call(spark, d):
    have = spark.createDataFrame([("/fn/cut", "function", "round(o_totalprice * 0.9D + 1, 6)", 1)], "path string, kind string, body string, version int")
    return catalog.call_function(have, "/fn/cut", table(spark, d, "orders"), "price").select("o_orderkey", "price")


@query("cat_quota_alerts", """WITH u AS (SELECT user_id % 5 AS tenant, round(sum(value), 2) AS used FROM events GROUP BY 1), l(tenant, quota) AS (VALUES (0, 1.0::DOUBLE), (1, 1e12::DOUBLE), (7, 5.0::DOUBLE))
SELECT coalesce(u.tenant, l.tenant) AS tenant, coalesce(used, 0.0::DOUBLE) AS used, quota, coalesce(coalesce(used, 0) > quota, false) AS exceeded,
  CASE WHEN quota IS NULL THEN 'no limit' WHEN coalesce(used, 0) / quota > 1 THEN 'exceeded' WHEN coalesce(used, 0) / quota >= 0.8 THEN 'near' ELSE 'ok' END AS alert FROM u FULL JOIN l ON u.tenant = l.tenant""")
def cat_quota_alerts(spark, d):
    usage = table(spark, d, "events").select((F.col("user_id") % 5).alias("tenant"), "value")
    return catalog.quota_usage(usage, spark.createDataFrame([(0, 1.0), (1, 1e12), (7, 5.0)], "tenant long, quota double"), "tenant", "value")


# ---------------------------------------------------------------- text, from stored postings


def _index(spark: SparkSession, d: str) -> str:
    path = scratch.folder(spark, f"text-index-{uuid.uuid4().hex}")
    text.build_index(_docs(spark, d), path)
    return path


@query("txt_index_search", _search_sql(_TERMS, "bm25"))
def txt_index_search(spark, d):
    return text.search_index(spark, _index(spark, d), "the stupid de und", 10)


@query("txt_index_phrase", f"WITH {_TOK}, h AS (SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the') SELECT doc_id FROM h")
def txt_index_phrase(spark, d):
    return text.search_index(spark, _index(spark, d), "of the", None, phrase=True).select("doc_id")


_OF_THE = "WHERE term IN ('stupid', 'license')"


@query("txt_index_update", f"""WITH {_TOK}, p AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL)
SELECT term, doc_id, tf FROM p {_OF_THE} AND doc_id % 3 <> 0 UNION ALL SELECT 'license', doc_id, 2 FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0""")
def txt_index_update(spark, d):
    have = text.postings(_docs(spark, d), terms=["stupid", "license"])
    third = _docs(spark, d).filter("doc_id % 3 = 0").withColumn("text", F.when(F.col("doc_id") % 2 == 0, "license: LICENSE"))
    return text.update_postings(have, third).select("term", "doc_id", "tf")


@query("txt_index_delete", f"WITH {_TOK} SELECT term, doc_id, count(*) AS tf FROM tok {_OF_THE} AND doc_id % 4 <> 1 GROUP BY ALL")
def txt_index_delete(spark, d):
    gone = _docs(spark, d).filter("doc_id % 4 = 1")
    return text.delete_postings(text.postings(_docs(spark, d), terms=["stupid", "license"]), gone).select("term", "doc_id", "tf")


@query("txt_phrase_highlights", f'WITH {_TOK} SELECT a.doc_id, a.pos::INT AS "start", (a.pos + 2)::INT AS "end" FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = \'of\' AND b.term = \'the\'')
def txt_phrase_highlights(spark, d):
    return text.phrase_highlights(_docs(spark, d), "of the")


@query("txt_stop_words", f"WITH {_TOK} SELECT doc_id, count(*) AS n FROM tok WHERE term NOT IN ('the', 'of', 'de') GROUP BY doc_id")
def txt_stop_words(spark, d):
    return _docs(spark, d).select("doc_id", F.size(text.Tokenizer(stop_words=("the", "of", "de")).column(F.col("text"))).cast("long").alias("n")).filter("n > 0")


# ---------------------------------------------------------------- indexes


def _by_price(spark: SparkSession, d: str) -> DataFrame:
    return index.build(table(spark, d, "orders"), "o_totalprice", "o_orderkey")


@query("idx_reverse_limit", "SELECT o_totalprice AS indexed_value, o_orderkey AS primary_key FROM orders WHERE o_totalprice < 400000 ORDER BY o_totalprice DESC LIMIT 25")
def idx_reverse_limit(spark, d):
    return index.range_scan(_by_price(spark, d), KeyRange.from_to(None, 400000.0).reversed().with_limit(25))


@query("idx_get_pk", "SELECT o_totalprice AS indexed_value, o_orderkey AS primary_key FROM orders WHERE o_orderkey = 42")
def idx_get_pk(spark, d):
    return index.get(_by_price(spark, d), 42)


@query("idx_delete", "SELECT count(*) AS entries FROM orders WHERE o_orderstatus <> 'F'")
def idx_delete(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("primary_key"))
    return index.delete(_by_price(spark, d), gone).agg(F.count("*").alias("entries"))


@query("idx_composite", "SELECT o_orderkey AS primary_key FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice >= 300000) OR (o_orderstatus > 'F' AND o_orderstatus < 'P')")
def idx_composite(spark, d):
    ix = index.build_composite(table(spark, d, "orders"), ["o_orderstatus", "o_totalprice"], "o_orderkey")
    low, high = F.struct(F.lit("F").alias("o_orderstatus"), F.lit(300000.0).alias("o_totalprice")), F.struct(F.lit("P").alias("o_orderstatus"), F.lit(-1.0).alias("o_totalprice"))
    return ix.filter((F.col("indexed_value") >= low) & (F.col("indexed_value") < high)).select("primary_key")


# ---------------------------------------------------------------- filters and relations


@query("flt_nested_logic", "SELECT event_id FROM events WHERE (json_extract(props, '$.k')::INT > 90 OR json_extract(props, '$.k')::INT < 5) AND NOT (json_extract_string(props, '$.k') = '3') AND json_extract(props, '$.k') IS NOT NULL")
def flt_nested_logic(spark, d):
    tree = {"nested": ["props", {"and": [{"or": [{"gt": ["k", 90]}, {"lt": ["k", 5]}]}, {"not": {"eq": ["k", "3"]}}, {"is_not_null": "k"}]}]}
    return table(spark, d, "events").filter(filters.compile_filter(tree)).select("event_id")


@query("flt_like_regex_rows", "SELECT p_partkey FROM part WHERE p_type LIKE '%O%' AND regexp_matches(p_brand, '#[1-3][0-9]?')")
def flt_like_regex_rows(spark, d):
    return table(spark, d, "part").filter(filters.compile_filter({"and": [{"like": ["p_type", "%O%"]}, {"regex": ["p_brand", "#[1-3][0-9]?"]}]})).select("p_partkey")


@query("rel_anti_rows", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def rel_anti_rows(spark, d):
    return relational.anti(table(spark, d, "customer"), table(spark, d, "orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("rel_full_join", "SELECT n_nationkey, s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) s ON n_nationkey = s_nationkey")
def rel_full_join(spark, d):
    n, s = table(spark, d, "nation").filter("n_nationkey % 2 = 0"), table(spark, d, "supplier").filter("s_suppkey % 3 = 0")
    return relational.join(n, s, F.col("n_nationkey") == F.col("s_nationkey"), "full").select("n_nationkey", "s_suppkey")


@query("rel_expressions", "SELECT o_orderkey, round((o_totalprice - 10) / 3 + o_custkey % 7, 6) AS a, o_orderstatus IS NOT DISTINCT FROM 'F' AS same, upper(left(o_orderpriority, 3)) AS p FROM orders")
def rel_expressions(spark, d):
    as_map = F.create_map(F.lit("status"), F.col("o_orderstatus"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.round((F.col("o_totalprice") - 10) / 3 + F.col("o_custkey") % 7, 6).alias("a"), as_map["status"].eqNullSafe("F").alias("same"), F.upper(F.substring("o_orderpriority", 1, 3)).alias("p")
    )


# ---------------------------------------------------------------- graph, vectors, front end


@query("gr_get_node", f"WITH {_NODES} SELECT id, label FROM nodes WHERE id = 'n3'")
def gr_get_node(spark, d):
    return graph.get_node(nodes(spark, d), "n3").select("id", "label")


@query("gr_get_edge", f"WITH {_EDGES} SELECT src, dst, type FROM edges WHERE src = 'n3' AND type = 'IN_REGION'")
def gr_get_edge(spark, d):
    e = edges(spark, d)
    dst = table(spark, d, "nation").filter("n_nationkey = 3").select(F.concat(F.lit("r"), "n_regionkey")).first()[0]
    return graph.get_edges(e, "n3", dst, "IN_REGION").select("src", "dst", "type")


@query("gr_put", f"WITH {_EDGES} SELECT type, count(*) AS n FROM (SELECT src, dst, type FROM edges UNION SELECT 'z1', 'n3', 'NEW' UNION SELECT 'z1', 'z1', 'NEW') GROUP BY type")
def gr_put(spark, d):
    n = nodes(spark, d)
    n = graph.put_nodes(n, spark.createDataFrame([("z1", "Zone")], "id string, label string"))
    new = spark.createDataFrame([("z1", "n3", "NEW"), ("z1", "z1", "NEW"), ("z1", "nowhere", "NEW")], "src string, dst string, type string")
    return graph.put_edges(n, edges(spark, d), new).groupBy("type").agg(F.count("*").alias("n"))


@query("gr_traverse_edge_filter", f"WITH {_EDGES} SELECT 'r1' AS id, 0 AS depth UNION SELECT src, 1 FROM edges WHERE dst = 'r1' AND src <> 'n3'")
def gr_traverse_edge_filter(spark, d):
    return graph.traverse(_start(spark, "r1"), edges(spark, d), 1, "in", edge_filter=F.col("src") != "n3")


@query("sql_match_where", f"WITH {_EDGES} SELECT a.src AS s, a.dst AS n, b.dst AS r FROM edges a JOIN edges b ON a.dst = b.src WHERE starts_with(a.src, 's') AND b.type = 'IN_REGION' AND b.dst = 'r2' AND a.dst <> 'n3'")
def sql_match_where(spark, d):
    return front.run(spark, "MATCH (s:Supplier)-[]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.id = 'r2' AND n.id <> 'n3' RETURN s, n, r", {"nodes": nodes(spark, d), "edges": edges(spark, d)})



def _dims(spark: SparkSession, d: str) -> int:
    return len(table(spark, d, "embeddings").select("embedding").first()[0])


@query("sql_vector_distance", "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], list_transform(range(1, len(embedding) + 1), lambda i: (i % 7)::DOUBLE)), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20")
def sql_vector_distance(spark, d):
    probe = ", ".join(str(float(i % 7)) for i in range(1, _dims(spark, d) + 1))
    return front.run(spark, f"SELECT vec_id, round(VECTOR_DISTANCE(embedding, [{probe}], 'cosine'), 6) AS distance FROM e ORDER BY distance, vec_id LIMIT 20", {"e": table(spark, d, "embeddings")})


@query("vec_mutate", "SELECT label, count(*) AS n FROM (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id % 5 <> 1 UNION ALL SELECT -9, -2) GROUP BY label")
def vec_mutate(spark, d):
    have = table(spark, d, "embeddings")
    some = have.filter("vec_id % 5 = 0").withColumn("label", F.lit(-1))
    new = have.limit(1).withColumn("vec_id", F.lit(-9).cast("long")).withColumn("label", F.lit(-2))
    left = vector.remove(vector.put(have, some.unionByName(new)), have.filter("vec_id % 5 = 1"))
    return left.groupBy("label").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- logs, import and export


@query("log_sound_prefix", "SELECT o_orderkey AS lsn, o_orderstatus AS v FROM orders WHERE o_orderkey < 700")
def log_sound_prefix(spark, d):
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("lsn"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("v"))
    log = tables.with_checksum(log).withColumn("v", F.when((F.col("lsn") >= 700) & (F.col("lsn") % 50 == 0), "?").otherwise(F.col("v")))
    return tables.sound_log(log).select("lsn", "v")


def _round_trip(spark: SparkSession, d: str, format: str) -> DataFrame:
    path = scratch.folder(spark, f"export-{uuid.uuid4().hex}")
    part = {"filter": {"gt": ["o_totalprice", 400000.0]}, "projection": ["o_orderkey", "o_orderstatus"]}
    tables.export(table(spark, d, "orders"), path, format, part)
    return tables.read_any(spark, path, format, "o_orderkey long, o_orderstatus string")


_PART = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 400000"


@query("io_json", _PART)
def io_json(spark, d):
    return _round_trip(spark, d, "json")


@query("io_csv", _PART)
def io_csv(spark, d):
    return _round_trip(spark, d, "csv")


@query("io_orc", _PART)
def io_orc(spark, d):
    return _round_trip(spark, d, "orc")


@query("io_encrypt", "SELECT c_custkey, c_name FROM customer")
def io_encrypt(spark, d):
    key = b"0123456789abcdef"
    return tables.decrypt(tables.encrypt(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", key), "c_name", key)
