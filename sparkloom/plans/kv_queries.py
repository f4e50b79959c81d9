"""Key-value, version-log, filter and document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import keys
from sparkloom.operators import filters, kv, mvcc
from sparkloom.operators.kv import KeyRange
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_KV = "(SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS k, o_orderpriority AS v, o_orderkey FROM orders)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """orders as a key-value table.  The stored number orders like the padded text, so ranges are pushed down on it."""
    return table(spark, d, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("k"), F.col("o_orderpriority").alias("v"))


def _kv(df: DataFrame) -> DataFrame:
    return df.select("k", "v")


@query("kv_get", f"SELECT k, v FROM {_KV} WHERE o_orderkey = 7")
def kv_get(spark, d):
    return _kv(kv.get(_orders(spark, d), 7, "o_orderkey"))


@query("kv_exists", "SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 7")
def kv_exists(spark, d):
    return kv.exists(_orders(spark, d), 7, "o_orderkey")


@query("kv_batch_get", f"SELECT ord, k, v FROM (VALUES (0, '000000000003'), (1, '999999999999'), (2, '000000000001'), (3, '000000000003')) w(ord, k) LEFT JOIN {_KV} USING (k)")
def kv_batch_get(spark, d):
    wanted = spark.createDataFrame([(0, "000000000003"), (1, "999999999999"), (2, "000000000001"), (3, "000000000003")], "ord int, k string")
    return kv.batch_get(_kv(_orders(spark, d)), wanted).select("ord", "k", "v")


@query("kv_range_scan", f"SELECT k, v FROM {_KV} WHERE o_orderkey >= 100 AND o_orderkey < 400 ORDER BY k LIMIT 50")
def kv_range_scan(spark, d):
    return _kv(kv.scan(_orders(spark, d), KeyRange.from_to(100, 400).with_limit(50), "o_orderkey"))


@query("kv_range_scan_reverse", f"SELECT k, v FROM {_KV} WHERE o_orderkey >= 100 AND o_orderkey < 400 ORDER BY k DESC LIMIT 50")
def kv_range_scan_reverse(spark, d):
    return _kv(kv.scan(_orders(spark, d), KeyRange.from_to(100, 400).reversed().with_limit(50), "o_orderkey"))


@query("kv_range_excl_bounds", f"SELECT k, v FROM {_KV} WHERE o_orderkey > 100 AND o_orderkey <= 160")
def kv_range_excl_bounds(spark, d):
    return _kv(kv.scan(_orders(spark, d), KeyRange(100, 160, include_start=False, include_end=True), "o_orderkey"))


@query("kv_prefix_scan", f"SELECT k, v FROM {_KV} WHERE starts_with(k, '00000000012')")
def kv_prefix_scan(spark, d):
    return _kv(kv.scan_prefix(_orders(spark, d), "00000000012"))


@query("kv_seek_page", f"SELECT k, v FROM {_KV} WHERE o_orderkey > 500 ORDER BY k LIMIT 25")
def kv_seek_page(spark, d):
    return _kv(kv.seek(_orders(spark, d), 500, 25, "o_orderkey", after=True))


@query("kv_key_count", "SELECT count(*) AS key_count FROM orders")
def kv_key_count(spark, d):
    return kv.key_count(_orders(spark, d))


@query("kv_shard_stats", f"SELECT (o_orderkey % 4)::INT AS shard, count(*) AS key_count, sum(strlen(k) + strlen(v))::BIGINT AS data_bytes FROM {_KV} GROUP BY 1")
def kv_shard_stats(spark, d):
    return kv.shard_stats(_orders(spark, d).withColumn("shard", (F.col("o_orderkey") % 4).cast("int")))


@query("kv_list_shards", "SELECT DISTINCT (o_orderkey % 4)::INT AS shard FROM orders")
def kv_list_shards(spark, d):
    return table(spark, d, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("shard")).distinct()


@query(
    "kv_route_hash",
    """SELECT c_custkey, (list_reduce(list_concat([14695981039346656037::HUGEINT], [ascii(x)::HUGEINT FOR x IN string_split(c_name, '')]),
  lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % 16)::BIGINT AS shard FROM customer""",
)
def kv_route_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", keys.hash_shard(F.col("c_name"), 16).alias("shard"))


@query("kv_route_range", "SELECT c_custkey, CASE WHEN c_custkey < 50 THEN 0 WHEN c_custkey >= 50 AND c_custkey < 100 THEN 1 WHEN c_custkey >= 100 AND c_custkey < 1000 THEN 2 ELSE 0 END AS shard FROM customer")
def kv_route_range(spark, d):
    return table(spark, d, "customer").select("c_custkey", keys.range_shard(F.col("c_custkey"), [(None, 50), (50, 100), (100, 1000)]).alias("shard"))


@query("kv_route_list", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 WHEN c_mktsegment IN ('AUTOMOBILE') THEN 1 WHEN c_mktsegment IN ('FURNITURE') THEN 2 ELSE 0 END AS shard FROM customer")
def kv_route_list(spark, d):
    return table(spark, d, "customer").select("c_custkey", keys.list_shard(F.col("c_mktsegment"), [["BUILDING", "MACHINERY"], ["AUTOMOBILE"], ["FURNITURE"]]).alias("shard"))


@query("kv_route_time", "SELECT event_id, abs((epoch(ts)::BIGINT // 3600) % 12)::INT AS shard FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def kv_route_time(spark, d):
    seconds = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    return table(spark, d, "events").select("event_id", keys.time_shard(seconds, 3600, 12).alias("shard"))


@query(
    "kv_batch_put_merge",
    f"""WITH puts AS (SELECT lpad((o_orderkey % 700)::VARCHAR, 12, '0') AS k, 'put-' || o_orderkey AS v, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 = 0),
newest AS (SELECT k, max_by(v, seq) AS v FROM puts GROUP BY k)
SELECT k, v FROM {_KV} WHERE k NOT IN (SELECT k FROM newest) UNION ALL SELECT k, v FROM newest""",
)
def kv_batch_put_merge(spark, d):
    base = _orders(spark, d)
    key = F.col("o_orderkey")
    puts = base.filter(key % 3 == 0).select(F.lpad((key % 700).cast("string"), 12, "0").alias("k"), F.concat(F.lit("put-"), key.cast("string")).alias("v"), key.alias("seq"))
    return kv.put(_kv(base), puts, order="seq")


@query("kv_batch_delete_count", "SELECT count(*) AS deleted FROM orders WHERE o_orderkey IN (SELECT l_partkey FROM lineitem)")
def kv_batch_delete_count(spark, d):
    gone = table(spark, d, "lineitem").select(F.col("l_partkey").alias("o_orderkey"))
    return kv.delete_count(_orders(spark, d), gone, "o_orderkey")


@query("kv_valid_keys", "SELECT c_custkey, strlen(c_name) > 0 AND c_name[1] <> chr(0) AS valid FROM customer")
def kv_valid_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", keys.valid_key(F.col("c_name")).alias("valid"))


# version log: user_id is the key, an error event is a tombstone, event_id is the commit timestamp + 1
_LOG = "(SELECT user_id AS k, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, event_id + 1 AS commit_ts, event_id AS seq FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("k"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"), (F.col("event_id") + 1).alias("commit_ts"), F.col("event_id").alias("seq"))


_NEWEST = f"SELECT k, arg_max_null(v, commit_ts) AS v, max(commit_ts) AS commit_ts FROM {_LOG}"


@query("mvcc_snapshot_read", f"SELECT * FROM ({_NEWEST} WHERE commit_ts <= 700 GROUP BY k) WHERE v IS NOT NULL")
def mvcc_snapshot_read(spark, d):
    return mvcc.snapshot(_log(spark, d), 700)


@query("mvcc_exists_at", f"SELECT k, v IS NOT NULL AS found FROM ({_NEWEST} WHERE commit_ts <= 700 GROUP BY k)")
def mvcc_exists_at(spark, d):
    return mvcc.exists_at(_log(spark, d), 700)


@query("mvcc_conflicts", f"SELECT DISTINCT k FROM {_LOG} WHERE commit_ts > 900 AND k < 40")
def mvcc_conflicts(spark, d):
    writes = spark.range(40).select(F.col("id").alias("k"))
    return mvcc.conflicts(_log(spark, d), writes, 900)


@query("mvcc_gc", f"SELECT k, v, commit_ts, seq FROM {_LOG} QUALIFY commit_ts > 800 OR row_number() OVER (PARTITION BY k, commit_ts > 800 ORDER BY commit_ts DESC) = 1")
def mvcc_gc(spark, d):
    return mvcc.collect_garbage(_log(spark, d), 800)


@query("tx_overlay_scan", f"SELECT k, v FROM (SELECT k, v FROM ({_NEWEST} WHERE commit_ts <= 900 GROUP BY k) WHERE v IS NOT NULL AND k NOT IN (3, 5, 1000) UNION ALL VALUES (3, 33.0), (1000, 1.5)) WHERE k >= 2 AND k < 2000 ORDER BY k DESC LIMIT 20")
def tx_overlay_scan(spark, d):
    tx = mvcc.Transaction(_log(spark, d), 900)
    tx.put(3, 33.0)
    tx.put(1000, 1.5)
    tx.delete(5)
    return tx.scan(KeyRange.from_to(2, 2000).reversed().with_limit(20))


@query("lsm_merge_compact", f"SELECT * FROM ({_NEWEST} GROUP BY k) WHERE v IS NOT NULL")
def lsm_merge_compact(spark, d):
    return mvcc.compact(_log(spark, d))


# ---------------------------------------------------------------- filters and documents


@query("flt_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount <> 0.05 AND l_tax <= 0.06 AND l_extendedprice > 1000 AND l_linestatus = 'O'")
def flt_compare(spark, d):
    tree = {"and": [{"gte": ["l_quantity", 10]}, {"lt": ["l_quantity", 20]}, {"ne": ["l_discount", 0.05]}, {"lte": ["l_tax", 0.06]}, {"gt": ["l_extendedprice", 1000]}, {"eq": ["l_linestatus", "O"]}]}
    return table(spark, d, "lineitem").filter(filters.compile_filter(tree)).select("l_orderkey", "l_linenumber")


@query("flt_in_notin", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_nationkey NOT IN (1, 2, 3)")
def flt_in_notin(spark, d):
    return table(spark, d, "customer").filter(filters.compile_filter({"and": [{"in": ["c_mktsegment", ["BUILDING", "FURNITURE"]]}, {"not_in": ["c_nationkey", [1, 2, 3]]}]})).select("c_custkey")


@query("flt_like_regex", "SELECT p_partkey FROM part WHERE p_type LIKE '%e%' AND regexp_matches(p_brand, '#[1-3][0-9]?')")
def flt_like_regex(spark, d):
    return table(spark, d, "part").filter(filters.compile_filter({"and": [{"like": ["p_type", "%e%"]}, {"regex": ["p_brand", "#[1-3][0-9]?"]}]})).select("p_partkey")


@query("flt_null", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND NOT (event_type IS NULL)")
def flt_null(spark, d):
    tree = {"and": [{"is_not_null": "props:$.k"}, {"not": {"is_null": "event_type"}}]}
    return table(spark, d, "events").filter(filters.compile_filter(tree)).select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("flt_bool_tree", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 50000) AND NOT (o_orderpriority LIKE '1%')")
def flt_bool_tree(spark, d):
    tree = {"and": [{"or": [{"eq": ["o_orderstatus", "O"]}, {"gt": ["o_totalprice", 50000]}]}, {"not": {"like": ["o_orderpriority", "1%"]}}]}
    return table(spark, d, "orders").filter(filters.compile_filter(tree)).select("o_orderkey")


@query(
    "flt_array_contains",
    """SELECT p_partkey, list_contains(t, 'a') AS has, list_has_all(t, ['e', 'r']) AS every, list_has_any(t, ['q', 'x', 'z']) AS some
FROM (SELECT p_partkey, string_split(lower(p_name), '') AS t FROM part)""",
)
def flt_array_contains(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.filter(F.split(F.lower("p_name"), ""), lambda x: x != "").alias("t"))
    c = filters.compile_filter
    return t.select("p_partkey", c({"contains": ["t", "a"]}).alias("has"), c({"contains_all": ["t", ["e", "r"]]}).alias("every"), c({"contains_any": ["t", ["q", "x", "z"]]}).alias("some"))


@query("flt_nested_json", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INT > 50")
def flt_nested_json(spark, d):
    e = table(spark, d, "events")
    return e.filter(filters.field("props:$.k").cast("int") > 50).select("event_id")


@query("flt_nested_tree", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '3')")
def flt_nested_tree(spark, d):
    return table(spark, d, "events").filter(filters.compile_filter({"nested": ["props", {"in": ["k", ["1", "2", "3"]]}]})).select("event_id")


@query("doc_query_sort_page", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def doc_query_sort_page(spark, d):
    q = {"filter": {"gt": ["c_acctbal", 0]}, "projection": ["c_custkey", "c_name", "c_acctbal"], "sort": [{"field": "c_acctbal", "order": "desc"}, {"field": "c_custkey"}], "limit": 20, "offset": 10}
    return filters.run_query(table(spark, d, "customer"), q)


@query("doc_json_query", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 100 ORDER BY c_custkey LIMIT 30")
def doc_json_query(spark, d):
    q = '{"filter": {"and": [{"eq": ["c_mktsegment", "BUILDING"]}, {"gte": ["c_acctbal", 100]}]}, "projection": ["c_custkey", "c_mktsegment"], "sort": [{"field": "c_custkey"}], "limit": 30}'
    return filters.run_query(table(spark, d, "customer"), q)


@query("doc_get", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def doc_get(spark, d):
    return kv.get(table(spark, d, "customer"), 42, "c_custkey").select("c_custkey", "c_name")


@query(
    "doc_patch",
    "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 20 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer",
)
def doc_patch(spark, d):
    docs = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    patches = docs.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment"), F.when(F.col("c_custkey") % 20 == 0, 0.0).alias("c_acctbal"))
    return filters.patch_documents(docs, patches, "c_custkey")
