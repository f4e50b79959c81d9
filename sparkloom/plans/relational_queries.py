"""Relational, index, catalog and interpreter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import catalog, index, kv, relational
from sparkloom.operators.kv import KeyRange
from sparkloom.plans.ir import Program
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query("rel_join", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000")
def rel_join(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 100000")
    return relational.join(table(spark, d, "customer"), big, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("rel_left_join", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def rel_left_join(spark, d):
    # orders are counted before the join: the join sees a row per customer
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return relational.join(table(spark, d, "customer").select("c_custkey"), n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("rel_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def rel_semi(spark, d):
    return relational.semi(table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("rel_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_anti(spark, d):
    return relational.anti(table(spark, d, "customer"), table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


_EXISTS = "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"


@query("rel_exists", _EXISTS)
def rel_exists(spark, d):
    return spark.sql(_EXISTS.replace("orders", "{orders}").replace("lineitem", "{lineitem}"), orders=table(spark, d, "orders"), lineitem=table(spark, d, "lineitem"))


@query("rel_apply", "SELECT o_orderkey, n_lines, max_price FROM orders, LATERAL (SELECT count(*) AS n_lines, max(l_extendedprice) AS max_price FROM lineitem WHERE l_orderkey = o_orderkey)")
def rel_apply(spark, d):
    return spark.sql(
        "SELECT o_orderkey, n_lines, max_price FROM {orders}, LATERAL (SELECT count(*) AS n_lines, max(l_extendedprice) AS max_price FROM {lineitem} WHERE l_orderkey = o_orderkey)",
        orders=table(spark, d, "orders"), lineitem=table(spark, d, "lineitem"),
    )


@query(
    "rel_aggregate",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
round(avg(l_discount), 6) AS avg_disc, min(l_quantity) AS min_qty, max(l_extendedprice) AS max_price FROM lineitem GROUP BY ALL""",
)
def rel_aggregate(spark, d):
    li = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    aggs = [("count", "l_orderkey", "n"), ("sum", "l_quantity", "sum_qty"), ("sum", "net", "revenue"), ("avg", "l_discount", "avg_disc"), ("min", "l_quantity", "min_qty"), ("max", "l_extendedprice", "max_price")]
    out = relational.aggregate(li, ["l_returnflag", "l_linestatus"], aggs)
    return out.withColumns({"sum_qty": F.round("sum_qty", 2), "revenue": F.round("revenue", 2), "avg_disc": F.round("avg_disc", 6)})


@query("rel_collect", "SELECT c_nationkey, array_to_string(list_sort(list(c_custkey)), ',') AS custkeys FROM customer GROUP BY c_nationkey")
def rel_collect(spark, d):
    out = relational.aggregate(table(spark, d, "customer"), ["c_nationkey"], [("collect", "c_custkey", "ids")])
    return out.select("c_nationkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("custkeys"))


@query("rel_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def rel_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("rel_union", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def rel_union(spark, d):
    return relational.union([table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"))], distinct=True)


@query("rel_union_all", "SELECT nationkey, count(*) AS n FROM (SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nationkey")
def rel_union_all(spark, d):
    both = relational.union([table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"))])
    return both.groupBy("nationkey").agg(F.count("*").alias("n"))


@query("rel_intersect", "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def rel_intersect(spark, d):
    return relational.intersect(table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey")))


@query("rel_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def rel_topk(spark, d):
    return relational.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 15)


@query("rel_top_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def rel_top_per_group(spark, d):
    return kv.top_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2)


# ---------------------------------------------------------------- indexes


def _by_customer(spark, d):
    return index.build(table(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_totalprice"])


@query("idx_range", "SELECT o_custkey AS indexed_value, o_orderkey AS primary_key FROM orders WHERE o_custkey >= 10 AND o_custkey <= 20")
def idx_range(spark, d):
    return index.range_scan(_by_customer(spark, d), KeyRange(10, 20, include_end=True)).select("indexed_value", "primary_key")


@query("idx_prefix", "SELECT p_brand AS indexed_value, p_partkey AS primary_key FROM part WHERE starts_with(p_brand, 'Brand#1')")
def idx_prefix(spark, d):
    return index.range_scan(index.build(table(spark, d, "part"), "p_brand", "p_partkey"), KeyRange.prefix("Brand#1"))


@query("idx_min_max", "SELECT min(o_custkey) AS min_key, max(o_custkey) AS max_key FROM orders")
def idx_min_max(spark, d):
    return index.extremes(_by_customer(spark, d))


@query("idx_count_range", "SELECT count(*) AS entries FROM orders WHERE o_custkey >= 10 AND o_custkey < 60")
def idx_count_range(spark, d):
    return index.count_range(_by_customer(spark, d), KeyRange.from_to(10, 60))


@query("idx_exact", "SELECT o_custkey AS indexed_value, o_orderkey AS primary_key FROM orders WHERE o_custkey = 17")
def idx_exact(spark, d):
    return index.exact(_by_customer(spark, d), 17).select("indexed_value", "primary_key")


@query("idx_covering", "SELECT o_custkey AS indexed_value, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey < 100 GROUP BY 1")
def idx_covering(spark, d):
    part = _by_customer(spark, d).filter("indexed_value < 100")
    return part.groupBy("indexed_value").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("idx_unique_violations", "SELECT p_name AS indexed_value, count(DISTINCT p_partkey) AS owners FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def idx_unique_violations(spark, d):
    return index.violations(index.build(table(spark, d, "part"), "p_name", "p_partkey"))


@query("idx_unique_lookup", "SELECT c_custkey AS primary_key FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def idx_unique_lookup(spark, d):
    by_name = index.build(table(spark, d, "customer"), "c_name", "c_custkey")
    return by_name.join(F.broadcast(index.extremes(by_name).select("min_key")), F.col("indexed_value") == F.col("min_key"), "left_semi").select("primary_key")


@query("idx_fetch", "SELECT o_custkey AS indexed_value, o_orderkey AS primary_key, o_orderstatus FROM orders WHERE o_custkey = 17")
def idx_fetch(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return index.fetch(index.exact(_by_customer(spark, d), 17), rows, "o_orderkey").select("indexed_value", "primary_key", "o_orderstatus")


@query(
    "idx_stats",
    """SELECT count(*) AS entries, sum(strlen(o_custkey::VARCHAR) + strlen(o_orderkey::VARCHAR))::BIGINT AS bytes,
round(avg(strlen(o_custkey::VARCHAR) + strlen(o_orderkey::VARCHAR)), 6) AS avg_entry_bytes, count(DISTINCT o_custkey) AS distinct_values FROM orders""",
)
def idx_stats(spark, d):
    return index.stats(_by_customer(spark, d))


# ---------------------------------------------------------------- catalog

_TABLES = [("orders", "/sales/orders"), ("order_lines", "/sales/lines"), ("parts", "/stock/parts"), ("orders_old", "/archive/orders")]
_GRANTS = [("ann", "TableAdmin", "/sales"), ("bob", "TableDataQuery", "/"), ("cyd", "TableDataInsert", "/stock/parts")]
_IMPLIED = [("TableAdmin", "TableDataQuery"), ("TableAdmin", "TableDataInsert")]
_WANTED = [("ann", "TableDataQuery", "/sales/orders"), ("ann", "TableDataQuery", "/stock/parts"), ("bob", "TableDataQuery", "/stock/parts"), ("bob", "TableDataInsert", "/sales/orders"), ("cyd", "TableDataInsert", "/stock/parts")]


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


@query("cat_tables_by_prefix", f"SELECT * FROM ({_values(_TABLES)}) t(name, path) WHERE starts_with(name, 'order') OR starts_with(path, 'order')")
def cat_tables_by_prefix(spark, d):
    return catalog.by_prefix(spark.createDataFrame(_TABLES, "name string, path string"), "order")


@query(
    "cat_permission_check",
    f"""WITH g AS (SELECT * FROM ({_values(_GRANTS)}) t(principal, permission, scope)), i AS (SELECT * FROM ({_values(_IMPLIED)}) t(permission, implies)),
w AS (SELECT principal, scope, permission FROM g UNION SELECT principal, scope, implies FROM g JOIN i USING (permission))
SELECT r.principal, r.permission, r.path, EXISTS (SELECT 1 FROM w WHERE w.principal = r.principal AND w.permission = r.permission
  AND (w.scope = '/' OR r.path = w.scope OR starts_with(r.path, w.scope || '/'))) AS allowed FROM ({_values(_WANTED)}) r(principal, permission, path)""",
)
def cat_permission_check(spark, d):
    make = spark.createDataFrame
    return catalog.permitted(make(_WANTED, "principal string, permission string, path string"), make(_GRANTS, "principal string, permission string, scope string"), make(_IMPLIED, "permission string, implies string"))


@query("cat_quota_usage", "SELECT user_id % 5 AS tenant, round(sum(value), 2) AS used, 5000.0::DOUBLE AS quota, sum(value) > 5000 AS exceeded FROM events GROUP BY 1")
def cat_quota_usage(spark, d):
    usage = table(spark, d, "events").select((F.col("user_id") % 5).alias("tenant"), "value")
    limits = spark.range(5).select(F.col("id").alias("tenant"), F.lit(5000.0).alias("quota"))
    return catalog.quota_usage(usage, limits, "tenant", "value").drop("alert")


@query("ir_opcode_plan", "SELECT l_returnflag, count(l_orderkey) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1 ORDER BY 1 LIMIT 2")
def ir_opcode_plan(spark, d):
    steps = [
        ("SCAN", {"in": "lineitem", "filter": {"gt": ["l_quantity", 25]}, "out": "r"}),
        ("AGGREGATE", {"in": "r", "keys": ["l_returnflag"], "aggs": [("count", "l_orderkey", "n")]}),
        ("SORT", {"in": "r", "keys": [("l_returnflag", "asc")]}),
        ("LIMIT", {"in": "r", "count": 2}),
    ]
    return Program({"lineitem": table(spark, d, "lineitem")}).run(steps)


@query(
    "ir_semi_apply_plan",
    """SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(l_partkey) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1) USING (o_orderkey)""",
)
def ir_semi_apply_plan(spark, d):
    steps = [
        ("FILTER", {"in": "orders", "sql": "o_orderstatus = 'O'", "out": "o"}),
        ("FILTER", {"in": "customer", "sql": "c_mktsegment = 'BUILDING'", "out": "c"}),
        ("SEMI_JOIN", {"in": "o", "with": "c", "on": "o_custkey = c_custkey"}),
        ("PROJECT", {"in": "lineitem", "columns": {"o_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_quantity": "l_quantity"}, "out": "l"}),
        ("APPLY", {"in": "o", "with": "l", "on": ["o_orderkey"], "aggs": [("count", "l_partkey", "n"), ("sum", "l_quantity", "total")]}),
        ("PROJECT", {"in": "o", "columns": {"o_orderkey": "o_orderkey", "n": "coalesce(n, 0)", "total": "coalesce(total, 0)"}}),
    ]
    return Program({t: table(spark, d, t) for t in ("orders", "customer", "lineitem")}).run(steps)
