"""Full-text, vector, spatial, graph, hybrid, embedding and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import embedding, graph, hybrid, spatial, text, vector
from sparkloom.operators.text import Tokenizer
from sparkloom.plans.registry import query
from sparkloom.sources.scratch import cut
from sparkloom.sources.tables import table
from sparkloom.streaming import replay

# ---------------------------------------------------------------- text

_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}!-/:-@\[-\x60{-~]+"
_TOK = f"""tok AS (SELECT doc_id, lower(t) AS term, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (
  SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '{_WS}') AS ws FROM documents)) WHERE t <> '')"""
_LEN = "dl AS (SELECT d.doc_id, coalesce(n, 0) AS dl FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) USING (doc_id)), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl)"
_SCORES = {
    "tf": "tf::DOUBLE", "tfidf": "tf * ln(st.n / (1 + df))",
    "bm25": "ln((st.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl.dl / st.avgdl))",
}
QUERY = "the stupid de und"


def _search_sql(terms: list[tuple[str, float]], scorer: str, having: str = "", limit: str = "ORDER BY score DESC, doc_id LIMIT 10") -> str:
    q = "q(term, w) AS (VALUES " + ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in terms) + ")"
    return f"""WITH {_TOK}, {_LEN}, {q}, p AS (SELECT term, doc_id, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1),
s AS (SELECT doc_id, round(sum(w * ({_SCORES[scorer]})), 6) AS score FROM p JOIN df USING (term) JOIN q USING (term) JOIN dl USING (doc_id), st GROUP BY doc_id)
SELECT doc_id, score FROM s {having} {limit}"""


_TERMS = [("the", 1.0), ("stupid", 1.0), ("de", 1.0), ("und", 1.0)]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query("txt_tokens", f"WITH {_TOK} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_unique FROM tok GROUP BY doc_id")
def txt_tokens(spark, d):
    t = Tokenizer().column(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_unique")).filter("n_tokens > 0")


_STEM = "CASE WHEN ends_with(t, 'ing') AND strlen(t) > 5 THEN left(t, -3) WHEN ends_with(t, 'ed') AND strlen(t) > 4 THEN left(t, -2) WHEN ends_with(t, 's') AND strlen(t) > 3 THEN left(t, -1) ELSE t END"


@query("txt_stem", f"WITH {_TOK}, s AS (SELECT {_STEM.replace('t,', 'term,').replace('(t)', '(term)').replace('ELSE t ', 'ELSE term ')} AS stem FROM tok) SELECT stem, count(*) AS n FROM s GROUP BY stem")
def txt_stem(spark, d):
    return _docs(spark, d).select(F.explode(Tokenizer(stemming=True).column(F.col("text"))).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query("txt_postings", f"WITH {_TOK} SELECT term, doc_id, array_to_string(list(pos ORDER BY pos), ',') AS positions, count(*) AS tf FROM tok WHERE term IN ('the', 'stupid', 'und') GROUP BY ALL")
def txt_postings(spark, d):
    p = text.postings(_docs(spark, d), terms=["the", "stupid", "und"])
    return p.select("term", "doc_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"), "tf")


@query("txt_postings_all", f"WITH {_TOK} SELECT term, doc_id, array_to_string(list(pos ORDER BY pos), ',') AS positions, count(*) AS tf FROM tok GROUP BY ALL")
def txt_postings_all(spark, d):
    p = text.postings(_docs(spark, d))
    return p.select("term", "doc_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"), "tf")


@query("txt_term_stats", f"WITH {_TOK}, p AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf, round(avg(tf), 6) AS avg_positions FROM p WHERE term IN ('the', 'stupid', 'moron') GROUP BY term")
def txt_term_stats(spark, d):
    return text.term_stats(_docs(spark, d), ["the", "stupid", "moron"]).withColumn("avg_positions", F.round("avg_positions", 6))


@query("txt_corpus_stats", f"WITH {_TOK}, {_LEN} SELECT count(*) AS n_docs, round(avg(dl), 6) AS avg_len, sum(dl)::BIGINT AS total_len FROM dl")
def txt_corpus_stats(spark, d):
    return text.corpus_stats(_docs(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


@query("txt_search_tf", _search_sql(_TERMS, "tf"))
def txt_search_tf(spark, d):
    return text.search(_docs(spark, d), QUERY, 10, "tf")


@query("txt_search_tfidf", _search_sql(_TERMS, "tfidf"))
def txt_search_tfidf(spark, d):
    return text.search(_docs(spark, d), QUERY, 10, "tfidf")


@query("txt_search_bm25", _search_sql(_TERMS, "bm25"))
def txt_search_bm25(spark, d):
    return text.search(_docs(spark, d), QUERY, 10, "bm25")


@query("txt_search_repeated", _search_sql([("stupid", 2.0), ("idiot", 1.0)], "bm25"))
def txt_search_repeated(spark, d):
    return text.search(_docs(spark, d), "stupid idiot stupid", 10, "bm25")


@query("txt_boost", _search_sql([("stupid", 3.0), ("idiot", 1.0)], "bm25"))
def txt_boost(spark, d):
    return text.search(_docs(spark, d), "stupid idiot", 10, "bm25", boosts={"stupid": 3.0})


_PHRASE = "JOIN (SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the') USING (doc_id)"


@query("txt_phrase", _search_sql([("of", 1.0), ("the", 1.0)], "bm25", _PHRASE))
def txt_phrase(spark, d):
    return text.phrase(_docs(spark, d), "of the", 10)


@query("txt_bool_and", f"WITH {_TOK} SELECT doc_id, 1.0::DOUBLE AS score FROM tok WHERE term IN ('of', 'the', 'stupid') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def txt_bool_and(spark, d):
    return text.boolean_and(_docs(spark, d), ["of", "the", "stupid"])


@query("txt_bool_or", _search_sql([("stupid", 1.0), ("moron", 1.0)], "bm25", limit=""))
def txt_bool_or(spark, d):
    return text.boolean_or(_docs(spark, d), ["stupid", "moron"], None)


@query("txt_bool_not", f"WITH {_TOK} SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok WHERE term IN ('the', 'de'))")
def txt_bool_not(spark, d):
    return text.boolean_not(_docs(spark, d), ["the", "de"])


@query(
    "txt_bool_nested",
    f"WITH {_TOK}, h AS (SELECT doc_id, bool_or(term = 'the') AS a, bool_or(term = 'stupid') AS b, bool_or(term = 'moron') AS c FROM tok GROUP BY 1) SELECT doc_id, 1.0::DOUBLE AS score FROM h WHERE a AND (b OR c) AND NOT (b AND c)",
)
def txt_bool_nested(spark, d):
    return text.boolean(_docs(spark, d), {"and": ["the", {"or": ["stupid", "moron"]}, {"not": {"and": ["stupid", "moron"]}}]})


@query(
    "txt_highlights",
    f"WITH {_TOK} SELECT doc_id, array_to_string(list(term || ':' || pos || ':' || (pos + strlen(term)) ORDER BY pos), ' ') AS marks FROM tok WHERE term IN ('stupid', 'idiot') GROUP BY doc_id",
)
def txt_highlights(spark, d):
    hits = text.search(_docs(spark, d), "stupid idiot", None, highlights=True)
    mark = lambda h: F.concat_ws(":", h["fragment"], h["start"].cast("string"), h["end"].cast("string"))
    return hits.select("doc_id", F.array_join(F.transform("highlights", mark), " ").alias("marks"))


# ---------------------------------------------------------------- vectors

_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_DIST = {
    "l2": "sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "cosine": "1 - list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x))))",
    "dot": "-list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: p[1] * p[2]))",
    "l1": "list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: abs(p[1] - p[2])))",
}


def _knn_sql(metric: str, k: int = 10, where: str = "true") -> str:
    r = f"round({_DIST[metric]}, 6)"
    return f"SELECT vec_id, label, CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END AS distance FROM embeddings, {_Q} WHERE {where} ORDER BY distance, vec_id LIMIT {k}"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _knn(name: str, metric: str, sql_metric: str):
    @query(name, _knn_sql(sql_metric))
    def run(spark, d):
        e = _vectors(spark, d)
        return vector.knn(e, vector.vector_of(e, 0), 10, metric)

    return run


vec_knn_l2, vec_knn_cosine, vec_knn_dot, vec_knn_l1 = (_knn(f"vec_knn_{s}", m, s) for m, s in (("euclidean", "l2"), ("cosine", "cosine"), ("dot", "dot"), ("manhattan", "l1")))


@query("vec_range", f"SELECT vec_id, distance FROM (SELECT vec_id, round({_DIST['l2']}, 6) AS distance FROM embeddings, {_Q}) WHERE distance <= 1.2")
def vec_range(spark, d):
    e = _vectors(spark, d)
    return vector.within(e, vector.vector_of(e, 0), 1.2)


@query("vec_prefilter", _knn_sql("cosine", 10, "label = 3"))
def vec_prefilter(spark, d):
    e = _vectors(spark, d)
    return vector.knn(e, vector.vector_of(e, 0), 10, "cosine", F.col("label") == 3)


@query("vec_postfilter", f"SELECT * FROM ({_knn_sql('cosine', 50)}) WHERE label = 3")
def vec_postfilter(spark, d):
    e = _vectors(spark, d)
    return vector.knn(e, vector.vector_of(e, 0), 50, "cosine").filter("label = 3")


@query("vec_stats", "SELECT count(*) AS vectors, max(len(embedding))::INT AS dimensions, round(avg(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 6) AS avg_magnitude FROM embeddings")
def vec_stats(spark, d):
    return vector.vector_stats(_vectors(spark, d))


@query(
    "vec_join",
    f"SELECT vec_id, distance, doc_id, lang FROM ({_knn_sql('cosine', 20)}) JOIN documents ON doc_id = vec_id",
)
def vec_join(spark, d):
    e = _vectors(spark, d)
    hits = vector.knn(e, vector.vector_of(e, 0), 20, "cosine")
    return hits.join(table(spark, d, "documents").select("doc_id", "lang"), F.col("doc_id") == F.col("vec_id")).select("vec_id", "distance", "doc_id", "lang")


@query(
    "vec_simjoin",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, 1 - list_cosine_similarity(a.e, b.e) AS distance
FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)
SELECT query_id, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 3""",
)
def vec_simjoin(spark, d):
    e = _vectors(spark, d).select("vec_id", "embedding")
    return vector.neighbours_of_queries(e, e.filter("vec_id % 20 = 0"), 3, "cosine").withColumn("distance", F.round("distance", 6))


# the parameters of each index kind, for its query and for vec_recall
_IVF, _IVFPQ, _LSH = {"n_probe": 12}, {"n_probe": 12, "refine": 64}, {"tables": 64}


def _asked(e: DataFrame) -> DataFrame:
    return e.filter("vec_id % 20 = 0").select("vec_id", "embedding")


@query("vec_ivf_knn")
def vec_ivf_knn(spark, d):
    e = _vectors(spark, d)
    return vector.IVF(e, n_lists=16).knn_of_queries(_asked(e), 10, **_IVF)


@query("vec_ivfpq_knn")
def vec_ivfpq_knn(spark, d):
    e = _vectors(spark, d)
    return vector.IVF(e, n_lists=16, sub_quantizers=8).knn_of_queries(_asked(e), 10, **_IVFPQ)


@query("vec_lsh_knn")
def vec_lsh_knn(spark, d):
    e = _vectors(spark, d)
    return vector.lsh_knn_of_queries(e, _asked(e), 10, **_LSH)


@query("vec_recall")
def vec_recall(spark, d):
    e = _vectors(spark, d)
    kinds = ("ivf", vec_ivf_knn, "euclidean"), ("ivfpq", vec_ivfpq_knn, "euclidean"), ("lsh", vec_lsh_knn, "cosine")
    truth = {metric: cut(vector.neighbours_of_queries(e, _asked(e), 10, metric).select("query_id", "vec_id")) for metric in ("euclidean", "cosine")}
    rows = [vector.recall(found(spark, d), truth[metric], ["query_id", "vec_id"]).select(F.lit(kind).alias("kind"), "recall") for kind, found, metric in kinds]
    return rows[0].union(rows[1]).union(rows[2])


# ---------------------------------------------------------------- space

_POINTS = "(SELECT c_custkey AS id, (c_custkey * 37 % 18000) / 100.0::DOUBLE - 90 AS lat, (c_custkey * 91 % 36000) / 100.0::DOUBLE - 180 AS lon FROM customer)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(c.alias("id"), ((c * 37 % 18000) / 100.0 - 90).alias("lat"), ((c * 91 % 36000) / 100.0 - 180).alias("lon"))


@query("geo_bbox", f"SELECT id FROM {_POINTS} WHERE lat BETWEEN -60 AND 20 AND lon BETWEEN -150 AND 50")
def geo_bbox(spark, d):
    return spatial.query_box(_points(spark, d), (-60, -150, 20, 50)).select("id")


@query("geo_knn", f"SELECT id, round(sqrt((lat - 10) * (lat - 10) + (lon - 20) * (lon - 20)), 6) AS distance FROM {_POINTS} ORDER BY distance, id LIMIT 12")
def geo_knn(spark, d):
    return spatial.query_knn(_points(spark, d), (10, 20), 12)


@query("geo_manhattan", f"SELECT id, round(abs(lat - 10) + abs(lon - 20), 6) AS distance FROM {_POINTS} ORDER BY distance, id LIMIT 12")
def geo_manhattan(spark, d):
    return spatial.query_knn(_points(spark, d), (10, 20), 12, "manhattan")


@query(
    "geo_radius_haversine",
    f"""SELECT id, distance FROM (SELECT id, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2))), 6) AS distance FROM {_POINTS}) WHERE distance <= 4000""",
)
def geo_radius_haversine(spark, d):
    return spatial.query_radius(_points(spark, d), (10, 20), 4000, "haversine")


_CORNERS = [(-50.0, -100.0), (40.0, -60.0), (60.0, 30.0), (0.0, 10.0), (-30.0, 120.0)]


def _polygon_sql() -> str:
    parts = [f"(((lon < {y1}) <> (lon < {y2})) AND lat < {x1} + (lon - ({y1})) * ({(x2 - x1) / (y2 - y1)!r}::DOUBLE))::INT" for (x1, y1), (x2, y2) in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1])]
    return f"SELECT id FROM {_POINTS} WHERE ({' + '.join(parts)}) % 2 = 1"


@query("geo_polygon", _polygon_sql())
def geo_polygon(spark, d):
    return spatial.query_polygon(_points(spark, d), _CORNERS).select("id")


@query("geo_stats", f"SELECT count(*) AS points, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, round(count(*) / ((max(lat) - min(lat)) * (max(lon) - min(lon))), 6) AS density FROM {_POINTS}")
def geo_stats(spark, d):
    return spatial.spatial_stats(_points(spark, d))


# ---------------------------------------------------------------- graph

_NODES = """nodes AS (SELECT 'c' || c_custkey AS id, 'Customer' AS label FROM customer UNION ALL SELECT 'o' || o_orderkey, 'Order' FROM orders UNION ALL SELECT 'p' || p_partkey, 'Part' FROM part
UNION ALL SELECT 's' || s_suppkey, 'Supplier' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'Region' FROM region)"""
_EDGES = """edges AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'PLACED' AS type FROM orders UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'CONTAINS' FROM lineitem
UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'SUPPLIES' FROM lineitem UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN_NATION' FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IN_NATION' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'IN_REGION' FROM nation)"""
_BOTH = f"{_EDGES}, both_ AS (SELECT src, dst, type FROM edges UNION ALL SELECT dst, src, type FROM edges)"


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = (("customer", "c", "c_custkey", "Customer"), ("orders", "o", "o_orderkey", "Order"), ("part", "p", "p_partkey", "Part"), ("supplier", "s", "s_suppkey", "Supplier"), ("nation", "n", "n_nationkey", "Nation"), ("region", "r", "r_regionkey", "Region"))
    out = None
    for t, prefix, c, label in parts:
        rows = table(spark, d, t).select(_id(prefix, c).alias("id"), F.lit(label).alias("label"))
        out = rows if out is None else out.union(rows)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    parts = (
        ("orders", "c", "o_custkey", "o", "o_orderkey", "PLACED"), ("lineitem", "o", "l_orderkey", "p", "l_partkey", "CONTAINS"), ("lineitem", "s", "l_suppkey", "p", "l_partkey", "SUPPLIES"),
        ("customer", "c", "c_custkey", "n", "c_nationkey", "IN_NATION"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "IN_NATION"), ("nation", "n", "n_nationkey", "r", "n_regionkey", "IN_REGION"),
    )
    out = n = None
    for t, p1, c1, p2, c2, kind in parts:
        rows = table(spark, d, t).select(c1, c2)
        if t == "lineitem":  # a partition holds as many rows in a larger table
            n = n or max(spark.sparkContext.defaultParallelism, -(-rows.count() // 1_000_000))
            rows = rows.repartition(n, c1, c2).distinct()
        rows = rows.select(_id(p1, c1).alias("src"), _id(p2, c2).alias("dst"), F.lit(kind).alias("type"))
        out = rows if out is None else out.union(rows)
    return out


def _start(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query("gr_scan_label", f"WITH {_NODES} SELECT id FROM nodes WHERE label = 'Supplier'")
def gr_scan_label(spark, d):
    return graph.scan_nodes(nodes(spark, d), "Supplier").select("id")


@query("gr_scan_edge", f"WITH {_EDGES} SELECT src, dst FROM edges WHERE type = 'IN_REGION'")
def gr_scan_edge(spark, d):
    return graph.scan_edges(edges(spark, d), "IN_REGION").select("src", "dst")


@query("gr_expand_out", f"WITH {_EDGES} SELECT src AS id, dst AS neighbor, type AS neighbor_type FROM edges WHERE src IN ('c1', 'c4', 'n3')")
def gr_expand_out(spark, d):
    return graph.expand(_start(spark, "c1", "c4", "n3"), edges(spark, d))


@query("gr_expand_in", f"WITH {_EDGES} SELECT dst AS id, src AS neighbor, type AS neighbor_type FROM edges WHERE dst IN ('p1', 'n3')")
def gr_expand_in(spark, d):
    return graph.expand(_start(spark, "p1", "n3"), edges(spark, d), direction="in")


@query("gr_expand_both", f"WITH {_BOTH} SELECT src AS id, dst AS neighbor, type AS neighbor_type FROM both_ WHERE src IN ('n3', 'o1')")
def gr_expand_both(spark, d):
    return graph.expand(_start(spark, "n3", "o1"), edges(spark, d), direction="both")


@query("gr_optional_expand", f"WITH {_EDGES} SELECT c.id, dst AS neighbor, type AS neighbor_type FROM (SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey <= 30) c LEFT JOIN edges ON src = c.id AND type = 'PLACED'")
def gr_optional_expand(spark, d):
    start = table(spark, d, "customer").filter("c_custkey <= 30").select(_id("c", "c_custkey").alias("id"))
    return graph.expand(start, edges(spark, d), kinds=["PLACED"], optional=True)


@query("gr_match_2hop", "SELECT 'c' || o_custkey AS a, 'o' || l_orderkey AS b, 'p' || l_partkey AS c FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey <= 200")
def gr_match_2hop(spark, d):
    few = edges(spark, d).filter("type <> 'PLACED' or cast(substring(dst, 2) as long) <= 200")
    return graph.match(nodes(spark, d), few, "(a:Customer)-[:PLACED]->(b:Order)-[:CONTAINS]->(c:Part)")


@query("gr_optional_expand_all", f"WITH {_EDGES} SELECT c.id, dst AS neighbor, type AS neighbor_type FROM (SELECT 'c' || c_custkey AS id FROM customer) c LEFT JOIN edges ON src = c.id AND type = 'PLACED'")
def gr_optional_expand_all(spark, d):
    start = table(spark, d, "customer").select(_id("c", "c_custkey").alias("id"))
    return graph.expand(start, edges(spark, d), kinds=["PLACED"], optional=True)


@query("gr_match_2hop_all", "SELECT 'c' || o_custkey AS a, 'o' || l_orderkey AS b, 'p' || l_partkey AS c FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey")
def gr_match_2hop_all(spark, d):
    return graph.match(nodes(spark, d), edges(spark, d), "(a:Customer)-[:PLACED]->(b:Order)-[:CONTAINS]->(c:Part)")


@query("gr_path_construct", "SELECT 'n' || n_nationkey || '>r' || n_regionkey AS path FROM nation")
def gr_path_construct(spark, d):
    rows = graph.match(nodes(spark, d), edges(spark, d), "(a:Nation)-[e:IN_REGION]->(b:Region)")
    return graph.construct_paths(rows, ["a", "b"], ["e"]).select(F.array_join("path.nodes", ">").alias("path"))


_BFS = f"""WITH RECURSIVE {_BOTH}, b AS (SELECT DISTINCT src, dst FROM both_),
walk(id, depth) AS (SELECT 's1', 0 UNION SELECT dst, depth + 1 FROM walk JOIN b ON src = id WHERE depth < 3)
SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id"""


@query("gr_traverse_bfs", _BFS)
def gr_traverse_bfs(spark, d):
    return graph.traverse(_start(spark, "s1"), edges(spark, d), 3, "both")


@query("gr_traverse_typed", f"WITH {_EDGES} SELECT 'c1' AS id, 0 AS depth UNION SELECT dst, 1 FROM edges WHERE src = 'c1' AND type = 'PLACED' UNION SELECT p.dst, 2 FROM edges o JOIN edges p ON o.dst = p.src WHERE o.src = 'c1' AND o.type = 'PLACED' AND p.type = 'CONTAINS'")
def gr_traverse_typed(spark, d):
    return graph.traverse(_start(spark, "c1"), edges(spark, d), 2, "out", ["PLACED", "CONTAINS"])


@query("gr_shortest_path", f"WITH w AS ({_BFS.replace('SELECT id, min', 'SELECT id, min')}) SELECT id AS target, depth FROM w WHERE id = 'p17'")
def gr_shortest_path(spark, d):
    return graph.shortest_path_length(edges(spark, d), _start(spark, "s1"), "p17", 3)


@query("gr_has_path", f"WITH w AS ({_BFS}) SELECT count(*) > 0 AS found FROM w WHERE id = 'r2'")
def gr_has_path(spark, d):
    return graph.has_path(edges(spark, d), _start(spark, "s1"), "r2", 3)


@query(
    "gr_find_paths",
    f"""WITH RECURSIVE {_EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('IN_NATION', 'IN_REGION')), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
walk(path, at_, depth) AS (SELECT ['s1'], 's1', 0 UNION ALL SELECT list_append(path, dst), dst, depth + 1 FROM walk JOIN b ON src = at_ WHERE depth < 3 AND at_ <> 's2' AND NOT list_contains(path, dst))
SELECT array_to_string(path, '>') AS path, depth::INT AS depth FROM walk WHERE at_ = (SELECT 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1) AND depth > 0""",
)
def gr_find_paths(spark, d):
    home = table(spark, d, "supplier").filter("s_suppkey = 1").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()[0]
    out = graph.find_paths(edges(spark, d), _start(spark, "s1"), f"r{home}", 3, "both", ["IN_NATION", "IN_REGION"])
    return out.select(F.array_join("path", ">").alias("path"), "depth")


@query("gr_delete_cascade", f"WITH {_EDGES} SELECT type, count(*) AS n FROM edges WHERE src NOT IN ('n3', 'c4') AND dst NOT IN ('n3', 'c4') GROUP BY type")
def gr_delete_cascade(spark, d):
    _, left = graph.delete_nodes(nodes(spark, d), edges(spark, d), _start(spark, "n3", "c4"))
    return left.groupBy("type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- hybrid and embeddings

_TEXT_TOP = _search_sql(_TERMS, "bm25", limit="ORDER BY score DESC, doc_id LIMIT 50")
_VEC_TOP = f"SELECT vec_id AS doc_id, round({_DIST['cosine']}, 6) AS distance FROM embeddings, {_Q} ORDER BY distance, doc_id LIMIT 50"


@query(
    "hyb_text_vector",
    f"""WITH t AS ({_TEXT_TOP}), v AS ({_VEC_TOP}),
tn AS (SELECT doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS a FROM t),
vn AS (SELECT doc_id, CASE WHEN max(distance) OVER () = min(distance) OVER () THEN 1 ELSE (max(distance) OVER () - distance) / (max(distance) OVER () - min(distance) OVER ()) END AS b FROM v)
SELECT doc_id, round(coalesce(a, 0) * 0.6 + coalesce(b, 0) * 0.4, 6) AS score FROM tn FULL JOIN vn USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""",
)
def hyb_text_vector(spark, d):
    e = _vectors(spark, d)
    by_text = text.search(_docs(spark, d), QUERY, 50)
    by_vector = vector.knn(e.select("vec_id", "embedding"), vector.vector_of(e, 0), 50, "cosine").withColumnRenamed("vec_id", "doc_id")
    return hybrid.combine([(by_text, "score", 0.6, False), (by_vector, "distance", 0.4, True)], "doc_id", 10)


@query(
    "hyb_multi_signal",
    f"""WITH t AS ({_TEXT_TOP}), v AS ({_VEC_TOP}), f AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50),
tn AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS a FROM t),
vn AS (SELECT doc_id, (max(distance) OVER () - distance) / (max(distance) OVER () - min(distance) OVER ()) AS b FROM v),
fn AS (SELECT doc_id, (n_chars - min(n_chars) OVER ()) / (max(n_chars) OVER () - min(n_chars) OVER ()) AS c FROM f)
SELECT doc_id, round(coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.3 + coalesce(c, 0) * 0.2, 6) AS score FROM tn FULL JOIN vn USING (doc_id) FULL JOIN fn USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""",
)
def hyb_multi_signal(spark, d):
    e = _vectors(spark, d)
    by_text = text.search(_docs(spark, d), QUERY, 50)
    by_vector = vector.knn(e.select("vec_id", "embedding"), vector.vector_of(e, 0), 50, "cosine").withColumnRenamed("vec_id", "doc_id")
    by_size = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return hybrid.combine([(by_text, "score", 0.5, False), (by_vector, "distance", 0.3, True), (by_size, "n_chars", 0.2, False)], "doc_id", 10)


@query(
    "hyb_graph_docs",
    f"""WITH RECURSIVE {_BOTH}, w AS (SELECT DISTINCT src, dst FROM both_ WHERE type IN ('IN_NATION', 'IN_REGION')),
walk(id, depth) AS (SELECT 'c1', 0 UNION SELECT dst, depth + 1 FROM walk JOIN w ON src = id WHERE depth < 2)
SELECT DISTINCT c_custkey, c_mktsegment FROM customer JOIN walk ON id = 'c' || c_custkey WHERE c_acctbal > 0""",
)
def hyb_graph_docs(spark, d):
    near = graph.traverse(_start(spark, "c1"), edges(spark, d), 2, "both", ["IN_NATION", "IN_REGION"]).select("id")
    docs = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    return docs.join(near, _id("c", "c_custkey") == F.col("id"), "left_semi")


@query(
    "emb_lifecycle_stale",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'version' ELSE 'text' END AS reason FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 11 = 0""",
)
def emb_lifecycle_stale(spark, d):
    docs = _docs(spark, d)
    seen = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" (older)"))).otherwise(F.col("text"))
    records = docs.filter("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 1).otherwise(2).alias("model_version"), F.sha2(seen, 256).alias("text_hash"))
    return embedding.stale(records, docs, 2)


@query("emb_provider")
def emb_provider(spark, d):
    return embedding.embed(_docs(spark, d), embedding.hashing_embedder(32), 1)


# ---------------------------------------------------------------- streams


@query("stm_log_replay", "SELECT user_id AS k, arg_max(value, event_id) AS v FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def stm_log_replay(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("value").alias("v"), F.col("event_id").alias("lsn"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("kind"))
    return replay.replay(log).select("k", "v")


@query("stm_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stm_tumbling(spark, d):
    out = replay.tumbling(table(spark, d, "events"), "6 hours", ["event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stm_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def stm_session(spark, d):
    out = replay.sessions(table(spark, d, "events"), "2 hours", "user_id")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
