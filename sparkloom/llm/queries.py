"""Queries over the training-data operators, at production parameters and over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed, exact, lm, minmax, mixing, packing, quality, substring, suffix, toxicity
from .common import read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(read(spark, sf_dir, "documents"), order=2, folds=10, fold=0)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(read(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embedding_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.7, folds=3, fold=1)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), length=2048, end_id=1)


def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(read(spark, sf_dir, "documents"), percent=75, width=5)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"), share=1.5, cap=2)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read(spark, sf_dir, "documents"), keep="max")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(read(spark, sf_dir, "documents"), width=400).drop("spans")


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_lm_scoring, op3_substring_dedup, op4_embedding_dedup, op5_toxicity, op6_packing, op7_minmax_dedup, op8_mixing, op9_exact_dedup, op10_suffix_dedup)
}

ORACLES = {
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS p, ws FROM w WHERE len(ws) >= 35),
keyed AS (SELECT doc_id, p, array_to_string(ws[p:p + 34], ' ') AS k FROM win),
dup AS (SELECT doc_id, p FROM keyed QUALIFY count(*) OVER (PARTITION BY k) > 1),
edge AS (SELECT doc_id, p, 1 AS d FROM dup UNION ALL SELECT doc_id, p + 35, -1 FROM dup),
steps AS (SELECT doc_id, p, sum(d) AS d FROM edge GROUP BY ALL),
marked AS (SELECT t.doc_id, t.word, t.p, coalesce(sum(s.d) OVER (PARTITION BY t.doc_id ORDER BY t.p), 0) > 0 AS gone
  FROM tok t LEFT JOIN steps s USING (doc_id, p)),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM marked)
SELECT d.doc_id, coalesce(count(r.p), 0)::BIGINT AS n_words, coalesce(count_if(r.gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(r.word, ' ' ORDER BY r.p) FILTER (NOT r.gone), '')) AS kept_sha256,
  coalesce(count_if(r.starts), 0)::BIGINT AS n_spans
FROM documents d LEFT JOIN runs r USING (doc_id) GROUP BY d.doc_id
""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.a = vec_id LEFT JOIN deg ON deg.a = vec_id
""",
    "op7_minmax_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON comp.a = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id
""",
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix|' || doc_id::VARCHAR) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
    source_size * 2.0::DOUBLE AS full_size, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s0),
s2 AS (SELECT *, full_size / weight AS ratio FROM s1),
s3 AS (SELECT *, (budget - coalesce(sum(full_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lvl
  FROM s2 WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cutoff AS (SELECT lvl FROM s3 WHERE lvl < ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
s4 AS (SELECT source, source_size, budget, CASE WHEN c.lvl IS NULL OR ratio <= c.lvl THEN full_size ELSE c.lvl * weight END AS target
  FROM s3 LEFT JOIN cutoff c ON true),
q AS (SELECT d.*, source_size, target, budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
c AS (SELECT q.*, k, ((upto + k * source_size)::DOUBLE / target) AS finish FROM q, (VALUES (0), (1)) v(k) WHERE size > 0),
spent AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, k, h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS spent FROM c),
n AS (SELECT source, doc_id, size, upto, count_if(spent <= budget) AS copies FROM spent GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, (q.size * coalesce(n.copies, 0))::BIGINT AS taken
FROM q LEFT JOIN n ON q.source IS NOT DISTINCT FROM n.source AND q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.size = n.size AND q.upto = n.upto
""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
}
