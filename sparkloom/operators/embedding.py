"""The life of embeddings: providers, batches, model versions, refresh."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def hashing_embedder(dims: int = 32, version: int = 1):
    """A deterministic provider without a model: signed feature hashing of words, unit length."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        import xxhash

        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w.encode(), seed=version)
                v[h % dims] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


def embed(docs: DataFrame, provider, version: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Embedding records with their lineage: equal texts are embedded once."""
    texts = docs.select(F.col(text_col).alias("_key")).distinct().withColumn("embedding", provider(F.col("_key")))
    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    return rows.join(texts, F.col("_text").eqNullSafe(F.col("_key"))).select(id_col, F.lit(text_col).alias("source_field"), F.lit(version).alias("model_version"), F.sha2(F.col("_text"), 256).alias("text_hash"), "embedding")


def refresh(records: DataFrame, docs: DataFrame, provider, version: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Records of all documents at a model version: sound ones stay, only the stale are embedded again, those of documents
    that are gone go."""
    again = stale(records, docs, version, id_col, F.col(text_col)).select(id_col)
    fresh = embed(docs.join(again, id_col, "left_semi"), provider, version, id_col, text_col)
    kept = records.join(docs.select(id_col), id_col, "left_semi").join(again, id_col, "left_anti")
    return kept.unionByName(fresh.select(*records.columns))


def stale(records: DataFrame, docs: DataFrame, version: int, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """Ids whose record is missing, of another model version, or of another text."""
    text = F.col("text") if text is None else text
    now = docs.select(id_col, F.sha2(text, 256).alias("_now"))
    both = now.join(records.select(id_col, "model_version", "text_hash"), id_col, "left")
    reason = F.when(F.col("model_version").isNull(), "missing").when(F.col("model_version") != version, "version").when(F.col("text_hash") != F.col("_now"), "text")
    return both.withColumn("reason", reason).filter("reason is not null").select(id_col, "reason")
