"""The corpus pipeline: each stage reads what its predecessor wrote, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, exact, minmax, mixing, packing, quality
from sparkloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts."""
    return quality.accepted_documents(docs, common.read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact.keep_one(docs, keep="max").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the row with the least id stays."""
    return minmax.keep_one(docs, percent=75, width=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_documents(docs, share=1.5, cap=2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, as pieces of documents."""
    return packing.pack(docs, tokenizer_path(), length=2048, end_id=1)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        mark = common.written()
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{k}")
        common.release(mark, keep=docs)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
