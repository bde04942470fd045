"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``docs``. Rows that repeat an id with
different texts are rows of their own in every stage, and so are rows with a
null id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.exact_dedup import without_copies
from panelscope.llm.layout import raw_key, unused
from panelscope.llm.near_dedup import near_groups
from panelscope.llm.packing import pack_documents
from panelscope.llm.suffix_dedup import rewritten
from panelscope.llm.toxicity import clean_rows

#: Least similarity of near-duplicates in the pipeline (op8_minhash has 85).
NEAR_THRESHOLD_PCT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, fitted on the labelled rows among ``docs``, doesn't reject."""
    return clean_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest id (and, of
    several texts of that id, one of them)."""
    kept = near_groups(docs, NEAR_THRESHOLD_PCT).filter("stays").select("doc_id", "raw_key").distinct()
    key, id_ = (unused(docs, n) for n in ("row_key", "kept_id"))
    kept = kept.select(F.col("doc_id").alias(id_), F.col("raw_key").alias(key))
    keyed = docs.withColumn(key, raw_key())
    return keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[id_]) & (keyed[key] == kept[key]), "left_semi").drop(key)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that repeat."""
    return rewritten(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, width, batch, slot of every row."""
    return pack_documents(docs)
