"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.layout import id_remainder

HOLD_OUT_MODULUS = 3
HOLD_OUT_REMAINDER = 1
#: At most this many labelled rows are fitted on, chosen by a hash of the id.
MAX_FIT_ROWS = 6_000


def is_held_out():
    return id_remainder(F.col("doc_id"), HOLD_OUT_MODULUS) == F.lit(HOLD_OUT_REMAINDER)


def fit_sample(documents: DataFrame, labels: DataFrame, label: str,
               max_rows: int = MAX_FIT_ROWS) -> tuple[pa.Array, np.ndarray]:
    """Texts and 0/1 labels of at most ``max_rows`` rows that are not held out.
    An id with several labels takes their majority (1 on a tie)."""
    ids = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~is_held_out())
           .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # the sample's size is bounded, so it may be broadcast
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")) \
        .join(F.broadcast(ids), "doc_id") \
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_rows) \
        .select("text", "y").toArrow()
    return rows.column("text").combine_chunks(), rows.column("y").to_numpy().astype(np.float64)
