"""Sharding by a Feistel permutation of global row numbers (built-in functions only).

Rows get gapless global numbers; an unbalanced Feistel network permutes them;
numbers that land beyond the last row walk on along their cycle until they
land inside. The permuted number gives shard (its remainder) and slot (its
quotient), so shard sizes differ by one row at most, a seed reproduces the
shuffle, and a row's place is computable from its number alone.

Defined results: null texts have size 1 (no bytes, plus 1) and crc32 of the
empty text, 0; rows that share id, size and crc32 are copies, which take the
places of all of them; so results don't depend on how the rows lie, also where
an id (or null) has many texts. An empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.layout import cut, numbered

ROUNDS = 4
#: Steps along a cycle. A step stays outside with probability below
#: 2 / sqrt(rows), so that 64 steps are never used up; if they were, the
#: query fails instead of placing a row wrongly.
MAX_STEPS = 64
ROWS_PER_PART = 50_000


def feistel(x: Column, left: int, right: int, seed: int) -> Column:
    """A permutation of 0 .. left * right - 1."""
    def half(value: Column, other: Column, key: Column, modulus: int) -> Column:
        return (value + F.pmod(F.xxhash64(other, key), F.lit(modulus))) % F.lit(modulus)

    def one_round(state: Column, key: Column) -> Column:
        a = half(state["a"], state["b"], key, left)
        return F.struct(a.alias("a"), half(state["b"], a, key + F.lit(1), right).alias("b"))

    keys = F.array(*[F.lit(1_000_003 * seed + 2 * k).cast("long") for k in range(ROUNDS)])
    start = F.struct(F.floor(x / F.lit(right)).cast("long").alias("a"),
                     (x % F.lit(right)).cast("long").alias("b"))
    return F.aggregate(keys, start, one_round, lambda s: s["a"] * F.lit(right) + s["b"])


def permuted(x: Column, n_rows: int, seed: int) -> Column:
    """The place of row number ``x`` in a shuffle of ``n_rows`` rows."""
    left = max(1, math.isqrt(max(0, n_rows - 1)) + 1)
    right = max(1, -(-n_rows // left))
    limit = F.lit(n_rows).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_STEPS)), feistel(x, left, right, seed),
        lambda at, _: F.when(at < limit, at).otherwise(feistel(at, left, right, seed)))
    return F.when(walked < limit, walked).otherwise(
        F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def shard_rows(rows: DataFrame, key: list[str], n_shards: int, seed: int = 1,
               rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows`` (small columns only, written
    once to the checkpoint folder and read from there); ``key`` orders them,
    then all other columns."""
    rows = cut(rows)
    n = rows.count()
    parts = max(1, -(-n // rows_per_part))
    out = numbered(rows, [], key, parts, "row_number_")
    place = permuted(F.col("row_number_"), n, seed)
    return (out.withColumn("place_", place)
            .withColumn("shard", (F.col("place_") % F.lit(n_shards)).cast("int"))
            .withColumn("slot", F.floor(F.col("place_") / F.lit(n_shards)).cast("long"))
            .drop("place_", "row_number_"))


def shard_documents(documents: DataFrame, n_shards: int = 8, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(rows, ["doc_id"], n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
