"""Splits, lineage cuts and gapless numbering shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelscope.session import ensure_checkpoint_dir

#: Copies of a row that are numbered as one block.
COPIES = 4096


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``. A null id counts
    as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, group: list[str], order: list[str], n_parts: int, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... without gaps inside each ``group``. All
    columns are small and orderable.

    Rows equal in all columns are counted, and the copies cut into blocks of
    at most ``COPIES``. Blocks are dealt into ``n_parts`` parts by a hash of
    all columns and the block's number, and ordered inside a part by ``order``,
    then by all columns; the parts' totals (a small table of ``n_parts`` rows a group) give their offsets. So
    neither a group nor a row that repeats meets in one task, and the result
    follows from the rows and ``n_parts`` alone, however the rows lie.
    """
    names = df.columns
    sort = [*order, *(c for c in names if c not in order)]
    n, block, held, part, before = (f"{out}_{x}" for x in ("n", "block", "held", "part", "before"))
    last = F.floor((F.col(n) - F.lit(1)) / F.lit(COPIES)).cast("long")
    blocks = (df.groupBy(*names).agg(F.count(F.lit(1)).alias(n))
              .withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), last)))
              .withColumn(held, F.least(F.lit(COPIES), F.col(n) - F.col(block) * F.lit(COPIES)))
              .withColumn(part, F.pmod(F.xxhash64(*sort, block), F.lit(n_parts)).cast("int")).drop(n))
    inside = Window.partitionBy(*group, part).orderBy(*sort, block).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*(group or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy(*group, part).agg(F.sum(held).alias("part_rows")).select(
        *[F.col(g).alias(f"{out}_{g}") for g in group], F.col(part).alias(f"{out}_p"),
        F.coalesce(F.sum("part_rows").over(ahead), F.lit(0)).alias(f"{out}_ahead"))
    same = F.col(part) == F.col(f"{out}_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{out}_{g}"))
    first = F.col(f"{out}_ahead") + F.coalesce(before, F.lit(0))
    return (blocks.withColumn(before, F.sum(held).over(inside)).join(offsets, same)
            .select(*names, F.explode(F.sequence(first, first + F.col(held) - F.lit(1))).alias(out)))


def raw_key() -> Column:
    """A hash of the text as it is; with the id it finds a row's text again."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where ``right`` was aggregated by them. Without more,
    Spark joins in the aggregate's own partitions, whose large keys it can't
    split; with the keys' hash as one key more it deals both sides out anew and can."""
    added, name = F.xxhash64(*keys), unused(left, "dealt_")
    return left.withColumn(name, added).join(
        right.withColumn(name, added), [name, *keys], how).drop(name)
