"""Exact global ranks without a single-partition window.

Rank statistics (Gini, top-share concentration, cumulative capture, average
precision, ROC AUC, top-k recall) need, for every value, how many rows and
how much weight come before it in a global order. A ``Window`` without
``partitionBy`` would pull every row into one task, so instead:

1. rows collapse to one *block* per distinct (group, value) with its row
   count and weight sums (map-side partial aggregation absorbs hot values:
   a value held by a third of all rows is still one block);
2. blocks are dealt into value ranges (``repartitionByRange``, which takes any
   orderable type) and written with their range id to the checkpoint folder;
3. per-range totals (ranges x groups rows) get exclusive running sums with a
   window over the range ids and are joined back;
4. inside a range a window partitioned by (group, range) adds the local
   running sums.

The results are exact: the sampled range bounds only affect how balanced the
ranges are, never the offsets. There is one code path for every type and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelscope.session import staged


def ordered_blocks(df: DataFrame, value: str, weights: dict[str, Column] | None = None,
                   group: tuple[str, ...] | list[str] = (), descending: bool = False,
                   n_ranges: int | None = None) -> DataFrame:
    """One row per distinct (group, value) with:

    ``c`` rows in the block, ``<w>`` weight sums, ``o_c`` / ``o_<w>`` the
    rows / weight strictly before the block in the (per-group) order, and
    ``n_total`` / ``<w>_total`` the group totals. Null values are ignored.
    ``n_ranges`` defaults to the session's shuffle partitions. Runs a job.
    """
    weights = weights or {}
    group = list(group)
    src = df.filter(F.col(value).isNotNull())
    blocks = src.groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("c"), *[F.sum(e).alias(k) for k, e in weights.items()])
    # the range id is the partition's number, so the blocks are written once:
    # every later step reads the same ids, and the lineage ends there
    dealt = blocks.repartitionByRange(n_ranges, value) if n_ranges else blocks.repartitionByRange(value)
    blocks = staged(dealt.withColumn("_r", F.spark_partition_id()))

    meas = ["c", *weights.keys()]
    rt = blocks.groupBy(*group, "_r").agg(*[F.sum(m).alias(f"_rt_{m}") for m in meas])
    order = F.col("_r").desc() if descending else F.col("_r").asc()
    w_before = Window.partitionBy(*group).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*group)
    rt = rt.select(
        *group, "_r",
        *[F.coalesce(F.sum(f"_rt_{m}").over(w_before), F.lit(0)).alias(f"_base_{m}") for m in meas],
        *[F.sum(f"_rt_{m}").over(w_all).alias("n_total" if m == "c" else f"{m}_total")
          for m in meas])
    j = blocks.join(rt, [*group, "_r"])
    vorder = F.col(value).desc() if descending else F.col(value).asc()
    w_local = Window.partitionBy(*group, "_r").orderBy(vorder).rowsBetween(
        Window.unboundedPreceding, -1)
    return j.select(
        *group, value, *meas,
        *[(F.col(f"_base_{m}") + F.coalesce(F.sum(m).over(w_local), F.lit(0))).alias(f"o_{m}")
          for m in meas],
        "n_total", *[f"{m}_total" for m in weights.keys()])


def top_n_sums(df: DataFrame, score: str, tiebreak: str, n_tops: dict[str, Column],
               measures: dict[str, Column], n_ranges: int | None = None) -> DataFrame:
    """For every named cut k in ``n_tops``: the sums of ``measures`` over the
    rows ranked 1..k by (``score`` desc, ``tiebreak`` asc), exactly.

    Each cut is an expression of ``n_total`` (the row count), e.g.
    ``greatest(1, floor(n_total * 0.1))``. Whole score blocks are summed from
    block totals; only the boundary block of each cut (at most one per cut) is
    ranked row by row, through ``ordered_blocks`` on the unique tiebreak.
    Output: ``cut``, ``n_total``, ``n_top`` and one column per measure.
    """
    b = ordered_blocks(df, score, measures, (), descending=True, n_ranges=n_ranges)
    # one pass over the blocks, one conditional sum per cut and measure
    aggs = []
    for i, e in enumerate(n_tops.values()):
        k = e.cast("bigint")
        whole = F.col("o_c") + F.col("c") <= k
        across = (F.col("o_c") < k) & ~whole
        aggs += [F.max(k).alias(f"_k{i}"),
                 F.max(F.when(across, F.struct(F.col(score).alias("s"), (k - F.col("o_c")).alias("m")))).alias(f"_b{i}"),
                 *[F.sum(F.when(whole, F.col(m))).alias(f"_{m}{i}") for m in measures]]
    one = b.agg(F.max("n_total").cast("bigint").alias("n_total"), *aggs)
    cuts = one.select(F.inline(F.array(*[F.struct(
        F.lit(name).alias("cut"), F.col("n_total"), F.col(f"_k{i}").alias("n_top"),
        F.col(f"_b{i}").alias("_b"), *[F.col(f"_{m}{i}").alias(m) for m in measures])
        for i, name in enumerate(n_tops)]))).checkpoint(eager=True)
    # the block that a cut divides: one row per cut, a bounded broadcast
    edges = cuts.filter("_b is not null").select("cut", F.col("_b.s").alias("_bs"), F.col("_b.m").alias("_m"))
    rows = df.join(F.broadcast(edges), F.col(score) == F.col("_bs")) \
        .select("cut", "_m", tiebreak, *[e.alias(k) for k, e in measures.items()])
    rb = ordered_blocks(rows, tiebreak, {k: F.col(k) for k in measures}, ["cut", "_m"], n_ranges=n_ranges)
    part = rb.filter(F.col("o_c") < F.col("_m")).groupBy("cut").agg(
        *[F.sum(k).alias(f"_part_{k}") for k in measures])
    zero = {k: F.lit(0).cast(cuts.schema[k].dataType) for k in measures}
    return cuts.join(part, "cut", "left").select(
        "cut", "n_total", "n_top",
        *[(F.coalesce(F.col(k), zero[k]) + F.coalesce(F.col(f"_part_{k}"), zero[k])).alias(k) for k in measures])


def top_rows(df: DataFrame, score: str, tiebreak: str, n_top: Column,
             n_ranges: int | None = None) -> DataFrame:
    """The rows ranked 1..n_top by (score desc, tiebreak asc) - exact, with
    no global sort: rows of whole blocks pass a score threshold, the single
    boundary block is ranked on the unique tiebreak."""
    b = ordered_blocks(df, score, None, (), descending=True, n_ranges=n_ranges)
    b = b.withColumn("_k", n_top.cast("bigint"))
    full_min = b.filter(F.col("o_c") + F.col("c") <= F.col("_k")).agg(F.min(score)).scalar()
    bnd = b.filter((F.col("o_c") < F.col("_k")) & (F.col("o_c") + F.col("c") > F.col("_k")))
    bs = bnd.agg(F.first(score)).scalar()
    m = bnd.agg(F.first(F.col("_k") - F.col("o_c"))).scalar()
    whole = df.filter(F.col(score) >= full_min)
    tied = df.filter(F.col(score) == bs)
    first_m = ordered_blocks(tied, tiebreak, None, (), n_ranges=n_ranges) \
        .filter(F.col("o_c") < m).select(tiebreak)
    return whole.unionByName(tied.join(first_m, tiebreak, "left_semi"))
