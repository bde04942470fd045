"""Distribution and concentration measures: A24-A28, W4, W5, L2.

Everything rank-based goes through ``functions.ranking.ordered_blocks`` so no
step needs the whole column in one task: exact percentiles, Gini and top-share
concentration are read off value blocks with their global offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope import constants as K
from panelscope.functions.exprs import fround, money_mean
from panelscope.functions.ranking import ordered_blocks


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float],
                      group=(), digits: int | None = 6, blocks: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles (numpy's default) per group,
    rounded for reports; ``digits=None`` where values are compared with them.

    The value at 0-based rank r is the block with o_c <= r < o_c + c, so each
    percentile is two block look-ups and an interpolation - computed inside
    one grouped aggregation over the blocks, never a sorted column in memory.
    """
    group = list(group)
    b = blocks if blocks is not None else ordered_blocks(df, value, None, group)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("n_total") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        inside = lambda r: (F.col("o_c") <= r) & (r < F.col("o_c") + F.col("c"))
        aggs += [F.max(F.when(inside(lo), F.col(value))).alias(f"_lo_{name}"),
                 F.max(F.when(inside(hi), F.col(value))).alias(f"_hi_{name}"),
                 F.max(pos - lo).alias(f"_f_{name}")]
    g = b.groupBy(*group).agg(*aggs)
    out = []
    for name in probs:
        lo_v, hi_v, f = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_f_{name}")
        value_at = lo_v + (hi_v - lo_v) * f
        out.append((value_at if digits is None else F.round(value_at, digits)).alias(name))
    return g.select(*group, *out)


def gini(df: DataFrame, value: str, group=(), digits: int = 9,
         blocks: DataFrame | None = None) -> DataFrame:
    """Gini of the positive values, G = 2*sum(i*x)/(n*sum x) - (n+1)/n
    with i the ascending rank among positives. A tie block of c equal values
    after o smaller positives contributes x*(c*o + c(c+1)/2) to sum(i*x).

    ``blocks`` may be ascending blocks over ALL values (shared with the
    percentiles): offsets are then shifted by the non-positive rows, all in
    the same single aggregation."""
    group = list(group)
    b = blocks if blocks is not None else ordered_blocks(
        df.filter(F.col(value) > 0), value, None, group)
    x, c, o = F.col(value).cast("double"), F.col("c").cast("double"), F.col("o_c").cast("double")
    pos = F.col(value) > 0
    g = b.groupBy(*group).agg(
        F.sum(F.when(pos, x * c * o)).alias("_a"),
        F.sum(F.when(pos, x * (c * (c + 1) / 2))).alias("_b"),
        F.sum(F.when(pos, x * c)).alias("_s"),
        F.sum(F.when(pos, c)).alias("_n"),
        F.coalesce(F.sum(F.when(~pos, c)), F.lit(0.0)).alias("_n0"))
    s1 = F.col("_a") - F.col("_n0") * F.col("_s") + F.col("_b")
    gi = (F.lit(2.0) * s1) / (F.col("_n") * F.col("_s")) - (F.col("_n") + 1) / F.col("_n")
    return g.select(*group, F.round(gi, digits).alias("gini"))


def revenue_concentration(df: DataFrame, value: str, top_pcts=K.CONCENTRATION_TOP_SHARES,
                          group=()) -> DataFrame:
    """% of the total held by the top p share of rows,
    n_p = max(1, int(n*p)); null when the total is 0. A block of c equal
    values after o larger rows contributes x * clamp(n_p - o, 0, c).
    Money is summed as DECIMAL, so the shares are exact and bit-stable."""
    group = list(group)
    b = ordered_blocks(df, value, None, group, descending=True)
    x = F.col(value).cast("decimal(18,4)")
    aggs = [F.sum(x * F.col("c")).alias("_tot")]
    for i, p in enumerate(top_pcts):
        n_p = F.greatest(F.lit(1), F.floor(F.col("n_total").cast("double") * F.lit(float(p))))
        take = F.least(F.greatest(n_p - F.col("o_c"), F.lit(0)), F.col("c"))
        aggs.append(F.sum(x * take.cast("decimal(20,0)")).alias(f"_t{i}"))
    g = b.groupBy(*group).agg(*aggs)
    tot = F.col("_tot").cast("double")
    cols = [F.try_divide(F.col(f"_t{i}").cast("double") * F.lit(100.0), F.when(tot != 0, tot))
            .alias(f"top_{int(round(p * 100))}pct") for i, p in enumerate(top_pcts)]
    return g.select(*group, *cols)


def moments(df: DataFrame, value: str, group=()) -> DataFrame:
    """A24/A26 moment part: count, mean, std (ddof 1), min, max, population
    skewness and excess kurtosis, % zero, % below 100."""
    x = F.col(value)
    return df.filter(x.isNotNull()).groupBy(*group).agg(
        F.count(x).alias("count"),
        money_mean(x, fixed=False).alias("mean"),
        fround(F.stddev_samp(x)).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        fround(F.skewness(x)).alias("skewness"),
        fround(F.kurtosis(x)).alias("kurtosis"),
        (F.avg((x == 0).cast("int")) * F.lit(100.0)).alias("pct_zero"),
        (F.avg((x < 100).cast("int")) * F.lit(100.0)).alias("pct_lt100"),
    )


TARGET_PCTS = dict(zip(("p25", "p50", "p75", "p90", "p95", "p99", "p99_9"), K.TARGET_PERCENTILES))


def target_stats(df: DataFrame, value: str, group=(), materialize: bool = True) -> DataFrame:
    """Moments + 7 exact percentiles + mean/median ratio + Gini per group.

    The input feeds several jobs, so it is written once to the checkpoint
    folder; percentiles and Gini share one set of value blocks."""
    group = list(group)
    if materialize:
        from panelscope.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        df = df.select(*group, value).checkpoint(eager=True)
    m = moments(df, value, group)
    b = ordered_blocks(df, value, None, group)
    pc = exact_percentiles(df, value, TARGET_PCTS, group, blocks=b)
    gi = gini(df, value, group, blocks=b)
    out = m.join(pc, group, "left") if group else _attach(m, pc)
    out = out.join(gi, group, "left") if group else _attach(out, gi)
    ratio = F.when(F.col("p50") > 0, fround(F.col("mean") / F.col("p50")))
    return out.select("*", ratio.alias("mean_med_ratio"))


def _attach(a: DataFrame, b: DataFrame) -> DataFrame:
    """Add the columns of one-row ``b`` to one-row ``a`` (scalar subqueries)."""
    return a.select("*", *[b.agg(F.first(c)).scalar().alias(c) for c in b.columns])


def log_transform_check(df: DataFrame, value: str, group=()) -> DataFrame:
    """Skewness / kurtosis of raw, log1p and log-of-positive values,
    % zero and mean/median ratio."""
    x = F.col(value)
    lp = F.when(x > -1, F.log1p(x))
    ln = F.when(x > 0, F.log(x))
    agg = df.filter(x.isNotNull()).groupBy(*group).agg(
        fround(F.skewness(x)).alias("skew_raw"), fround(F.kurtosis(x)).alias("kurt_raw"),
        fround(F.skewness(lp)).alias("skew_log1p"), fround(F.kurtosis(lp)).alias("kurt_log1p"),
        fround(F.skewness(ln)).alias("skew_log_pos"), fround(F.kurtosis(ln)).alias("kurt_log_pos"),
        (F.avg((x == 0).cast("int")) * F.lit(100.0)).alias("pct_zero"),
        money_mean(x, fixed=False).alias("_mean"))
    med = exact_percentiles(df, value, {"_med": 0.5}, group)
    out = agg.join(med, list(group), "left") if group else _attach(agg, med)
    return out.select(*group, "skew_raw", "kurt_raw", "skew_log1p", "kurt_log1p",
                      "skew_log_pos", "kurt_log_pos", "pct_zero",
                      F.when(F.col("_med") > 0, fround(F.col("_mean") / F.col("_med")))
                      .alias("mean_med_ratio"))


def percentile_profile(df: DataFrame, value: str, group=()) -> DataFrame:
    """p90..p99.9 (rounded when reported) and max of the non-zero values, and
    the count / mean of values above the unrounded p99.9 (threshold joined back
    per group, bounded size)."""
    group = list(group)
    nz = df.filter(F.col(value).isNotNull() & (F.col(value) != 0))
    probs = {"p90": 0.90, "p95": 0.95, "p99": 0.99, "p99_5": 0.995, "p99_9": 0.999}
    pc = exact_percentiles(nz, value, probs, group, digits=None)
    reported = [F.round(p, 6).alias(p) for p in probs]
    mx = nz.groupBy(*group).agg(F.max(value).alias("max"))
    if group:
        th = pc.join(mx, group)
        above = nz.join(th.select(*group, "p99_9"), group)
        above = above.filter(F.col(value) > F.col("p99_9")).groupBy(*group).agg(
            F.count(F.lit(1)).alias("n_above_p99_9"), money_mean(value, fixed=False).alias("mean_above_p99_9"))
        out = th.join(above, group, "left").fillna(0, subset=["n_above_p99_9"])
        return out.select(*group, *reported, "max", "n_above_p99_9", "mean_above_p99_9")
    th = _attach(pc, mx)
    t = pc.agg(F.first("p99_9")).scalar()
    above = nz.filter(F.col(value) > t).agg(
        F.count(F.lit(1)).alias("n_above_p99_9"), money_mean(value, fixed=False).alias("mean_above_p99_9"))
    return _attach(th, above).select(*reported, "max", "n_above_p99_9", "mean_above_p99_9")


def histogram(df: DataFrame, value: str, bins: int, lo: Column | None = None,
              hi: Column | None = None) -> DataFrame:
    """L2: equal-width bin counts between min and max (last edge inclusive,
    numpy style). Bounds are scalar subqueries unless given."""
    x = F.col(value).cast("double")
    src = df.filter(x.isNotNull())
    lo = lo if lo is not None else src.agg(F.min(x)).scalar()
    hi = hi if hi is not None else src.agg(F.max(x)).scalar()
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor(F.try_divide(x - lo, width))
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)))
    return src.filter((x >= lo) & (x <= hi)).groupBy(b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def cumulative_capture(df: DataFrame, score: str, value: str, group=()) -> DataFrame:
    """By descending score, cumulative share of rows vs cumulative share
    of ``value`` (money, summed as DECIMAL) at every distinct score; tied rows
    enter together."""
    b = ordered_blocks(df, score, {"_v": F.col(value).cast("decimal(18,4)")}, list(group),
                       descending=True)
    tot = F.col("_v_total").cast("double")
    return b.select(
        *group, score,
        ((F.col("o_c") + F.col("c")).cast("double") / F.col("n_total").cast("double"))
        .alias("cum_pop_share"),
        F.try_divide((F.col("o__v") + F.col("_v")).cast("double"), F.when(tot != 0, tot))
        .alias("cum_value_share"))
