"""Distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.functions.exprs import fround
from panelscope.operators import distribution as D
from panelscope.plans.oracle_views import (mm, sql_gini, sql_kurt, sql_moments, sql_percentiles,
                                           sql_skew)
from panelscope.plans.registry import Ctx, register

TL = ("target", "date_target")


def targets_long(c: Ctx):
    """Panel targets unpivoted to (client_id, date_target, target, value)."""
    return c.panel.select("client_id", "date_target", F.expr(
        "stack(3, 'target_1m', target_1m, 'target_3m', target_3m, 'target_1y', target_1y)"
        " as (target, value)"))


_PC = ", ".join(f"p.{k}" for k in D.TARGET_PCTS)


@register("target_stats", f"""
WITH m AS ({sql_moments('targets_long', 'value', TL)}),
p AS ({sql_percentiles('targets_long', 'value', D.TARGET_PCTS, TL)}),
g AS ({sql_gini('targets_long', 'value', TL)})
SELECT m.*, {_PC}, g.gini,
  CASE WHEN p.p50 > 0 THEN round(m.mean / p.p50, 6) END AS mean_med_ratio
FROM m LEFT JOIN p ON m.target = p.target AND m.date_target = p.date_target
LEFT JOIN g ON m.target = g.target AND m.date_target = g.date_target""", ("targets_long",))
def target_stats(c: Ctx):
    """Per target x snapshot table"""
    return D.target_stats(targets_long(c), "value", TL)


@register("gini", sql_gini("targets_long", "value", TL), ("targets_long",))
def gini(c: Ctx):
    """Gini of positive targets per target x snapshot (tie blocks)."""
    return D.gini(targets_long(c), "value", TL)


@register("revenue_concentration", """
SELECT date_target,
""" + ",\n".join(
    f"  CAST(sum(CAST(target_1y AS DECIMAL(18,4))) FILTER (WHERE _rn <= greatest(1, "
    f"floor(CAST(_n AS DOUBLE) * {p}))) AS DOUBLE) * 100.0 / "
    f"NULLIF(CAST(sum(CAST(target_1y AS DECIMAL(18,4))) AS DOUBLE), 0) AS top_{k}pct"
    for p, k in ((0.01, 1), (0.05, 5), (0.1, 10), (0.2, 20))) + """
FROM (SELECT date_target, target_1y,
        row_number() OVER (PARTITION BY date_target ORDER BY target_1y DESC) AS _rn,
        count(*) OVER (PARTITION BY date_target) AS _n
      FROM panel WHERE target_1y IS NOT NULL) x
GROUP BY date_target""", ("panel",))
def revenue_concentration(c: Ctx):
    """Top 1/5/10/20% share of the 1-year target per snapshot."""
    return D.revenue_concentration(c.panel, "target_1y", group=["date_target"])


@register("log_transform_check", f"""
WITH s AS (SELECT * FROM targets_long WHERE date_target = DATE '2000-01-01'),
a AS (SELECT target, {sql_skew('value')} AS skew_raw, {sql_kurt('value')} AS kurt_raw,
        avg(CAST(value = 0 AS INTEGER)) * 100.0 AS pct_zero, {mm('value')} AS _mean
      FROM (SELECT *, value - avg(value) OVER (PARTITION BY target) AS _d FROM s
            WHERE value IS NOT NULL) q GROUP BY target),
b AS (SELECT target, {sql_skew('_l')} AS skew_log1p, {sql_kurt('_l')} AS kurt_log1p
      FROM (SELECT target, ln(1 + value) AS _l,
              ln(1 + value) - avg(ln(1 + value)) OVER (PARTITION BY target) AS _d
            FROM s WHERE value > -1) q GROUP BY target),
l AS (SELECT target, {sql_skew('_l')} AS skew_log_pos, {sql_kurt('_l')} AS kurt_log_pos
      FROM (SELECT target, ln(value) AS _l,
              ln(value) - avg(ln(value)) OVER (PARTITION BY target) AS _d
            FROM s WHERE value > 0) q GROUP BY target),
md AS (SELECT target, round(quantile_cont(value, 0.5), 6) AS _med FROM s
       WHERE value IS NOT NULL GROUP BY target)
SELECT a.target, a.skew_raw, a.kurt_raw, b.skew_log1p, b.kurt_log1p, l.skew_log_pos,
  l.kurt_log_pos, a.pct_zero, CASE WHEN md._med > 0 THEN round(a._mean / md._med, 6) END
  AS mean_med_ratio
FROM a LEFT JOIN b ON a.target = b.target LEFT JOIN l ON a.target = l.target
LEFT JOIN md ON a.target = md.target""", ("targets_long",))
def log_transform_check(c: Ctx):
    """A27 at the test snapshot, per target"""
    t = targets_long(c).filter(F.col("date_target") == F.lit(c.test_snapshot))
    return D.log_transform_check(t, "value", ["target"])


_PP = {"p90": 0.90, "p95": 0.95, "p99": 0.99, "p99_5": 0.995, "p99_9": 0.999}


@register("percentile_profile", f"""
WITH nz AS (SELECT * FROM panel WHERE to_full_hist IS NOT NULL AND to_full_hist <> 0),
p AS ({sql_percentiles('nz', 'to_full_hist', _PP, ('date_target',), None)}),
mx AS (SELECT date_target, max(to_full_hist) AS max FROM nz GROUP BY date_target),
ab AS (SELECT nz.date_target, count(*) AS n_above_p99_9, {mm('nz.to_full_hist')} AS mean_above_p99_9
       FROM nz JOIN p ON nz.date_target = p.date_target
       WHERE nz.to_full_hist > p.p99_9 GROUP BY nz.date_target)
SELECT p.date_target, {', '.join(f'round(p.{x}, 6) AS {x}' for x in _PP)}, mx.max, coalesce(ab.n_above_p99_9, 0) AS n_above_p99_9, ab.mean_above_p99_9
FROM p JOIN mx ON p.date_target = mx.date_target
LEFT JOIN ab ON p.date_target = ab.date_target""", ("panel",))
def percentile_profile(c: Ctx):
    """A25 on history spend per snapshot"""
    return D.percentile_profile(c.staged_panel, "to_full_hist", ["date_target"])


_DESC = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


@register("describe_numeric", f"""
WITH m AS (SELECT channel, count(spend) AS count, {mm('spend')} AS mean,
             round(stddev_samp(spend), 6) AS std, min(spend) AS min, max(spend) AS max
           FROM clean_trs WHERE spend IS NOT NULL GROUP BY channel),
p AS ({sql_percentiles('clean_trs', 'spend', _DESC, ('channel',))})
SELECT m.*, p.p25, p.p50, p.p75 FROM m JOIN p ON m.channel = p.channel""", ("clean_trs",))
def describe_numeric(c: Ctx):
    """count/mean/std/min/quartiles/max of spend per channel (exact)."""
    from panelscope.functions.exprs import money_mean
    x = F.col("spend")
    src = c.clean_trs.filter(x.isNotNull())
    m = src.groupBy("channel").agg(F.count(x).alias("count"), money_mean(x, fixed=False).alias("mean"),
                                   fround(F.stddev_samp(x)).alias("std"),
                                   F.min(x).alias("min"), F.max(x).alias("max"))
    p = D.exact_percentiles(src, "spend", _DESC, ["channel"])
    return m.join(p, "channel")


@register("histogram", """
WITH pos AS (SELECT target_1y AS x FROM panel
             WHERE date_target = DATE '2000-01-01' AND target_1y > 0),
cl AS (SELECT least(x, (SELECT quantile_cont(x, 0.99) FROM pos)) AS x FROM pos),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM cl)
SELECT CAST(CASE WHEN (b.hi - b.lo) / 20.0 = 0 THEN 0
            ELSE least(greatest(floor((cl.x - b.lo) / ((b.hi - b.lo) / 20.0)), 0), 19) END
            AS INTEGER) AS bin, count(*) AS n
FROM cl, b GROUP BY 1""", ("panel",))
def histogram(c: Ctx):
    """L2: 20 equal-width bins of the positive 1-year target at the test
    snapshot, clipped at its exact p99."""
    pos = c.panel.filter((F.col("date_target") == F.lit(c.test_snapshot))
                         & (F.col("target_1y") > 0)).select(F.col("target_1y").alias("x"))
    p99 = D.exact_percentiles(pos, "x", {"p99": 0.99}, digits=None).agg(F.first("p99")).scalar()
    cl = pos.select(F.least(F.col("x"), p99).alias("x"))
    return D.histogram(cl, "x", 20)


@register("cumulative_capture", """
WITH b AS (SELECT score, count(*) AS c, sum(CAST(actual AS DECIMAL(18,4))) AS v
           FROM scored WHERE score IS NOT NULL GROUP BY score)
SELECT score,
  CAST(sum(c) OVER (ORDER BY score DESC) AS DOUBLE) / CAST(sum(c) OVER () AS DOUBLE) AS cum_pop_share,
  CAST(sum(v) OVER (ORDER BY score DESC) AS DOUBLE) / NULLIF(CAST(sum(v) OVER () AS DOUBLE), 0)
    AS cum_value_share
FROM b""", ("scored",))
def cumulative_capture(c: Ctx):
    """Capture curve of the actual spend by descending score."""
    return D.cumulative_capture(c.scored, "score", "actual")
