"""Metric, ranking and scan queries (SURVEY 2.12 M8-M13, M15-M17; 2.6 T1-T6;
2.5 W3; 2.1 S1, S4)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelscope.operators import distribution as D
from panelscope.operators import metrics as M
from panelscope.plans.registry import Ctx, register
from panelscope.sources.tables import SCHEMAS, table_row_counts

TEST = "DATE '2000-01-01'"

_B = """b AS (SELECT score, count(*) AS c, sum(label) AS tp FROM scored
         WHERE score IS NOT NULL GROUP BY score)"""


_AVERAGE_PRECISION_SQL = f"""
WITH {_B},
r AS (SELECT c, tp, sum(tp) OVER (ORDER BY score DESC) AS ctp,
        sum(c) OVER (ORDER BY score DESC) AS cc FROM b),
s AS (SELECT sum(CAST(tp AS DOUBLE) * CAST(ctp AS DOUBLE) / CAST(cc AS DOUBLE))
        / CAST((SELECT sum(tp) FROM b) AS DOUBLE) AS ap,
        CAST((SELECT sum(tp) FROM b) AS DOUBLE) / CAST((SELECT sum(c) FROM b) AS DOUBLE) AS prev
      FROM r)
SELECT round(ap, 9) AS average_precision, prev AS prevalence, round(ap / prev, 9) AS lift FROM s"""


@register("average_precision", _AVERAGE_PRECISION_SQL,
          ("scored",))
def average_precision(c: Ctx):
    """M8 on the stand-in scores of the test snapshot."""
    return M.average_precision(c.scored)


_ROC_AUC_SQL = f"""
WITH {_B},
r AS (SELECT c, tp, coalesce(sum(c) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS oc FROM b),
s AS (SELECT sum(CAST(tp AS DOUBLE) * (CAST(oc AS DOUBLE) + (CAST(c AS DOUBLE) + 1) / 2)) AS rs,
        CAST((SELECT sum(tp) FROM b) AS DOUBLE) AS p,
        CAST((SELECT sum(c) FROM b) AS DOUBLE) AS n FROM r)
SELECT round((rs - p * (p + 1) / 2) / (p * (n - p)), 9) AS roc_auc FROM s"""


@register("roc_auc", _ROC_AUC_SQL, ("scored",))
def roc_auc(c: Ctx):
    """M9"""
    return M.roc_auc(c.scored)


@register("recall_top_decile", """
WITH r AS (SELECT label, row_number() OVER (ORDER BY score DESC, client_id) AS rn,
             count(*) OVER () AS n FROM scored WHERE score IS NOT NULL)
SELECT max(n) AS n_total, max(greatest(1, CAST(floor(CAST(n AS DOUBLE) * 0.1) AS BIGINT))) AS n_top,
  CAST(sum(label) FILTER (WHERE rn <= greatest(1, floor(CAST(n AS DOUBLE) * 0.1))) AS BIGINT)
    AS n_positive_in_top,
  CAST(sum(label) AS BIGINT) AS n_positive,
  CAST(sum(label) FILTER (WHERE rn <= greatest(1, floor(CAST(n AS DOUBLE) * 0.1))) AS DOUBLE)
    / CAST(sum(label) AS DOUBLE) AS recall_top
FROM r""", ("scored",))
def recall_top_decile(c: Ctx):
    """M10 (ties broken by client id, D17)."""
    return M.recall_at_top(c.scored, 0.1)


_CUTS = ((0.01, 1), (0.02, 2), (0.05, 5), (0.1, 10), (0.2, 20), (0.3, 30))


@register("revenue_capture", """
WITH r AS (SELECT actual, row_number() OVER (ORDER BY score DESC, client_id) AS rn,
             count(*) OVER () AS n FROM scored WHERE score IS NOT NULL),
t AS (SELECT CAST(sum(CAST(actual AS DECIMAL(18,4))) AS DOUBLE) AS tot FROM scored)
""" + "\nUNION ALL\n".join(
    f"SELECT 'top_{k}pct' AS cut, CAST(greatest(1, floor(CAST(max(n) AS DOUBLE) * {p})) AS BIGINT)"
    f" AS n_top, CAST(sum(CAST(actual AS DECIMAL(18,4))) FILTER (WHERE rn <= greatest(1, "
    f"floor(CAST(n AS DOUBLE) * {p}))) AS DOUBLE) AS revenue, "
    f"CAST(sum(CAST(actual AS DECIMAL(18,4))) FILTER (WHERE rn <= greatest(1, "
    f"floor(CAST(n AS DOUBLE) * {p}))) AS DOUBLE) * 100.0 / NULLIF((SELECT tot FROM t), 0) "
    f"AS pct_of_total FROM r" for p, k in _CUTS), ("scored",))
def revenue_capture(c: Ctx):
    """Revenue captured by the top 1/2/5/10/20/30% by score."""
    return M.revenue_capture(c.scored, tuple(p for p, _ in _CUTS))


@register("pr_curve", f"""
WITH {_B}
SELECT score,
  CAST(sum(tp) OVER (ORDER BY score DESC) AS DOUBLE) / CAST(sum(c) OVER (ORDER BY score DESC) AS DOUBLE)
    AS precision,
  CAST(sum(tp) OVER (ORDER BY score DESC) AS DOUBLE) / NULLIF(CAST(sum(tp) OVER () AS DOUBLE), 0)
    AS recall
FROM b""", ("scored",))
def pr_curve(c: Ctx):
    """M16"""
    return M.pr_curve(c.scored)


_POS = "(SELECT * FROM scored WHERE actual > 0)"
_BASE = (f"(SELECT avg(ln(1 + target_1m)) FROM panel WHERE date_target < {TEST} "
         f"AND target_1m > 0)")


_REGRESSION_METRICS_SQL = f"""
WITH p AS (SELECT ln(1 + score) AS pl, ln(1 + actual) AS tl, score, actual FROM {_POS} q),
m AS (SELECT round(sqrt(avg((pl - tl) * (pl - tl))), 6) AS rmse_log,
        round(avg(abs(pl - tl)), 6) AS mae_log,
        round(sqrt(avg(({_BASE} - tl) * ({_BASE} - tl))), 6) AS baseline_rmse_log,
        round(sqrt(avg((score - actual) * (score - actual))), 6) AS rmse_eur,
        round(avg(abs(score - actual)), 6) AS mae_eur,
        round(quantile_cont(abs(score - actual), 0.5), 6) AS median_ae_eur,
        round(100.0 * (sqrt(avg(({_BASE} - tl) * ({_BASE} - tl))) - sqrt(avg((pl - tl) * (pl - tl))))
          / sqrt(avg(({_BASE} - tl) * ({_BASE} - tl))), 6) AS improvement_pct
      FROM p)
SELECT * FROM m"""


@register("regression_metrics", _REGRESSION_METRICS_SQL, ("scored", "panel"))
def regression_metrics(c: Ctx):
    """Log-space and money errors of the stand-in prediction on the
    test positives; baseline = mean log target of the train positives."""
    pos = c.scored.filter(F.col("actual") > 0).select(
        F.log1p("score").alias("pl"), F.log1p("actual").alias("tl"), "score", "actual")
    tr = c.panel.filter((F.col("date_target") < F.lit(c.test_snapshot)) & (F.col("target_1m") > 0))
    base = tr.agg(F.avg(F.log1p("target_1m"))).scalar()
    return M.regression_metrics(pos, "pl", "tl", "score", "actual", base)


_COMBINED_ERROR_SQL = f"""
SELECT count(*) AS n, round(avg(abs(score - actual)), 6) AS mae,
  round(quantile_cont(abs(score - actual), 0.5), 6) AS median_ae FROM {_POS} q"""


@register("combined_error", _COMBINED_ERROR_SQL, ("scored",))
def combined_error(c: Ctx):
    """M12 on the test positives."""
    return M.combined_error(c.scored.filter(F.col("actual") > 0), "score", "actual")


@register("prediction_error_distribution", f"""
WITH e AS (SELECT score - actual AS x FROM {_POS} q),
lim AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM e),
cl AS (SELECT least(greatest(x, (SELECT lo FROM lim)), (SELECT hi FROM lim)) AS x FROM e),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM cl)
SELECT CAST(CASE WHEN (b.hi - b.lo) / 20.0 = 0 THEN 0
            ELSE least(greatest(floor((cl.x - b.lo) / ((b.hi - b.lo) / 20.0)), 0), 19) END
            AS INTEGER) AS bin, count(*) AS n
FROM cl, b GROUP BY 1""", ("scored",))
def prediction_error_distribution(c: Ctx):
    """Histogram of prediction errors clipped at their p1 / p99."""
    e = c.scored.filter(F.col("actual") > 0).select((F.col("score") - F.col("actual")).alias("x"))
    lim = D.exact_percentiles(e, "x", {"lo": 0.01, "hi": 0.99}, digits=None)
    lo, hi = lim.agg(F.first("lo")).scalar(), lim.agg(F.first("hi")).scalar()
    cl = e.select(F.least(F.greatest(F.col("x"), lo), hi).alias("x"))
    return D.histogram(cl, "x", 20)


# ------------------------------------------------------------------ T1-T6, W3
_TOPK = f"""
SELECT printf('Client_%03d', rn) AS label, client_id, target_1y, to_full_hist, nb_trs_full_hist
FROM (SELECT *, row_number() OVER (ORDER BY target_1y DESC, client_id) AS rn
      FROM panel WHERE date_target = {TEST}) x WHERE rn <= 50"""


def _top50(c: Ctx):
    tp = c.panel.filter(F.col("date_target") == F.lit(c.test_snapshot))
    order = [F.col("target_1y").desc(), F.col("client_id").asc()]
    top = tp.orderBy(*order).limit(50)            # TakeOrderedAndProject: k rows per task
    rn = F.row_number().over(Window.orderBy(*order))   # over the 50 rows only
    return top.select(F.format_string("Client_%03d", rn).alias("label"), "client_id",
                      "target_1y", "to_full_hist", "nb_trs_full_hist")


@register("top_k_rows", _TOPK, ("panel",))
def top_k_rows(c: Ctx):
    """Top 50 clients by the 1-year target at the test snapshot."""
    return _top50(c)


@register("ordinal_label", _TOPK.replace(", target_1y, to_full_hist, nb_trs_full_hist\nFROM",
                                         "\nFROM", 1), ("panel",))
def ordinal_label(c: Ctx):
    """``Client_001``-style labels assigned after the top-k limit."""
    return _top50(c).select("label", "client_id")


@register("top_k_groups", """
SELECT client_id, count(*) AS n_contacts FROM crc WHERE client_id IS NOT NULL
GROUP BY client_id ORDER BY n_contacts DESC, client_id LIMIT 10""", ("crc",))
def top_k_groups(c: Ctx):
    """The 10 clients with most contacts."""
    g = c.crc.filter(F.col("client_id").isNotNull()).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_contacts"))
    return g.orderBy(F.col("n_contacts").desc(), "client_id").limit(10)


@register("head_per_group", """
SELECT date_target, client_id, to_full_hist FROM (
  SELECT *, row_number() OVER (PARTITION BY date_target ORDER BY client_id) AS rn FROM panel) x
WHERE rn <= 5""", ("panel",))
def head_per_group(c: Ctx):
    """T4: first 5 rows per snapshot in a deterministic order; the
    ``row_number() <= n`` filter is planned as a window group limit, so only
    n rows per group and task reach the shuffle."""
    w = Window.partitionBy("date_target").orderBy("client_id")
    return c.panel.select("date_target", "client_id", "to_full_hist",
                          F.row_number().over(w).alias("_rn")).filter(F.col("_rn") <= 5).drop("_rn")


@register("top_fraction", """
SELECT client_id, score, label FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, client_id) AS rn, count(*) OVER () AS n
  FROM scored WHERE score IS NOT NULL) x
WHERE rn <= greatest(1, floor(CAST(n AS DOUBLE) * 0.1))""", ("scored",))
def top_fraction(c: Ctx):
    """T5: the rows in the top 10% of scores (exact, no global sort)."""
    from panelscope.functions.ranking import top_rows
    k = F.greatest(F.lit(1), F.floor(F.col("n_total").cast("double") * F.lit(0.1)))
    return top_rows(c.scored, "score", "client_id", k).select("client_id", "score", "label")


SEED = 42


@register("seeded_sample", f"""
SELECT client_id, score FROM scored ORDER BY md5(client_id || ':{SEED}'), client_id LIMIT 100""", ("scored",))
def seeded_sample(c: Ctx):
    """100 clients, those of least md5 of id and seed: the same rows however
    they are partitioned (unlike ``sample``), and in any engine."""
    return c.scored.orderBy(M.sample_key("client_id", SEED), "client_id").limit(100).select("client_id", "score")


@register("seeded_sample_per_group", f"""
SELECT date_target, client_id FROM (SELECT date_target, client_id, row_number() OVER (
  PARTITION BY date_target ORDER BY md5(client_id || ':{SEED}'), client_id) AS rn FROM panel) x
WHERE rn <= 25""", ("panel",))
def seeded_sample_per_group(c: Ctx):
    """25 clients a snapshot; a window group limit keeps 25 rows a group
    and task before the shuffle."""
    w = Window.partitionBy("date_target").orderBy(M.sample_key("client_id", SEED), "client_id")
    return c.panel.select("date_target", "client_id", F.row_number().over(w).alias("_rn")) \
        .filter(F.col("_rn") <= 25).drop("_rn")


@register("scan_typed_tables", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}"
    for t in SCHEMAS))
def scan_typed_tables(c: Ctx):
    """Typed scans of every input table (schema enforced at read)."""
    return table_row_counts(c.spark, c.sf_dir)


@register("scan_head_sample")
def scan_head_sample(c: Ctx):
    """First rows for a look (limit is the feature). Rows-only check."""
    return c.t["lineitem"].limit(10)
