"""Second parts of reports: largest histories and registrations (T1, T2),
quantities (A41), differences of the targets (A46), log scales (L2, M17),
totals of numeric flags (A49)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.functions.exprs import pct
from panelscope.operators import distribution as D
from panelscope.operators import quality as Q
from panelscope.plans.oracle_views import pct as spct
from panelscope.plans.registry import Ctx, register

TEST = "DATE '2000-01-01'"


def _u(parts) -> str:
    return "\nUNION ALL\n".join(parts)


@register("top_history_rows", f"""
SELECT client_id, to_full_hist, nb_trs_full_hist, recency FROM panel WHERE date_target = {TEST}
ORDER BY to_full_hist DESC NULLS LAST, client_id LIMIT 10""", ("panel",))
def top_history_rows(c: Ctx):
    """The 10 clients with the largest history at the test snapshot."""
    rows = c.panel.filter(F.col("date_target") == F.lit(c.test_snapshot))
    return rows.select("client_id", "to_full_hist", "nb_trs_full_hist", "recency").orderBy(
        F.col("to_full_hist").desc_nulls_last(), "client_id").limit(10)


@register("top_registration_groups", """
SELECT client_id, count(*) AS n_registrations, count(DISTINCT article_id) AS n_articles FROM ccp
WHERE client_id IS NOT NULL GROUP BY client_id ORDER BY n_registrations DESC, client_id LIMIT 10""", ("ccp",))
def top_registration_groups(c: Ctx):
    """The 10 clients with most registrations."""
    g = c.ccp.filter(F.col("client_id").isNotNull()).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_registrations"), F.count_distinct("article_id").alias("n_articles"))
    return g.orderBy(F.col("n_registrations").desc(), "client_id").limit(10)


_QUANTITIES = (5, 10, 20)  # fixed values


@register("quantity_exceedance", _u(
    f"SELECT {q} AS threshold, count(*) FILTER (WHERE qty > {q}) AS n_above, "
    f"{spct(f'count(*) FILTER (WHERE qty > {q})', 'count(*)')} AS pct_above FROM trs"
    for q in _QUANTITIES), ("trs",))
def quantity_exceedance(c: Ctx):
    """Transactions above each quantity (one pass)."""
    row = c.trs.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(F.col("qty") > q).alias(f"_a{q}") for q in _QUANTITIES])
    return Q.rows_from(row, [[F.lit(q).alias("threshold"), F.col(f"_a{q}").alias("n_above"),
                              pct(f"_a{q}", "_n").alias("pct_above")] for q in _QUANTITIES])


_PAIRS = (("target_1m", "target_3m"), ("target_3m", "target_1y"))
_DIFFERENCES = {"p01": 0.01, "median": 0.5, "p99": 0.99}


@register("target_difference_profile", "WITH d AS (" + _u(
    f"SELECT '{a}_{b}' AS pair, CASE WHEN {a} > {b} THEN 'violated' WHEN {a} = {b} THEN 'equal' ELSE 'ordered' END "
    f"AS relation, {b} - {a} AS x FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS) + """)
SELECT pair, relation, count(*) AS n, min(x) AS min, max(x) AS max, """ + ", ".join(
    f"round(quantile_cont(x, {p}), 6) AS {n}" for n, p in _DIFFERENCES.items()) + """
FROM d GROUP BY pair, relation""", ("panel",))
def target_difference_profile(c: Ctx):
    """How far a longer horizon's target lies above the shorter one's, by
    pair and by whether their order holds (exact percentiles)."""
    structs = ", ".join(
        f"named_struct('pair', '{a}_{b}', 'relation', CASE WHEN {a} > {b} THEN 'violated' WHEN {a} = {b} "
        f"THEN 'equal' ELSE 'ordered' END, 'x', {b} - {a})" for a, b in _PAIRS)
    d = c.panel.selectExpr(f"inline(array({structs}))").filter("x IS NOT NULL")
    by = ["pair", "relation"]
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"))
    return sizes.join(D.exact_percentiles(d, "x", _DIFFERENCES, by), by)


_LOG_BINS = 40


@register("log_target_histogram", f"""
WITH pos AS (SELECT round(ln(1 + target_1y), 9) AS x FROM panel WHERE date_target = {TEST} AND target_1y > 0),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM pos)
SELECT CAST(CASE WHEN (b.hi - b.lo) / {_LOG_BINS}.0 = 0 THEN 0
            ELSE least(greatest(floor((pos.x - b.lo) / ((b.hi - b.lo) / {_LOG_BINS}.0)), 0), {_LOG_BINS - 1}) END
            AS INTEGER) AS bin, count(*) AS n
FROM pos, b GROUP BY 1""", ("panel",))
def log_target_histogram(c: Ctx):
    """L2: equal-width bins of log1p of the positive 1-year targets at the test snapshot."""
    pos = c.panel.filter((F.col("date_target") == F.lit(c.test_snapshot)) & (F.col("target_1y") > 0))
    return D.histogram(pos.select(F.round(F.log1p("target_1y"), 9).alias("x")), "x", _LOG_BINS)


@register("log_actual_vs_predicted", """
SELECT CAST(floor(round(ln(1 + actual), 9) * 2) AS INTEGER) AS actual_cell,
  CAST(floor(round(ln(1 + score), 9) * 2) AS INTEGER) AS predicted_cell, count(*) AS n,
  CAST(sum(CAST(actual AS DECIMAL(18,4))) AS DOUBLE) AS actual_total
FROM scored WHERE actual > 0 AND score > -1 GROUP BY 1, 2""", ("scored",))
def log_actual_vs_predicted(c: Ctx):
    """Log actual against log predicted spend of the test positives, as
    counts and money per cell of half a log unit (the scatter's bounded form)."""
    cell = lambda x: F.floor(F.round(F.log1p(x), 9) * F.lit(2)).cast("int")
    rows = c.scored.filter((F.col("actual") > 0) & (F.col("score") > -1))
    return rows.groupBy(cell("actual").alias("actual_cell"), cell("score").alias("predicted_cell")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("actual").cast("decimal(18,4)")).cast("double").alias("actual_total"))


_NUMERIC = {"trs": ("qty", "flag_he"), "articles": ("flag_he", "flag_bridal", "flag_diamond")}


@register("numeric_flag_totals", _u(
    f"SELECT '{t}' AS table_name, '{x}' AS column_name, count({x}) AS n_known, "
    f"CAST(sum({x}) AS BIGINT) AS total, CAST(sum({x}) AS DOUBLE) / NULLIF(CAST(count({x}) AS DOUBLE), 0) AS mean, "
    f"CAST(max({x}) AS BIGINT) AS max FROM {t}" for t, xs in _NUMERIC.items() for x in xs), tuple(_NUMERIC))
def numeric_flag_totals(c: Ctx):
    """Sum, mean and max of the numeric flags and counts, one pass a table."""
    out = None
    for t, xs in _NUMERIC.items():
        row = getattr(c, t).agg(*[F.expr(f"{f}({x}) AS {f}_{x}") for x in xs for f in ("count", "sum", "max")])
        part = Q.rows_from(row, [[
            F.lit(t).alias("table_name"), F.lit(x).alias("column_name"), F.col(f"count_{x}").alias("n_known"),
            F.col(f"sum_{x}").cast("bigint").alias("total"),
            F.try_divide(F.col(f"sum_{x}").cast("double"), F.col(f"count_{x}").cast("double")).alias("mean"),
            F.col(f"max_{x}").cast("bigint").alias("max")] for x in xs])
        out = part if out is None else out.unionByName(part)
    return out
