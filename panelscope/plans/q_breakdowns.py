"""Breakdowns behind the audit reports: negative values (A29), zero prices (A30),
categories of mismatched ids (A32), rows per client (A37), prices (A44), outlier
classes (A45), excluded features (A56), the whole quality summary (A57), the whole
decision catalogue (A58), orphans (J6), all id sets (J7), added columns (V7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.functions.exprs import count_where, pct
from panelscope.operators import distribution as D
from panelscope.operators import quality as Q
from panelscope.operators.features import PANEL_EXCLUDE, TARGETS
from panelscope.plans.oracle_views import pct as spct
from panelscope.plans.q_audits import _refmatrix_sql, _SETS, _staged_test_panel
from panelscope.plans.registry import Ctx, register
from panelscope.plans.q_cleaning import _CLEAN_VIEW, _pairs
from panelscope.plans.q_selection import FEATURES, _profile, _profile_sql
from panelscope.sources.views import PANEL_COLUMNS, SERIAL_PLACEHOLDER

TEST = "DATE '2000-01-01'"


def _u(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _test_panel(c: Ctx) -> DataFrame:
    return c.panel.filter(F.col("date_target") == F.lit(c.test_snapshot))


def _long(df: DataFrame, dims: dict[str, str], keep: list[str]) -> DataFrame:
    """Each row once per (dimension, value), with the columns of ``keep``."""
    kept = "".join(f", '{x}', {x}" for x in keep)
    structs = ", ".join(f"named_struct('dimension', '{d}', 'value', CAST({x} AS STRING){kept})"
                        for d, x in dims.items())
    return df.selectExpr(f"inline(array({structs}))")


def _long_sql(source: str, dims: dict[str, str], keep: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({x} AS VARCHAR) AS value, {', '.join(keep)} FROM {source}"
        for d, x in dims.items())


def _percentile_sql(x: str, probs: dict) -> str:
    return ", ".join(f"round(quantile_cont({x}, {p}), 6) AS {n}" for n, p in probs.items())


_EVENT_DIMS = {"all": "'all'", "trs_categ": "trs_categ", "channel": "channel", "categ": "categ"}
_QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


# ------------------------------------------------------------------ A29 / A30
@register("negative_value_profile", f"""
WITH l AS ({_long_sql("(SELECT * FROM trs WHERE spend < 0) x", _EVENT_DIMS, ["spend", "client_id"])})
SELECT dimension, value, count(*) AS n, count(DISTINCT client_id) AS n_clients,
  min(spend) AS min, {_percentile_sql("spend", _QUARTILES)}, max(spend) AS max
FROM l GROUP BY dimension, value""", ("trs",))
def negative_value_profile(c: Ctx):
    """Count, clients and exact quartiles of the negative amounts, over all
    and by transaction category, channel and product category."""
    d = _long(c.trs.filter("spend < 0"), _EVENT_DIMS, ["spend", "client_id"])
    by = ["dimension", "value"]
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("client_id").alias("n_clients"),
                           F.min("spend").alias("min"), F.max("spend").alias("max"))
    return g.join(D.exact_percentiles(d, "spend", _QUARTILES, by), by)


_ZERO_DIMS = {"all": "'all'", "channel": "channel", "categ": "categ", "year": "year(trs_date)"}
_ZERO_CLASS = ("CASE WHEN spend > 0 AND trs_categ = 'Repair' THEN 'LEGIT: service fee' "
               "WHEN spend > 0 THEN 'UNCERTAIN: sale without catalog price' "
               "WHEN spend = 0 THEN 'free' WHEN spend < 0 THEN 'refund' ELSE 'unknown' END")
_ZERO_PCTS = {"median": 0.5, "p99": 0.99}


@register("zero_price_classes", f"""
WITH z AS (SELECT *, {_ZERO_CLASS} AS price_class FROM trs WHERE wwprice = 0),
l AS ({_long_sql("z", _ZERO_DIMS, ["price_class", "spend"])})
SELECT price_class, dimension, value, count(*) AS n,
  {spct("count(*)", "(SELECT count(*) FROM trs)")} AS pct_of_rows, min(spend) AS min,
  {_percentile_sql("spend", _ZERO_PCTS)}, max(spend) AS max
FROM l GROUP BY price_class, dimension, value""", ("trs",))
def zero_price_classes(c: Ctx):
    """Rows without a catalog price by the class of what was paid (repair
    fees, sales, free, refunds), each by channel, product category and year,
    with the distribution of the amounts."""
    z = c.trs.filter("wwprice = 0").withColumn("price_class", F.expr(_ZERO_CLASS))
    d = _long(z, _ZERO_DIMS, ["price_class", "spend"])
    by = ["price_class", "dimension", "value"]
    total = c.trs.agg(F.count(F.lit(1))).scalar()
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("spend").alias("min"), F.max("spend").alias("max"))
    p = D.exact_percentiles(d.filter("spend IS NOT NULL"), "spend", _ZERO_PCTS, by)
    return g.join(p, by, "left").withColumn("pct_of_rows", pct("n", total))


# ------------------------------------------------------------------ A32 / A37
_ABSENT_SQL = ("SELECT article_id, product_category, flag_he, flag_bridal FROM articles "
               "WHERE product_category NOT IN (SELECT DISTINCT categ FROM trs)")


@register("category_mismatch_events", f"""
WITH a AS ({_ABSENT_SQL})
SELECT a.product_category, t.categ AS event_categ, count(t.article_id) AS n_rows,
  count(DISTINCT t.article_id) AS n_event_ids, count(DISTINCT a.article_id) AS n_articles,
  count(DISTINCT CASE WHEN a.flag_he = 1 THEN a.article_id END) AS n_flag_he,
  count(DISTINCT CASE WHEN a.flag_bridal = 1 THEN a.article_id END) AS n_flag_bridal
FROM a LEFT JOIN trs t ON a.article_id = t.article_id
GROUP BY a.product_category, t.categ""", ("articles", "trs"))
def category_mismatch_events(c: Ctx):
    """Which category the events give to articles whose own category never
    occurs in them (null: ids without events), and those articles' flags. Events
    are counted per article and category before they meet the articles."""
    seen = c.trs.select(F.col("categ").alias("product_category")).distinct()
    a = c.articles.join(seen, "product_category", "left_anti").select(
        "article_id", "product_category", "flag_he", "flag_bridal")
    ev = c.trs.filter("article_id IS NOT NULL").groupBy("article_id", F.col("categ").alias("event_categ")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    j = a.join(ev, "article_id", "left")
    return j.groupBy("product_category", "event_categ").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count_distinct(F.when(F.col("_n").isNotNull(), F.col("article_id"))).alias("n_event_ids"),
        F.count_distinct("article_id").alias("n_articles"),
        F.count_distinct(F.when(F.col("flag_he") == 1, F.col("article_id"))).alias("n_flag_he"),
        F.count_distinct(F.when(F.col("flag_bridal") == 1, F.col("article_id"))).alias("n_flag_bridal"))


@register("rows_per_client_distribution", f"""
WITH pc AS (SELECT client_id, count(*) AS n_rows, count(DISTINCT date_target) AS n_snapshots
            FROM panel GROUP BY client_id)
SELECT n_rows, n_snapshots, count(*) AS n_clients,
  {spct("count(*)", "(SELECT count(*) FROM pc)")} AS pct_clients
FROM pc GROUP BY n_rows, n_snapshots""", ("panel",))
def rows_per_client_distribution(c: Ctx):
    """How many clients have how many rows over how many snapshots (a table
    bounded by the number of snapshots, so its total is taken from one list)."""
    pc = c.panel.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.count_distinct("date_target").alias("n_snapshots"))
    g = pc.groupBy("n_rows", "n_snapshots").agg(F.count(F.lit(1)).alias("n_clients"))
    one = g.agg(F.collect_list(F.struct("n_rows", "n_snapshots", "n_clients")).alias("cells"),
                F.sum("n_clients").alias("total"))
    return one.select(F.inline("cells"), "total").select(
        "n_rows", "n_snapshots", "n_clients", pct("n_clients", "total").alias("pct_clients"))


# ------------------------------------------------------------------ A44
_PRICE_PCTS = {"median": 0.5, "p99": 0.99, "p999": 0.999}
_PRICE_DIMS = {"all": "'all'", "channel": "channel", "categ": "categ"}
_BANDS = {"over_100k": "world_price > 100000", "under_1": "world_price < 1", "priced": "world_price >= 1"}


@register("event_price_profile", f"""
WITH l AS ({_long_sql("(SELECT * FROM trs WHERE wwprice > 0) x", _PRICE_DIMS, ["wwprice"])})
SELECT dimension, value, count(*) AS n, {_percentile_sql("wwprice", _PRICE_PCTS)}, max(wwprice) AS max
FROM l GROUP BY dimension, value""", ("trs",))
def event_price_profile(c: Ctx):
    """Exact upper percentiles of the non-zero event prices, over all and by
    channel and product category."""
    d = _long(c.trs.filter("wwprice > 0"), _PRICE_DIMS, ["wwprice"])
    by = ["dimension", "value"]
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("wwprice").alias("max"))
    return g.join(D.exact_percentiles(d, "wwprice", _PRICE_PCTS, by), by)


def _bands() -> list[tuple[str, str]]:
    return [("'all'", "true"), *[(f"'{b}'", f"coalesce({p}, false)") for b, p in _BANDS.items()]]


@register("article_price_profile", "WITH l AS (" + _u(
    f"SELECT {b} AS band, product_category, world_price, flag_he, flag_bridal, flag_diamond FROM articles WHERE {p}"
    for b, p in _bands()) + f""")
SELECT band, product_category, count(*) AS n, min(world_price) AS min, {_percentile_sql("world_price", _PRICE_PCTS)},
  max(world_price) AS max, CAST(sum(flag_he) AS BIGINT) AS n_flag_he, CAST(sum(flag_bridal) AS BIGINT) AS n_flag_bridal,
  CAST(sum(flag_diamond) AS BIGINT) AS n_flag_diamond
FROM l GROUP BY band, product_category""", ("articles",))
def article_price_profile(c: Ctx):
    """Catalog prices per band (all, over 100,000, under 1, priced) and
    category: exact percentiles and how many carry each flag."""
    bands = ", ".join(f"CASE WHEN {p} THEN {b} END" for b, p in _bands())
    d = c.articles.withColumn("band", F.expr(f"explode(array_compact(array({bands})))"))
    by = ["band", "product_category"]
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("world_price").alias("min"), F.max("world_price").alias("max"),
        *[F.sum(f).cast("bigint").alias(f"n_{f}") for f in ("flag_he", "flag_bridal", "flag_diamond")])
    p = D.exact_percentiles(d.filter("world_price IS NOT NULL"), "world_price", _PRICE_PCTS, by)
    return g.join(p, by, "left")


# ------------------------------------------------------------------ A45
_GAP_SQL = "CAST(date_diff('day', creation_date, sale_date) AS INTEGER)"
# Fixed rule catalogue: (rule, SQL predicate, rows it is a share of, column, class, cause).
# {t} and {h}: p99.9 of the positive targets and of the histories, unrounded.
_OUTLIERS = {
    "panel": [("extreme_target", "target_1y > {t}", "true", "target_1y", "LEGIT", "most valuable clients"),
              ("target_order", "target_3m > target_1y", "target_3m IS NOT NULL AND target_1y IS NOT NULL",
               "target_3m", "ERROR", "targets built inconsistently"),
              ("extreme_history", "to_full_hist > {h}", "true", "to_full_hist", "LEGIT", "long-standing clients"),
              ("zero_history_positive_target", "to_full_hist = 0 AND target_1y > 0", "true", "to_full_hist",
               "UNCERTAIN", "new clients, or purchases before the data begin")],
    "trs": [("quantity_over_10", "qty > 10", "true", "qty", "UNCERTAIN", "bulk purchase or entry error"),
            ("repair_without_price", "wwprice = 0 AND spend > 0 AND trs_categ = 'Repair'", "true", "wwprice", "LEGIT",
             "service fee"),
            ("sale_without_price", "wwprice = 0 AND spend > 0 AND trs_categ = 'Sale'", "true", "wwprice", "UNCERTAIN",
             "article not in the catalog")],
    "articles": [("price_over_100k", "world_price > 100000", "true", "world_price", "LEGIT", "unique pieces"),
                 ("price_under_1", "world_price < 1", "true", "world_price", "UNCERTAIN", "accessory or catalog error")],
    "clients": [("implausible_birth", "year(birth_date) < 1900 OR birth_date > DATE '1992-01-01'", "true", "birth_date",
                 "ERROR", "placeholder or under age")],
    "crc": [("duration_over_480", "appointment_duration > 480", "true", "appointment_duration", "ERROR", "entry error")],
    "ccp": [("sale_after_creation", "gap > 0", "true", "sale_date", "ERROR", "dates in the wrong order")],
}


def _outliers_sql() -> str:
    source = {"panel": f"(SELECT * FROM panel WHERE date_target = {TEST})",
              "ccp": f"(SELECT *, {_GAP_SQL} AS gap FROM ccp)"}
    t = f"(SELECT quantile_cont(target_1y, 0.999) FROM panel WHERE date_target = {TEST} AND target_1y > 0)"
    h = f"(SELECT quantile_cont(to_full_hist, 0.999) FROM panel WHERE date_target = {TEST})"
    parts = []
    for table, rules in _OUTLIERS.items():
        for name, problem, base, column, kind, cause in rules:
            n = f"count(*) FILTER (WHERE {problem.format(t=t, h=h)})"
            parts.append(
                f"SELECT '{table}' AS dataset, '{name}' AS rule, '{column}' AS column_name, {n} AS n, "
                f"{spct(n, f'count(*) FILTER (WHERE {base})')} AS pct, "
                f"CASE WHEN '{kind}' = 'ERROR' AND {n} = 0 THEN 'OK' ELSE '{kind}' END AS outlier_class, "
                f"'{cause}' AS cause FROM {source.get(table, table)} _s")
    return _u(parts)


def _outliers(c: Ctx) -> DataFrame:
    t = _staged_test_panel(c)
    at = {"t": D.exact_percentiles(t.filter("target_1y > 0"), "target_1y", {"p": 0.999}, digits=None),
          "h": D.exact_percentiles(t, "to_full_hist", {"p": 0.999}, digits=None)}
    frames = {"panel": t, "trs": c.trs, "articles": c.articles, "clients": c.clients, "crc": c.crc,
              "ccp": c.ccp.withColumn("gap", F.datediff("sale_date", "creation_date"))}
    limit = {k: p.agg(F.first("p")).scalar() for k, p in at.items()}
    frames["panel"] = t.select("*", limit["t"].alias("_t"), limit["h"].alias("_h"))
    parts = []
    for table, rules in _OUTLIERS.items():
        row = frames[table].agg(
            *[count_where(F.expr(r[1].format(t="_t", h="_h"))).alias(f"n{i}") for i, r in enumerate(rules)],
            *[count_where(F.expr(r[2])).alias(f"b{i}") for i, r in enumerate(rules)])
        parts.append(Q.rows_from(row, [[
            F.lit(table).alias("dataset"), F.lit(name).alias("rule"), F.lit(column).alias("column_name"),
            F.col(f"n{i}").alias("n"), pct(f"n{i}", f"b{i}").alias("pct"),
            F.when((F.lit(kind) == "ERROR") & (F.col(f"n{i}") == 0), "OK").otherwise(F.lit(kind)).alias("outlier_class"),
            F.lit(cause).alias("cause")] for i, (name, _, _, column, kind, cause) in enumerate(rules)]))
    return reduce(DataFrame.unionByName, parts)


@register("outlier_rules", _outliers_sql(), tuple(_OUTLIERS))
def outlier_rules(c: Ctx):
    """The outlier catalogue over all six tables, one pass a table; the
    percentile limits are exact and unrounded; errors that never occur are OK."""
    return _outliers(c)


@register("outlier_class_counts", f"""
SELECT outlier_class, count(*) AS n_rules, CAST(sum(n) AS BIGINT) AS n_rows
FROM ({_outliers_sql()}) r GROUP BY outlier_class""", tuple(_OUTLIERS))
def outlier_class_counts(c: Ctx):
    """Rules and rows per class."""
    return _outliers(c).groupBy("outlier_class").agg(
        F.count(F.lit(1)).alias("n_rules"), F.sum("n").cast("bigint").alias("n_rows"))


# ------------------------------------------------------------------ A56
_LISTS = [x for x in PANEL_COLUMNS if x.startswith("all_")]
_REASONS = {x: "list kept as text" for x in _LISTS} | {
    x: "target" if x in TARGETS else "structurally missing" for x in PANEL_EXCLUDE}


@register("excluded_features", _u(
    f"SELECT '{x}' AS column_name, '{r}' AS reason, {spct(f'count({x})', 'count(*)')} AS pct_known FROM panel"
    for x, r in _REASONS.items()) + f"""
UNION ALL
SELECT feature, 'near-zero variance', (CAST(1.0 AS DOUBLE) - pct_missing) * 100.0
FROM ({_profile_sql()}) p WHERE pct_zero > 0.99""", ("panel", "master"))
def excluded_features(c: Ctx):
    """Columns that are no features, with the reason: lists kept as text,
    targets, structurally missing measures, and features that are nearly always zero."""
    row = c.panel.agg(F.count(F.lit(1)).alias("_n"), *[F.count(x).alias(x) for x in _REASONS])
    fixed = Q.rows_from(row, [[F.lit(x).alias("column_name"), F.lit(r).alias("reason"),
                               pct(x, "_n").alias("pct_known")] for x, r in _REASONS.items()])
    flat = _profile(c).filter("pct_zero > 0.99").select(
        F.col("feature").alias("column_name"), F.lit("near-zero variance").alias("reason"),
        ((F.lit(1.0) - F.col("pct_missing")) * F.lit(100.0)).alias("pct_known"))
    return fixed.unionByName(flat)


# ------------------------------------------------------------------ A57
# (dataset, check, aggregate over its rows); both engines read the same text.
# {test}: the test snapshot. Share checks are in percent.
_SHARE = "100D * count_if({0}) / nullif(count(*), 0)"
_SUMMARY = {
    "trs": [("n_rows", "count(*)"),
            ("n_after_last_snapshot", "count_if(trs_date > {test})"),
            ("pct_after_last_snapshot", _SHARE.format("trs_date > {test}")),
            ("n_serial_null", "count_if(serial_number IS NULL)"),
            ("pct_serial_null", _SHARE.format("serial_number IS NULL")),
            ("n_serial_placeholder", f"count_if(serial_number = '{SERIAL_PLACEHOLDER}')"),
            ("n_spend_null", "count_if(spend IS NULL)"),
            ("n_spend_negative", "count_if(spend < 0)"),
            ("pct_spend_negative", _SHARE.format("spend < 0")),
            ("n_price_zero", "count_if(wwprice = 0)")],
    "crc": [("n_rows", "count(*)"), ("n_clients", "count(DISTINCT client_id)"),
            ("n_duration_over_480", "count_if(appointment_duration > 480)"),
            ("pct_duration_null", _SHARE.format("appointment_duration IS NULL"))],
    "ccp": [("n_rows", "count(*)"), ("n_clients", "count(DISTINCT client_id)"),
            ("n_sale_after_creation", "count_if(sale_date > creation_date)"),
            ("pct_sale_null", _SHARE.format("sale_date IS NULL"))],
}
_DATES = {"trs": "trs_date", "crc": "creation_date", "ccp": "creation_date"}


def _summary_sql() -> str:
    parts = []
    for t, checks in _SUMMARY.items():
        for name, x in checks:
            x = x.format(test=TEST).replace("100D", "CAST(100 AS DOUBLE)")
            parts.append(f"SELECT '{t}' AS dataset, '{name}' AS check_name, CAST({x} AS DOUBLE) AS value, "
                         f"CAST(NULL AS VARCHAR) AS detail FROM {t}")
        d = f"CAST({_DATES[t]} AS DATE)"
        parts.append(f"SELECT '{t}', 'date_range', CAST(date_diff('day', min({d}), max({d})) AS DOUBLE), "
                     f"CAST(min({d}) AS VARCHAR) || ' to ' || CAST(max({d}) AS VARCHAR) FROM {t}")
    for t in ("crc", "ccp"):
        n = f"count(*) FILTER (WHERE client_id IN (SELECT client_id FROM {t} WHERE client_id IS NOT NULL))"
        parts += [f"SELECT '{t}', 'n_clients_in_snapshot', CAST({n} AS DOUBLE), NULL FROM test_ids",
                  f"SELECT '{t}', 'pct_clients_in_snapshot', {spct(n, 'count(*)')}, NULL FROM test_ids"]
    absent = "SELECT * FROM articles WHERE product_category NOT IN (SELECT DISTINCT categ FROM trs)"
    parts += [f"SELECT 'articles', 'n_categories_absent', CAST(count(DISTINCT product_category) AS DOUBLE), "
              f"coalesce(string_agg(DISTINCT product_category, ', ' ORDER BY product_category), '') FROM ({absent}) a",
              f"SELECT 'articles', 'n_articles_absent', CAST(count(*) AS DOUBLE), NULL FROM ({absent}) a"]
    return (f"WITH test_ids AS (SELECT DISTINCT client_id FROM panel WHERE date_target = {TEST} "
            f"AND client_id IS NOT NULL)\n" + _u(parts))


@register("quality_summary_full", _summary_sql(), ("trs", "crc", "ccp", "articles", "panel"))
def quality_summary_full(c: Ctx):
    """The whole quality summary (dataset, check, value, detail): one pass for
    all checks of a table, one for the clients of the test snapshot, one for the
    articles of categories that never occur (at most a few category names)."""
    none = F.lit(None).cast("string")

    def line(t, name, value, detail=none):
        return [F.lit(t).alias("dataset"), F.lit(name).alias("check_name"), value.cast("double").alias("value"),
                detail.cast("string").alias("detail")]

    parts = []
    for t, checks in _SUMMARY.items():
        d = F.col(_DATES[t]).cast("date")
        row = getattr(c, t).agg(*[F.expr(x.format(test=TEST)).alias(n) for n, x in checks],
                                F.min(d).alias("_lo"), F.max(d).alias("_hi"))
        parts.append(Q.rows_from(row, [line(t, n, F.col(n)) for n, _ in checks] + [
            line(t, "date_range", F.datediff("_hi", "_lo"), F.concat_ws(" to ", F.col("_lo").cast("string"),
                                                                       F.col("_hi").cast("string")))]))
    ids = _test_panel(c).filter("client_id IS NOT NULL").select("client_id").distinct()
    for t in ("crc", "ccp"):
        ids = ids.join(getattr(c, t).select("client_id").filter("client_id IS NOT NULL").distinct()
                       .withColumn(f"_{t}", F.lit(1)), "client_id", "left")
    row = ids.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f"_{t}").alias(t) for t in ("crc", "ccp")])
    parts.append(Q.rows_from(row, [x for t in ("crc", "ccp") for x in (
        line(t, "n_clients_in_snapshot", F.col(t)), line(t, "pct_clients_in_snapshot", pct(t, "_n")))]))
    seen = c.trs.select(F.col("categ").alias("product_category")).distinct()
    per = c.articles.groupBy("product_category").agg(F.count(F.lit(1)).alias("_n")) \
        .filter("product_category IS NOT NULL").join(seen, "product_category", "left_anti")
    row = per.agg(F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_n"),
                  F.array_join(F.array_sort(F.collect_list("product_category")), ", ").alias("_names"))
    parts.append(Q.rows_from(row, [line("articles", "n_categories_absent", F.col("_k"), F.col("_names")),
                                   line("articles", "n_articles_absent", F.coalesce("_n", F.lit(0)))]))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ A58
# Fixed decision catalogue: (problem, SQL predicate, decision, reason, impact on the model)
_DECISIONS = {
    "panel": [
        ("key_null", "client_id IS NULL", "DROP", "no primary key", "negligible"),
        ("age_null", "age IS NULL", "FLAG age_known", "missing share falls with time", "usable on late snapshots only"),
        ("gap_deviation_null", "stddev_timelapse_trs IS NULL", "FLAG has_multiple_purchases",
         "known from the third purchase day on", "feature of the classifier"),
        ("repairs_null", "all_repair_pdt_categ IS NULL", "FLAG has_repair_history", "known with repairs only",
         "sign of retention"),
        ("target_zero", "target_1y = 0", "KEEP", "what is to be modelled", "critical: defines the classifier"),
        ("zero_history_positive_target", "to_full_hist = 0 AND target_1y > 0", "KEEP", "checked for contradictions",
         "none")],
    "trs": [
        ("spend_negative", "spend < 0", "DROP", "adjustments", "negligible"),
        ("spend_null", "spend IS NULL", "IMPUTE + FLAG spend_imputed", "sale: catalog price, repair: 0", "minimal"),
        ("serial_null", "serial_number IS NULL", "FLAG serial_number_known", "sales without a tracked serial", "none"),
        ("serial_placeholder", f"serial_number = '{SERIAL_PLACEHOLDER}'", "NULLIFY", "hides a null", "minimal"),
        ("repair_without_price", "wwprice = 0 AND spend > 0 AND trs_categ = 'Repair'", "FLAG wwprice_missing",
         "service fee", "left out of mean prices, kept in totals"),
        ("sale_without_price", "wwprice = 0 AND spend > 0 AND trs_categ = 'Sale'", "FLAG wwprice_missing",
         "article not in the catalog", "left out of price features, kept in totals"),
        ("after_last_snapshot", f"trs_date > {TEST}", "FILTER per snapshot", "not known at the snapshot",
         "critical: leakage"),
        ("quantity_over_10", "qty > 10", "KEEP", "bulk purchases are legitimate", "negligible")],
    "clients": [
        ("birth_pre_1900", "year(birth_date) < 1900", "NULLIFY + FLAG birth_date_valid", "placeholder", "minimal"),
        ("birth_under_18", "birth_date > DATE '1992-01-01'", "NULLIFY + FLAG birth_date_valid", "entry error",
         "minimal"),
        ("birth_over_100", "birth_date < DATE '1910-01-01'", "NULLIFY + FLAG birth_date_valid", "implausible",
         "minimal"),
        ("first_dates_apart", "abs({first}) > 365", "FLAG purchase_date_anomaly", "purchases not tracked",
         "tells partial histories")],
    "crc": [
        ("duration_null", "appointment_duration IS NULL", "FLAG has_appointment_duration", "depends on the origin",
         "binary feature"),
        ("duration_over_480", "appointment_duration > 480", "DROP", "over 8 hours", "negligible")],
    "ccp": [
        ("sale_up_to_7_days_late", "{gap} BETWEEN 1 AND 7", "TOLERATE", "rounding or time zone", "minimal"),
        ("sale_over_30_days_late", "{gap} > 30", "DROP", "sale long after registration", "negligible"),
        ("sale_date_null", "sale_date IS NULL", "FLAG sale_date_valid", "alike for gifts and others",
         "binary feature")],
    "articles": [
        ("price_under_1", "world_price < 1", "KEEP", "minor articles", "none"),
        ("orphan_in_events", None, "LEFT JOIN", "discontinued or old codes", "price null, see wwprice_missing")],
}
_DAYS = {"spark": {"gap": "datediff(sale_date, creation_date)",
                   "first": "datediff(first_purchase_date, first_transaction_date)"},
         "duck": {"gap": "date_diff('day', creation_date, sale_date)",
                  "first": "date_diff('day', first_transaction_date, first_purchase_date)"}}


def _decisions_sql() -> str:
    parts = []
    for t, rules in _DECISIONS.items():
        for name, problem, decision, reason, impact in rules:
            if problem is None:
                n, total, source = "count(*) FILTER (WHERE d IS NULL)", "count(*)", (
                    "(SELECT e.article_id, a.article_id AS d FROM (SELECT DISTINCT article_id FROM trs "
                    "WHERE article_id IS NOT NULL) e LEFT JOIN (SELECT DISTINCT article_id FROM articles) a "
                    "ON e.article_id = a.article_id)")
            else:
                n, total, source = f"count(*) FILTER (WHERE {problem.format(**_DAYS['duck'])})", "count(*)", t
            parts.append(f"SELECT '{t}' AS dataset, '{name}' AS problem, {n} AS n, {spct(n, total)} AS pct, "
                         f"'{decision}' AS decision, '{reason}' AS reason, '{impact}' AS impact FROM {source} _s")
    return _u(parts)


@register("decision_catalogue", _decisions_sql(), tuple(_DECISIONS))
def decision_catalogue(c: Ctx):
    """All 25 decisions with live counts, reason and impact; one pass a table,
    and one over the distinct article ids of the events."""
    parts = []
    for t, rules in _DECISIONS.items():
        counted = [(n, p.format(**_DAYS["spark"]), *rest) for n, p, *rest in rules if p is not None]
        parts.append(Q.rule_counts(getattr(c, t), t, counted))
        for name, problem, *labels in rules:
            if problem is None:
                ev = c.trs.select("article_id").filter("article_id IS NOT NULL").distinct()
                known = c.articles.select("article_id", F.lit(1).alias("_known")).distinct()
                parts.append(Q.rule_counts(ev.join(known, "article_id", "left"), t, [(name, "_known IS NULL", *labels)]))
    return reduce(DataFrame.unionByName, parts).select(
        "dataset", F.col("rule").alias("problem"), "n", "pct", F.col("label0").alias("decision"),
        F.col("label1").alias("reason"), F.col("label2").alias("impact"))


# ------------------------------------------------------------------ J6 / J7
_ORPHAN_DIMS = {"all": "'all'", "channel": "channel", "categ": "categ", "trs_categ": "trs_categ",
                "year": "year(trs_date)"}


@register("orphan_article_breakdown", f"""
WITH o AS (SELECT * FROM trs t WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.article_id = t.article_id)),
l AS ({_long_sql("o", _ORPHAN_DIMS, ["article_id", "spend"])})
SELECT dimension, value, count(*) AS n_rows, count(DISTINCT article_id) AS n_orphan_ids,
  count(*) FILTER (WHERE spend > 0) AS n_positive_spend FROM l GROUP BY dimension, value""", ("trs", "articles"))
def orphan_article_breakdown(c: Ctx):
    """Events of articles that the catalog lacks, by channel, product and
    transaction category and year."""
    o = c.trs.join(c.articles.select("article_id"), "article_id", "left_anti")
    return _long(o, _ORPHAN_DIMS, ["article_id", "spend"]).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("article_id").alias("n_orphan_ids"),
        count_where(F.col("spend") > 0).alias("n_positive_spend"))


_ID_TABLES = ("trs", "clients", "crc", "ccp")


@register("orphan_clients", f"""
WITH s AS (SELECT DISTINCT client_id FROM panel WHERE date_target = {TEST} AND client_id IS NOT NULL),
every AS (SELECT DISTINCT client_id FROM panel)
""" + _u(f"""SELECT '{t}' AS table_name, 'not_in_snapshot' AS relation, count(*) AS n_clients,
  count(*) FILTER (WHERE client_id IN (SELECT client_id FROM every)) AS n_in_other_snapshots,
  {"CAST(min(y0) AS INTEGER)" if t == "trs" else "CAST(NULL AS INTEGER)"} AS min_year,
  {"CAST(max(y1) AS INTEGER)" if t == "trs" else "CAST(NULL AS INTEGER)"} AS max_year,
  CAST(NULL AS BIGINT) AS n_positive_history
FROM (SELECT client_id{", min(year(trs_date)) AS y0, max(year(trs_date)) AS y1" if t == "trs" else ""} FROM {t}
      WHERE client_id IS NOT NULL GROUP BY client_id) x
WHERE client_id NOT IN (SELECT client_id FROM s)""" for t in _ID_TABLES) + f"""
UNION ALL
SELECT 'trs', 'snapshot_without_rows', count(*), count(*), NULL, NULL, count(*) FILTER (WHERE to_full_hist > 0)
FROM panel WHERE date_target = {TEST} AND client_id IS NOT NULL
  AND client_id NOT IN (SELECT client_id FROM trs WHERE client_id IS NOT NULL)""", ("panel", *_ID_TABLES))
def orphan_clients(c: Ctx):
    """Clients of each table that the test snapshot lacks - how many of them
    other snapshots hold, and the years of their transactions - and snapshot
    clients without transactions, how many with a history all the same. One
    grouped row per client id over the union of all tables; no id leaves Spark."""
    snap = F.col("date_target") == F.lit(c.test_snapshot)
    none = F.lit(None)
    ids = [c.panel.select("client_id", F.when(snap, 2).otherwise(1).alias("m"), none.cast("int").alias("y"),
                          F.when(snap, F.col("to_full_hist")).alias("h"))]
    for i, t in enumerate(_ID_TABLES):
        y = F.year("trs_date") if t == "trs" else none.cast("int")
        ids.append(getattr(c, t).select("client_id", F.lit(4 << i).alias("m"), y.alias("y"), none.cast("double").alias("h")))
    per = reduce(DataFrame.unionByName, ids).filter("client_id IS NOT NULL").groupBy("client_id").agg(
        F.bit_or("m").alias("m"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("h").alias("h"))
    has = lambda bit: F.col("m").bitwiseAND(F.lit(bit)) != 0
    aggs = []
    for i, t in enumerate(_ID_TABLES):
        lost = has(4 << i) & ~has(2)
        aggs += [F.count_if(lost).alias(f"n_{t}"), F.count_if(lost & has(1)).alias(f"o_{t}")]
    lost, idle = has(4) & ~has(2), has(2) & ~has(4)
    row = per.agg(*aggs, F.min(F.when(lost, F.col("y0"))).alias("y0"), F.max(F.when(lost, F.col("y1"))).alias("y1"),
                  F.count_if(idle).alias("idle"), count_where(idle & (F.col("h") > 0)).alias("rich"))
    names = ["table_name", "relation", "n_clients", "n_in_other_snapshots", "min_year", "max_year", "n_positive_history"]
    year = none.cast("int")
    lines = [[F.lit(t), F.lit("not_in_snapshot"), F.col(f"n_{t}"), F.col(f"o_{t}"),
              F.col("y0") if t == "trs" else year, F.col("y1") if t == "trs" else year, none.cast("bigint")]
             for t in _ID_TABLES]
    lines.append([F.lit("trs"), F.lit("snapshot_without_rows"), F.col("idle"), F.col("idle"), year, year, F.col("rich")])
    return Q.rows_from(row, [[x.alias(n) for x, n in zip(line, names)] for line in lines])


_ALL_SETS = [*_SETS, ("panel_all", "SELECT client_id FROM panel")]


@register("referential_integrity_all", _refmatrix_sql(_ALL_SETS), ("panel", *_ID_TABLES))
def referential_integrity_all(c: Ctx):
    """All fifteen pairs of the six client-id sets, the panel of all snapshots included."""
    return Q.referential_matrix({"panel": _test_panel(c), "trs": c.trs, "clients": c.clients, "crc": c.crc,
                                 "ccp": c.ccp, "panel_all": c.panel}, "client_id")


# ------------------------------------------------------------------ V7
_ADDED = {"trs": ("spend_imputed", "serial_number_known", "wwprice_missing"),
          "clients": ("purchase_transaction_gap", "birth_date_valid", "purchase_date_anomaly"),
          "crc": ("has_appointment_duration",), "ccp": ("is_gift", "sale_creation_gap", "sale_date_valid"),
          "panel": ("age_known", "has_multiple_purchases", "has_repair_history")}
_MEASURES = ("purchase_transaction_gap", "sale_creation_gap", "is_gift")


@register("cleaning_columns_added", _u(
    f"SELECT '{t}' AS table_name, '{x}' AS column_name, '{'column' if x in _MEASURES else 'flag'}' AS kind, "
    f"count({x}) AS n_known, "
    f"{'CAST(NULL AS BIGINT)' if x in _MEASURES else f'count(*) FILTER (WHERE {x} = 1)'} AS n_set FROM {_CLEAN_VIEW[t]}"
    for t, xs in _ADDED.items() for x in xs), tuple(_CLEAN_VIEW.values()))
def cleaning_columns_added(c: Ctx):
    """V7: flags and columns that cleaning adds, found by comparing the schemas
    (no job), with how many rows know and set them (one pass a table)."""
    parts = []
    for t, raw, clean in _pairs(c):
        added = [f for f in clean.schema.fields if f.name not in raw.columns]
        flags = {f.name for f in added if f.dataType.typeName() in ("integer", "byte") and f.name not in _MEASURES}
        row = clean.agg(*[F.count(f.name).alias(f"k_{f.name}") for f in added],
                        *[F.count_if(F.col(x) == 1).alias(f"s_{x}") for x in flags])
        parts.append(Q.rows_from(row, [[
            F.lit(t).alias("table_name"), F.lit(f.name).alias("column_name"),
            F.lit("flag" if f.name in flags else "column").alias("kind"), F.col(f"k_{f.name}").alias("n_known"),
            (F.col(f"s_{f.name}") if f.name in flags else F.lit(None).cast("bigint")).alias("n_set")] for f in added]))
    return reduce(DataFrame.unionByName, parts)
