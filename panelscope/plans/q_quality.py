"""Quality-audit queries (SURVEY 2.4 A13-A23, A29-A49, A57, A58; 2.3 J5-J7,
J9, J10, J14; 2.5 W2, W6; 2.7 X1, X3, X4; 2.8 L1, L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.functions.exprs import count_where
from panelscope.operators import quality as Q
from panelscope.plans.oracle_views import pct as spct
from panelscope.plans.registry import Ctx, register
from panelscope.sources.views import PANEL_COLUMNS, SNAPSHOT_DATES, VIEW_COLUMNS

TEST = "DATE '2000-01-01'"


def _u(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------ A13 / A14
def _missing_sql(view: str, cols, dataset: str) -> str:
    return _u(f"SELECT '{dataset}' AS dataset, '{c}' AS column_name, "
              f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing, "
              f"{spct(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')} AS pct_missing "
              f"FROM {view}" for c in cols)


@register("missing_report",
          f"SELECT * FROM ({_missing_sql('panel', PANEL_COLUMNS, 'panel')}) x "
          "WHERE pct_missing >= 5.0", ("panel",))
def missing_report(c: Ctx):
    """Panel columns with >= 5% nulls (one pass over all columns)."""
    return Q.missing_report(c.panel, "panel", 5.0)


STRUCTURAL = ("stddev_price", "avg_timelapse_trs", "stddev_timelapse_trs", "all_repair_pdt_categ", "age", "birth_date",
              "sale_date", "appointment_duration")


def _label_sql(inner: str) -> str:
    s = ", ".join(f"'{x}'" for x in STRUCTURAL)
    return f"""
SELECT dataset, column_name, n_missing, pct_missing,
  CASE WHEN n_missing = 0 THEN 'none' WHEN column_name IN ({s}) THEN 'structural'
       ELSE 'random' END AS missing_type,
  CASE WHEN pct_missing = 0 THEN 'OK' WHEN pct_missing < 5 THEN 'LOW' ELSE 'MEDIUM' END
    AS criticality
FROM ({inner}) x"""


@register("missing_complete", _label_sql(_u(_missing_sql(v, cols, v) for v, cols in
                                            VIEW_COLUMNS.items())), tuple(VIEW_COLUMNS))
def missing_complete(c: Ctx):
    """A14 + F27: every table x column with type / criticality labels."""
    from functools import reduce
    frames = {"trs": c.trs, "articles": c.articles, "clients": c.clients, "crc": c.crc,
              "ccp": c.ccp, "panel": c.panel}
    allm = reduce(lambda a, b: a.unionByName(b),
                  [Q.missing_report(df.select(*VIEW_COLUMNS[n]), n, 0.0) for n, df in frames.items()])
    n, p = F.col("n_missing"), F.col("pct_missing")
    return allm.select(
        "*",
        F.when(n == 0, "none").when(F.col("column_name").isin(*STRUCTURAL), "structural")
         .otherwise("random").alias("missing_type"),
        F.when(p == 0, "OK").when(p < 5, "LOW").otherwise("MEDIUM").alias("criticality"))


_SNAP_LABELS = {d: "s_" + d.replace("-", "_") for d in SNAPSHOT_DATES}


@register("missing_by_snapshot", "SELECT column_name, " + ", ".join(
    f"max(CASE WHEN date_target = DATE '{d}' THEN pct END) AS {lab}"
    for d, lab in _SNAP_LABELS.items()) + " FROM (" + _u(
    f"SELECT date_target, '{c}' AS column_name, count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
    f"{spct(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')} AS pct "
    f"FROM panel GROUP BY date_target" for c in PANEL_COLUMNS if c != "date_target")
    + ") x GROUP BY column_name HAVING 100.0 * sum(n_null) >= 5.0 * sum(n)", ("panel",))
def missing_by_snapshot(c: Ctx):
    """% null per snapshot of every column with at least 5 % null."""
    return Q.missing_by_snapshot(c.panel, "date_target", _SNAP_LABELS)


@register("missing_by_group_diagnosis", f"""
WITH g AS (SELECT origin, count(*) AS n,
             count(*) FILTER (WHERE appointment_duration IS NULL) AS n_missing
           FROM crc WHERE origin IS NOT NULL GROUP BY origin),
h AS (SELECT origin, n, n_missing, {spct('n_missing', 'n')} AS pct_missing FROM g)
SELECT origin, n, n_missing, pct_missing,
  (SELECT round(stddev_samp(pct_missing), 6) FROM h) AS std_across_groups,
  CASE WHEN (SELECT round(stddev_samp(pct_missing), 6) FROM h) > 10 THEN 'MAR' ELSE 'MNAR' END
    AS diagnosis
FROM h""", ("crc",))
def missing_by_group_diagnosis(c: Ctx):
    """Duration missingness per origin, MAR/MNAR by the spread."""
    return Q.missing_by_group(c.crc, "appointment_duration", "origin")


@register("missing_by_flag", f"""
SELECT flag_gift, count(*) AS n, count(*) FILTER (WHERE sale_date IS NULL) AS n_missing,
  {spct('count(*) FILTER (WHERE sale_date IS NULL)', 'count(*)')} AS pct_missing
FROM ccp GROUP BY flag_gift""", ("ccp",))
def missing_by_flag(c: Ctx):
    """A17"""
    return Q.null_share_by(c.ccp, "sale_date", "flag_gift")


@register("structural_missing_check", """
SELECT count(*) FILTER (WHERE nb_trs_full_hist <= 1) AS n_single_purchase,
  count(*) FILTER (WHERE stddev_price IS NULL) AS n_null_std,
  count(*) FILTER (WHERE nb_trs_full_hist <= 1 AND stddev_price IS NULL) AS n_both
FROM panel""", ("panel",))
def structural_missing_check(c: Ctx):
    """A18"""
    single, nstd = F.col("nb_trs_full_hist") <= 1, F.col("stddev_price").isNull()
    return c.panel.agg(count_where(single).alias("n_single_purchase"),
                       count_where(nstd).alias("n_null_std"),
                       count_where(single & nstd).alias("n_both"))


# ------------------------------------------------------------------ A19 / A20 / L1 / L3
@register("temporal_coverage", f"""
WITH t AS (SELECT s.date_target,
  (SELECT count(*) FROM trs WHERE trs_date <= s.date_target) AS n_safe,
  (SELECT count(*) FROM trs) AS n_total FROM snapshots s)
SELECT date_target, CAST(n_safe AS BIGINT) AS n_safe, CAST(n_total - n_safe AS BIGINT) AS n_leakage,
  CAST(n_total AS BIGINT) AS n_total, {spct('n_total - n_safe', 'n_total')} AS pct_leakage,
  coalesce(n_safe >= lag(n_safe) OVER (ORDER BY date_target), true) AS monotone
FROM t""", ("trs", "snapshots"))
def temporal_coverage(c: Ctx):
    """A19"""
    return Q.temporal_coverage(c.trs, c.snapshots, "trs_date")


@register("leakage_breakdown", """
SELECT CASE WHEN GROUPING(channel) = 0 THEN 'channel' WHEN GROUPING(trs_categ) = 0 THEN 'trs_categ'
            ELSE 'year' END AS dimension,
  CAST(CASE WHEN GROUPING(channel) = 0 THEN channel WHEN GROUPING(trs_categ) = 0 THEN trs_categ
            ELSE CAST(y AS VARCHAR) END AS VARCHAR) AS value,
  count(*) AS n
FROM (SELECT channel, trs_categ, year(trs_date) AS y FROM trs WHERE trs_date > DATE '2000-01-01') x
GROUP BY GROUPING SETS ((channel), (trs_categ), (y))""", ("trs",))
def leakage_breakdown(c: Ctx):
    """Rows after the last snapshot by channel / type / year."""
    late = c.trs.filter(F.col("trs_date") > F.lit(c.last_snapshot)).select(
        "channel", "trs_categ", F.year("trs_date").alias("y"))
    out = Q.by_each_dimension(late, ["channel", "trs_categ", "y"], [F.count(F.lit(1)).alias("n")])
    return out.select(F.when(F.col("dimension") == "y", "year").otherwise(F.col("dimension"))
                      .alias("dimension"), "value", "n")


@register("date_list_leakage", """
SELECT date_target,
  count(*) FILTER (WHERE d <= date_target) AS n_ok,
  count(*) FILTER (WHERE d > date_target) AS n_violations,
  count(*) FILTER (WHERE d IS NULL) AS n_unparsable
FROM (SELECT date_target, CAST(try_strptime(trim(e), '%Y-%m-%d') AS DATE) AS d
      FROM (SELECT date_target, unnest(string_split(all_purchased_dates, ',')) AS e
            FROM panel WHERE all_purchased_dates IS NOT NULL) u) x
GROUP BY date_target""", ("panel",))
def date_list_leakage(c: Ctx):
    """L1: every element of every list, all snapshots (no head sample)."""
    return Q.date_list_leakage(c.panel, "all_purchased_dates")


_LISTS = ["all_purchased_dates", "all_repair_pdt_categ"]


@register("list_column_probe", _u(f"""
SELECT '{x}' AS column_name, count({x}) AS n_non_null,
  count(*) FILTER (WHERE contains({x}, ',')) AS n_multi_valued,
  max(len(string_split({x}, ','))) AS max_elements,
  CAST(sum(len(string_split({x}, ','))) AS DOUBLE) / NULLIF(CAST(count({x}) AS DOUBLE), 0)
    AS avg_elements
FROM panel""" for x in _LISTS), ("panel",))
def list_column_probe(c: Ctx):
    """L3"""
    return Q.list_column_probe(c.panel, _LISTS)


# ------------------------------------------------------------------ A21-A23
@register("placeholder_detect", """
SELECT serial_number, count(*) AS n FROM trs WHERE serial_number IS NOT NULL
GROUP BY serial_number ORDER BY n DESC, serial_number LIMIT 1""", ("trs",))
def placeholder_detect(c: Ctx):
    """Most frequent non-null serial (deterministic tie-break)."""
    return Q.mode_value(c.trs, "serial_number")


@register("serial_number_profile", f"""
SELECT CASE WHEN GROUPING(trs_categ) = 0 THEN 'trs_categ' WHEN GROUPING(channel) = 0 THEN 'channel'
            ELSE 'categ' END AS dimension,
  CASE WHEN GROUPING(trs_categ) = 0 THEN trs_categ WHEN GROUPING(channel) = 0 THEN channel
       ELSE categ END AS value,
  count(*) AS n, count(*) FILTER (WHERE serial_number IS NULL) AS n_null,
  {spct('count(*) FILTER (WHERE serial_number IS NULL)', 'count(*)')} AS pct_null,
  count(*) FILTER (WHERE serial_number = 'PLACEHOLDER') AS n_placeholder,
  {spct("count(*) FILTER (WHERE serial_number = 'PLACEHOLDER')", 'count(*)')} AS pct_placeholder
FROM trs GROUP BY GROUPING SETS ((trs_categ), (channel), (categ))""", ("trs",))
def serial_number_profile(c: Ctx):
    """A22"""
    from panelscope.sources.views import SERIAL_PLACEHOLDER
    return Q.placeholder_profile(c.trs, "serial_number", ["trs_categ", "channel", "categ"],
                                 SERIAL_PLACEHOLDER)


@register("value_counts", "SELECT origin, count(*) AS n FROM crc GROUP BY origin", ("crc",))
def value_counts(c: Ctx):
    """A23 (dropna=False: the null origin is its own row)"""
    return Q.value_counts(c.crc, "origin", dropna=False)


@register("sorted_report", "SELECT channel, count(*) AS n FROM trs GROUP BY channel ORDER BY n DESC, channel",
          ("trs",))
def sorted_report(c: Ctx):
    """Ordered only at the output (the sort is the last operator)."""
    return Q.value_counts(c.trs, "channel").orderBy(F.col("n").desc(), "channel")


# ------------------------------------------------------------------ A29-A30
@register("value_band_violations", """
SELECT trs_categ,
  count(*) FILTER (WHERE spend < 0) AS n_negative, count(*) FILTER (WHERE spend = 0) AS n_zero,
  count(*) FILTER (WHERE spend > 0) AS n_positive, count(*) FILTER (WHERE spend IS NULL) AS n_null,
  count(DISTINCT CASE WHEN spend < 0 THEN client_id END) AS n_clients_negative,
  min(CASE WHEN spend < 0 THEN spend END) AS min_negative,
  max(CASE WHEN spend < 0 THEN spend END) AS max_negative
FROM trs GROUP BY trs_categ""", ("trs",))
def value_band_violations(c: Ctx):
    """A29"""
    s = F.col("spend")
    return c.trs.groupBy("trs_categ").agg(
        count_where(s < 0).alias("n_negative"), count_where(s == 0).alias("n_zero"),
        count_where(s > 0).alias("n_positive"), F.count_if(s.isNull()).alias("n_null"),
        F.count_distinct(F.when(s < 0, F.col("client_id"))).alias("n_clients_negative"),
        F.min(F.when(s < 0, s)).alias("min_negative"), F.max(F.when(s < 0, s)).alias("max_negative"))


@register("zero_price_profile", """
SELECT CASE WHEN GROUPING(trs_categ) = 0 THEN 'trs_categ' WHEN GROUPING(channel) = 0 THEN 'channel'
            ELSE 'year' END AS dimension,
  CASE WHEN GROUPING(trs_categ) = 0 THEN trs_categ WHEN GROUPING(channel) = 0 THEN channel
       ELSE CAST(y AS VARCHAR) END AS value,
  count(*) AS n, count(*) FILTER (WHERE spend = 0) AS n_spend_zero,
  count(*) FILTER (WHERE spend > 0) AS n_spend_positive,
  count(*) FILTER (WHERE spend < 0) AS n_spend_negative
FROM (SELECT trs_categ, channel, year(trs_date) AS y, spend FROM trs WHERE wwprice = 0) x
GROUP BY GROUPING SETS ((trs_categ), (channel), (y))""", ("trs",))
def zero_price_profile(c: Ctx):
    """A30"""
    z = c.trs.filter(F.col("wwprice") == 0).select("trs_categ", "channel",
                                                  F.year("trs_date").alias("y"), "spend")
    s = F.col("spend")
    out = Q.by_each_dimension(z, ["trs_categ", "channel", "y"], [
        F.count(F.lit(1)).alias("n"), count_where(s == 0).alias("n_spend_zero"),
        count_where(s > 0).alias("n_spend_positive"), count_where(s < 0).alias("n_spend_negative")])
    return out.select(F.when(F.col("dimension") == "y", "year").otherwise(F.col("dimension"))
                      .alias("dimension"), "value", "n", "n_spend_zero", "n_spend_positive",
                      "n_spend_negative")
