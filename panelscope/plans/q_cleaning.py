"""Cleaning queries (SURVEY 2.2 F1-F25, F28; 2.4 A9-A12; 2.3 J13; 2.7 X2;
2.11 V4, V7)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.operators import cleaning as CL
from panelscope.operators import distribution as D
from panelscope.plans.oracle_views import mm, mt, pct
from panelscope.plans.registry import Ctx, register
from panelscope.sources.views import CLIENT_REFERENCE_DATE, PANEL_COLUMNS


@register("filter_key_not_null", """
SELECT client_id, appointment_id FROM crc WHERE client_id IS NOT NULL""", ("crc",))
def filter_key_not_null(c: Ctx):
    """F1"""
    return CL.filter_key_not_null(c.crc).select("client_id", "appointment_id")


@register("filter_non_negative_keep_null", """
SELECT client_id, trs_date, article_id, spend FROM trs WHERE spend IS NULL OR spend >= 0""",
          ("trs",))
def filter_non_negative_keep_null(c: Ctx):
    """F2"""
    return CL.filter_non_negative_keep_null(c.trs).select("client_id", "trs_date", "article_id", "spend")


@register("filter_duration_cap_keep_null", """
SELECT appointment_id, appointment_duration FROM crc
WHERE appointment_duration IS NULL OR appointment_duration <= 480""", ("crc",))
def filter_duration_cap_keep_null(c: Ctx):
    """F3"""
    return CL.filter_cap_keep_null(c.crc, "appointment_duration", 480).select(
        "appointment_id", "appointment_duration")


@register("filter_drop_serious_gap", """
SELECT serial_number, client_id, sale_creation_gap FROM clean_ccp""", ("clean_ccp",))
def filter_drop_serious_gap(c: Ctx):
    """F4 (with F15's gap)"""
    return c.clean_ccp.select("serial_number", "client_id", "sale_creation_gap")


@register("filter_drop_null_and_negative", """
SELECT client_id, trs_date, article_id, spend FROM trs WHERE spend >= 0""", ("trs",))
def filter_drop_null_and_negative(c: Ctx):
    """contrast with F2 - unknown spends are lost too."""
    return CL.filter_drop_null_and_negative(c.trs).select("client_id", "trs_date", "article_id", "spend")


@register("impute_conditional", """
SELECT client_id, trs_date, article_id, trs_categ, spend, spend_imputed FROM clean_trs""",
          ("clean_trs",))
def impute_conditional(c: Ctx):
    """F8"""
    return c.clean_trs.select("client_id", "trs_date", "article_id", "trs_categ", "spend",
                              "spend_imputed")


@register("sentinel_to_null", """
SELECT client_id, trs_date, article_id, serial_number, serial_number_known FROM clean_trs""",
          ("clean_trs",))
def sentinel_to_null(c: Ctx):
    """F9"""
    return c.clean_trs.select("client_id", "trs_date", "article_id", "serial_number",
                              "serial_number_known")


@register("presence_flags", """
SELECT client_id, date_target, age_known, has_multiple_purchases, has_repair_history
FROM clean_panel""", ("clean_panel",))
def presence_flags(c: Ctx):
    """F10 (panel flags; the other tables' flags are in their cleaners)."""
    return c.clean_panel.select("client_id", "date_target", "age_known",
                                "has_multiple_purchases", "has_repair_history")


@register("rule_flag_price_missing", """
SELECT client_id, trs_date, article_id, wwprice, spend, wwprice_missing FROM clean_trs""",
          ("clean_trs",))
def rule_flag_price_missing(c: Ctx):
    """F11 (evaluated after F8)"""
    return c.clean_trs.select("client_id", "trs_date", "article_id", "wwprice", "spend",
                              "wwprice_missing")


@register("nullify_implausible_date", """
SELECT client_id, birth_date, birth_date_valid FROM clean_clients""", ("clean_clients",))
def nullify_implausible_date(c: Ctx):
    """F12"""
    return c.clean_clients.select("client_id", "birth_date", "birth_date_valid")


@register("age_from_birth_date", f"""
SELECT client_id,
  CAST(date_diff('day', birth_date, DATE '{CLIENT_REFERENCE_DATE}') AS DOUBLE)
    / CAST(365.25 AS DOUBLE) AS age_years
FROM clients""", ("clients",))
def age_from_birth_date(c: Ctx):
    """F13 with an explicit reference date"""
    import datetime as dt
    ref = dt.date.fromisoformat(CLIENT_REFERENCE_DATE)
    return c.clients.select("client_id", CL.age_years(ref, F.col("birth_date")).alias("age_years"))


@register("date_gap_flag", """
SELECT client_id, purchase_transaction_gap, purchase_date_anomaly FROM clean_clients""",
          ("clean_clients",))
def date_gap_flag(c: Ctx):
    """F14"""
    return c.clean_clients.select("client_id", "purchase_transaction_gap", "purchase_date_anomaly")


@register("signed_date_gap", """
SELECT serial_number, client_id, CAST(date_diff('day', creation_date, sale_date) AS INTEGER)
  AS sale_creation_gap FROM ccp""", ("ccp",))
def signed_date_gap(c: Ctx):
    """null when either date is unknown"""
    return c.ccp.select("serial_number", "client_id",
                        F.datediff("sale_date", "creation_date").alias("sale_creation_gap"))


@register("fill_defaults", """
SELECT client_id, date_target, coalesce(age, 0) AS age,
  coalesce(residency_market, 'Unknown') AS residency_market FROM panel""", ("panel",))
def fill_defaults(c: Ctx):
    """F16"""
    out = CL.fill_defaults(c.panel.select("client_id", "date_target", "age", "residency_market"),
                           numeric=["age"], categorical=["residency_market"])
    return out


@register("drop_null_subset", """
SELECT serial_number, client_id, article_id, sale_date FROM ccp
WHERE article_id IS NOT NULL AND sale_date IS NOT NULL""", ("ccp",))
def drop_null_subset(c: Ctx):
    """F17"""
    return CL.drop_null_subset(c.ccp, ["article_id", "sale_date"]).select(
        "serial_number", "client_id", "article_id", "sale_date")


@register("drop_rename_cast", """
SELECT serial_number, client_id, article_id, creation_date, sale_date, is_gift, sale_date_valid
FROM clean_ccp""", ("clean_ccp",))
def drop_rename_cast(c: Ctx):
    """FLAG_GIFT -> IS_GIFT, helper gap dropped"""
    return c.clean_ccp.drop("sale_creation_gap")


_TXT = ("CASE WHEN qty = 13 THEN 'not a date' WHEN qty = 14 THEN '' "
        "ELSE strftime(ship_date, '%Y-%m-%d') END")


@register("coerce_dates", f"""
SELECT client_id, trs_date, article_id, {_TXT} AS ship_text,
  CAST(try_strptime({_TXT}, '%Y-%m-%d') AS DATE) AS ship_date
FROM trs""", ("trs",))
def coerce_dates(c: Ctx):
    """text dates with junk and blanks parse to null, not an error"""
    q = F.col("qty")
    txt = (F.when(q == 13, F.lit("not a date")).when(q == 14, F.lit(""))
            .otherwise(F.date_format("ship_date", "yyyy-MM-dd")))
    return c.trs.select("client_id", "trs_date", "article_id", txt.alias("ship_text"),
                        CL.coerce_date(txt).alias("ship_date"))


@register("clip_values", """
SELECT client_id, date_target,
  round(least(to_full_hist, (SELECT quantile_cont(to_full_hist, 0.99) FROM panel)), 6)
    AS to_full_hist_clipped
FROM panel""", ("panel",))
def clip_values(c: Ctx):
    """clip at the exact, unrounded 99th percentile, read off value ranges."""
    panel = c.staged(c.panel.select("client_id", "date_target", "to_full_hist"))
    p99 = D.exact_percentiles(panel, "to_full_hist", {"p": 0.99}, digits=None).agg(F.first("p")).scalar()
    return panel.select("client_id", "date_target",
                        F.round(CL.clip(F.col("to_full_hist"), hi=p99), 6).alias("to_full_hist_clipped"))


def _miss_bins_sql() -> str:
    n = len(PANEL_COLUMNS)
    nulls = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in PANEL_COLUMNS)
    edges = [10, 20, 30, 40, 50, 60]
    case = "CASE WHEN n_null = 0 THEN '0'"
    lo = 0
    for e in edges:
        case += f" WHEN n_null * 100 <= {e * n} THEN '{lo}-{e}'"
        lo = e
    case += " ELSE '60-100' END"
    return f"""
SELECT {case} AS missing_bin, count(*) AS n_rows,
  count(*) FILTER (WHERE n_null * 100 > {50 * n}) AS n_rows_over_50
FROM (SELECT {nulls} AS n_null FROM panel) x GROUP BY 1"""


@register("row_missing_share", _miss_bins_sql(), ("panel",))
def row_missing_share(c: Ctx):
    """per-row share of null columns, binned (explicit zero bucket, D13)."""
    n = len(PANEL_COLUMNS)
    n_null = reduce(add, [F.col(x).isNull().cast("int") for x in PANEL_COLUMNS])
    b = F.when(F.col("n_null") == 0, F.lit("0"))
    lo = 0
    for e in (10, 20, 30, 40, 50, 60):
        b = b.when(F.col("n_null") * 100 <= e * n, F.lit(f"{lo}-{e}"))
        lo = e
    b = b.otherwise(F.lit("60-100"))
    x = c.panel.select(n_null.alias("n_null"))
    return x.groupBy(b.alias("missing_bin")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("n_null") * 100 > 50 * n).alias("n_rows_over_50"))


@register("price_ratio", """
SELECT client_id, trs_date, article_id, spend, wwprice, spend / NULLIF(wwprice, 0) AS price_ratio
FROM trs""", ("trs",))
def price_ratio(c: Ctx):
    """F28"""
    return c.trs.select("client_id", "trs_date", "article_id", "spend", "wwprice",
                        CL.price_ratio(c.trs).alias("price_ratio"))


# --------------------------------------------------------------- per-client features
@register("contact_features", "SELECT * FROM contact_feats", ("contact_feats",))
def contact_features(c: Ctx):
    """A9"""
    return CL.contact_features(c.clean_crc)


@register("registration_features", "SELECT * FROM registration_feats", ("registration_feats",))
def registration_features(c: Ctx):
    """A10"""
    return CL.registration_features(c.clean_ccp)


@register("supplementary_features", "SELECT * FROM supp", ("supp",))
def supplementary_features(c: Ctx):
    """A11"""
    return c.supp


@register("union_distinct_ids", """
SELECT DISTINCT client_id FROM (SELECT client_id FROM clean_crc UNION ALL
  SELECT client_id FROM clean_ccp UNION ALL SELECT client_id FROM clean_clients) u
WHERE client_id IS NOT NULL""", ("clean_crc", "clean_ccp", "clean_clients"))
def union_distinct_ids(c: Ctx):
    """X2"""
    return CL.union_distinct_ids(c.clean_crc, c.clean_ccp, c.clean_clients)


_TOT_SQL = f"""
WITH ev AS (SELECT client_id, {mt('spend')} AS spend_sum, count(*) AS n_trs,
              {mm('spend')} AS spend_mean, CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty_sum
            FROM trs GROUP BY client_id),
ct AS (SELECT client_id, count(*) AS n_contacts, max(creation_date) AS last_contact
       FROM crc WHERE client_id IS NOT NULL GROUP BY client_id),
pr AS (SELECT client_id, count(*) AS n_products,
         CAST(sum(CAST(coalesce(flag_gift, false) AS INTEGER)) AS BIGINT) AS n_gifts,
         CAST(sum(CAST(sale_date IS NOT NULL AS INTEGER)) AS BIGINT) AS n_known_sale
       FROM ccp GROUP BY client_id)
"""


@register("client_totals_v1", _TOT_SQL + "SELECT * FROM ev", ("trs", "crc", "ccp"))
def client_totals_v1(c: Ctx):
    """Per-client totals without an as-of cut (labelled not as-of, D8)."""
    ev, _, _ = CL.client_totals_v1(c.trs, c.crc, c.ccp)
    return ev


@register("join_client_base_table", _TOT_SQL + """
SELECT p.client_id, p.date_target, k.gender, ev.spend_sum, ev.n_trs, ev.qty_sum,
  coalesce(ct.n_contacts, 0) AS n_contacts, ct.last_contact,
  coalesce(pr.n_products, 0) AS n_products, coalesce(pr.n_gifts, 0) AS n_gifts,
  coalesce(pr.n_known_sale, 0) AS n_known_sale
FROM panel p LEFT JOIN clients k ON p.client_id = k.client_id
LEFT JOIN ev ON p.client_id = ev.client_id
LEFT JOIN ct ON p.client_id = ct.client_id
LEFT JOIN pr ON p.client_id = pr.client_id
WHERE p.date_target = DATE '2000-01-01'""", ("trs", "crc", "ccp", "panel", "clients"))
def join_client_base_table(c: Ctx):
    """Early-variant base table; the product aggregate is joined once
    and zero-filled (D9)."""
    ev, ct, pr = CL.client_totals_v1(c.trs, CL.filter_key_not_null(c.crc), c.ccp)
    p = c.panel.filter(F.col("date_target") == F.lit(c.test_snapshot)).select("client_id", "date_target")
    out = (p.join(c.clients.select("client_id", "gender"), "client_id", "left")
            .join(ev.select("client_id", "spend_sum", "n_trs", "qty_sum"), "client_id", "left")
            .join(ct, "client_id", "left").join(pr, "client_id", "left"))
    return out.fillna(0, subset=["n_contacts", "n_products", "n_gifts", "n_known_sale"])


# --------------------------------------------------------------- validation
def _binary(*flags: str) -> list[tuple[str, str]]:
    return [(f"flag_{x}", f"{x} IN (0, 1)") for x in flags]


CLEANING_CHECKS: dict[str, list[tuple[str, str]]] = {
    "trs": [("spend_non_negative", "spend >= 0"),
            ("spend_not_null", "spend IS NOT NULL"),
            ("no_placeholder_serial", "serial_number IS NULL OR serial_number <> 'PLACEHOLDER'"),
            *_binary("spend_imputed", "serial_number_known", "wwprice_missing")],
    "clients": [("birth_not_pre_1900", "birth_date IS NULL OR year(birth_date) >= 1900"),
                *_binary("birth_date_valid", "purchase_date_anomaly")],
    "crc": [("duration_le_480", "appointment_duration IS NULL OR appointment_duration <= 480"),
            *_binary("has_appointment_duration")],
    "ccp": [("gap_le_30", "sale_creation_gap IS NULL OR sale_creation_gap <= 30"),
            *_binary("sale_date_valid")],
    "panel": [("client_id_not_null", "client_id IS NOT NULL"),
              ("targets_not_null", "target_1m IS NOT NULL AND target_3m IS NOT NULL "
                                   "AND target_1y IS NOT NULL"),
              *_binary("age_known", "has_multiple_purchases", "has_repair_history")],
}
#: columns whose known values of rows with a key must all outlive cleaning
UNTOUCHED = {"panel": ("target_1m", "target_3m", "target_1y")}
_CLEAN_VIEW = {"trs": "clean_trs", "clients": "clean_clients", "crc": "clean_crc",
               "ccp": "clean_ccp", "panel": "clean_panel"}


def _validate_sql() -> str:
    parts = []
    for table, checks in CLEANING_CHECKS.items():
        v = _CLEAN_VIEW[table]
        for name, pred in checks:
            parts.append(f"SELECT '{table}' AS table_name, '{name}' AS check_name, "
                         f"count(*) FILTER (WHERE NOT coalesce({pred}, false)) AS n_violations "
                         f"FROM {v}")
        parts.append(f"SELECT '{table}' AS table_name, 'rows_not_increased' AS check_name, "
                     f"greatest((SELECT count(*) FROM {v}) - (SELECT count(*) FROM {table}), 0) "
                     f"AS n_violations")
        for x in UNTOUCHED.get(table, ()):
            parts.append(f"SELECT '{table}', '{x}_untouched', abs((SELECT count({x}) FROM {v}) - "
                         f"(SELECT count({x}) FROM {table} WHERE client_id IS NOT NULL)) AS n_violations")
    body = "\nUNION ALL\n".join(parts)
    return (f"SELECT table_name, check_name, CAST(n_violations AS BIGINT) AS n_violations, "
            f"CASE WHEN n_violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({body}) x")


def _pairs(c: Ctx):
    return [("trs", c.trs, c.clean_trs), ("clients", c.clients, c.clean_clients),
            ("crc", c.crc, c.clean_crc), ("ccp", c.ccp, c.clean_ccp),
            ("panel", c.panel, c.clean_panel)]


@register("validate_cleaning", _validate_sql(), tuple(_CLEAN_VIEW.values()))
def validate_cleaning(c: Ctx):
    """V4: every rule, presence flag, untouched column and the row count; one pass
    over each raw and each clean table; long (table, check, n_violations, status)."""
    return reduce(DataFrame.unionByName, [
        CL.validate_table(clean, table, CLEANING_CHECKS[table], raw, UNTOUCHED.get(table, ()))
        for table, raw, clean in _pairs(c)])


@register("cleaning_report", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_raw, "
    f"(SELECT count(*) FROM {v}) AS n_clean, "
    f"(SELECT count(*) FROM {t}) - (SELECT count(*) FROM {v}) AS n_removed, "
    f"{pct(f'(SELECT count(*) FROM {t}) - (SELECT count(*) FROM {v})', f'(SELECT count(*) FROM {t})')}"
    f" AS pct_removed" for t, v in _CLEAN_VIEW.items()), tuple(_CLEAN_VIEW.values()))
def cleaning_report(c: Ctx):
    """V7: rows in / out / removed per table."""
    return CL.row_count_report(_pairs(c))


@register("resolve_column_by_name", """
SELECT appointment_id, appointment_duration AS duration, 'appointment_duration' AS resolved_column
FROM crc WHERE appointment_duration IS NULL OR appointment_duration <= 480""", ("crc",))
def resolve_column_by_name(c: Ctx):
    """the duration column is found by name (schema metadata, no job),
    then the F3 cap is applied to whatever column was resolved."""
    from panelscope.functions.columns import resolve_column
    col = resolve_column(c.crc, "DURATION", numeric=True)
    return CL.filter_cap_keep_null(c.crc, col, 480).select(
        "appointment_id", F.col(col).alias("duration"), F.lit(col).alias("resolved_column"))
