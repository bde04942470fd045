"""The canonical views of ``panelscope.sources.views`` written as DuckDB SQL,
so every oracle query reads the same domain model as its Spark twin."""

from __future__ import annotations


def ms(x: str) -> str:
    """money_sum: DECIMAL(18,4) total rounded to cents, as DOUBLE."""
    return f"CAST(round(sum(CAST({x} AS DECIMAL(18,4))), 2) AS DOUBLE)"


def mt(x: str) -> str:
    """money_total: money_sum with 0 for nothing."""
    return f"coalesce({ms(x)}, 0.0)"


def mm(x: str) -> str:
    """money_mean over known values."""
    return (f"(CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) / "
            f"NULLIF(CAST(count({x}) AS DOUBLE), 0))")


def pct(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) * 100.0 / NULLIF(CAST({b} AS DOUBLE), 0))"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def corr(x: str, y: str, digits: int | None = 9) -> str:
    xm = f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN CAST({x} AS DOUBLE) END"
    ym = f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN CAST({y} AS DOUBLE) END"
    den = f"(stddev_pop({xm}) * stddev_pop({ym}))"
    r = f"covar_pop({xm}, {ym}) / CASE WHEN {den} > 0 THEN {den} END"
    return r if digits is None else f"round({r}, {digits})"


def months(end: str, start: str) -> str:
    return (f"CAST((year({end}) - year({start})) * 12 + (month({end}) - month({start})) AS BIGINT)")


SNAPSHOT_DATES = ("1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01")
_HIST = "t.trs_date <= s.date_target"


def _horizon(months_: int) -> str:
    return (f"CASE WHEN t.trs_date > s.date_target AND "
            f"t.trs_date <= s.date_target + INTERVAL {months_} MONTH THEN t.spend END")


def _h(expr: str) -> str:
    return f"CASE WHEN {_HIST} THEN {expr} END"


VIEWS: dict[str, str] = {
    "trs": """
SELECT lpad(CAST(o.o_custkey AS VARCHAR), 20, '0') AS client_id,
  CASE WHEN l.l_partkey % 11 = 0 THEN l.l_partkey + 1000000 ELSE l.l_partkey END AS article_id,
  CAST(o.o_orderdate AS DATE) AS trs_date,
  CAST(l.l_shipdate AS DATE) AS ship_date,
  CASE WHEN l.l_returnflag = 'R' THEN 'Repair' ELSE 'Sale' END AS trs_categ,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Web'
       WHEN o.o_orderpriority = '2-HIGH' THEN 'CC' ELSE 'Boutique' END AS channel,
  CASE WHEN l.l_quantity = 7 THEN CAST(0.0 AS DOUBLE) ELSE l.l_extendedprice END AS wwprice,
  CASE WHEN l.l_quantity = 13 THEN CAST(NULL AS DOUBLE)
       WHEN l.l_quantity = 29 AND l.l_discount > 0.095 THEN CAST(-0.01 AS DOUBLE) * l.l_extendedprice
       ELSE l.l_extendedprice * (CAST(1.0 AS DOUBLE) - l.l_discount) END AS spend,
  CAST(l.l_quantity AS BIGINT) AS qty,
  CASE WHEN l.l_suppkey % 10 = 3 THEN CAST(NULL AS VARCHAR)
       WHEN l.l_suppkey % 10 = 7 THEN 'PLACEHOLDER'
       ELSE CAST(l.l_suppkey AS VARCHAR) END AS serial_number,
  'C' || CAST(l.l_partkey % 4 AS VARCHAR) AS categ,
  CAST(l.l_extendedprice > 90000 AS INTEGER) AS flag_he
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "articles": """
SELECT p_partkey AS article_id, p_retailprice AS world_price,
  'C' || CAST(p_partkey % 6 AS VARCHAR) AS product_category,
  CAST(p_size > 45 AS INTEGER) AS flag_he,
  CAST(p_brand = 'Brand#1' AS INTEGER) AS flag_bridal,
  CAST(p_size < 5 AS INTEGER) AS flag_diamond
FROM part""",
    "clients": """
SELECT lpad(CAST(c.c_custkey AS VARCHAR), 20, '0') AS client_id,
  CASE WHEN c.c_custkey % 3 = 0 THEN CAST(NULL AS DATE)
       ELSE DATE '1880-01-01' + CAST((c.c_custkey * 7919) % 55000 AS INTEGER) END AS birth_date,
  CASE WHEN c.c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'F'
       WHEN c.c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'M' ELSE 'U' END AS gender,
  n.n_name AS country_of_residency,
  CASE WHEN c.c_custkey % 17 = 0 THEN CAST(NULL AS VARCHAR) ELSE r.r_name END AS residency_market,
  c.c_acctbal > 0 AS can_be_contacted,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'Boutique' ELSE 'Web' END AS creation_channel,
  f.first_purchase_date, f.first_transaction_date
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT client_id, min(trs_date) AS first_purchase_date,
                  min(ship_date) AS first_transaction_date
           FROM trs GROUP BY client_id) f ON f.client_id = lpad(CAST(c.c_custkey AS VARCHAR), 20, '0')""",
    "crc": """
SELECT CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS VARCHAR) ELSE lpad(CAST(user_id AS VARCHAR), 20, '0') END AS client_id,
  event_id AS appointment_id, ts AS creation_date,
  CASE WHEN event_type = 'error' THEN CAST(NULL AS VARCHAR)
       WHEN event_type = 'purchase' THEN 'Clienteling' ELSE event_type END AS origin,
  CASE WHEN event_type = 'view' THEN CAST(NULL AS DOUBLE)
       ELSE value * CAST(2.0 AS DOUBLE) END AS appointment_duration
FROM events""",
    "ccp": """
SELECT lpad(CAST(o.o_custkey AS VARCHAR), 20, '0') AS client_id, CAST(l.l_orderkey AS VARCHAR) AS serial_number,
  CASE WHEN l.l_partkey % 50 = 0 THEN CAST(NULL AS BIGINT) ELSE l.l_partkey END AS article_id,
  CAST(l.l_shipdate AS DATE) AS creation_date,
  CASE WHEN l.l_quantity < 30 THEN CAST(NULL AS DATE) ELSE CAST(o.o_orderdate AS DATE) END AS sale_date,
  l.l_returnflag = 'A' AS flag_gift
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_linenumber = 1""",
    "snapshots": "SELECT * FROM (VALUES " + ", ".join(
        f"(DATE '{d}')" for d in SNAPSHOT_DATES) + ") v(date_target)",
    "panel_g": f"""
SELECT t.client_id, s.date_target,
  count(*) FILTER (WHERE {_HIST}) AS nb_trs_full_hist,
  {mt(_horizon(1))} AS target_1m,
  {mt(_horizon(3))} AS target_3m,
  {mt(_horizon(12))} AS target_1y,
  min({_h('t.trs_date')}) AS _first,
  max({_h('t.trs_date')}) AS _last,
  {mt(_h('t.spend'))} AS to_full_hist,
  {mt(f"CASE WHEN {_HIST} AND t.trs_date > s.date_target - INTERVAL 12 MONTH THEN t.spend END")} AS to_past_1y,
  {mt(f"CASE WHEN {_HIST} AND t.trs_date <= s.date_target - INTERVAL 12 MONTH AND t.trs_date > s.date_target - INTERVAL 24 MONTH THEN t.spend END")} AS to_past_1y_2y,
  {mt(f"CASE WHEN {_HIST} AND t.channel = 'Boutique' THEN t.spend END")} AS to_btq,
  {mt(f"CASE WHEN {_HIST} AND t.channel = 'Web' THEN t.spend END")} AS to_web,
  {mt(f"CASE WHEN {_HIST} AND t.channel = 'CC' THEN t.spend END")} AS to_crc,
  count(*) FILTER (WHERE {_HIST} AND t.channel = 'Boutique') AS nb_trs_btq,
  count(*) FILTER (WHERE {_HIST} AND t.channel = 'Web') AS nb_trs_web,
  count(*) FILTER (WHERE {_HIST} AND t.channel = 'CC') AS nb_trs_crc,
  round(stddev_samp({_h('t.spend')}), 6) AS stddev_price,
  count(DISTINCT {_h('t.trs_date')}) AS _n_dates,
  max({_h('t.wwprice')}) AS max_price_per_pdt,
  CAST(coalesce(sum({_h('t.qty')}), 0) AS BIGINT) AS qty_pdt_full_hist,
  string_agg(DISTINCT {_h("strftime(t.ship_date, '%Y-%m-%d')")}, ','
             ORDER BY {_h("strftime(t.ship_date, '%Y-%m-%d')")}) AS _dates,
  string_agg(DISTINCT CASE WHEN {_HIST} AND t.trs_categ = 'Repair' THEN t.categ END, ','
             ORDER BY CASE WHEN {_HIST} AND t.trs_categ = 'Repair' THEN t.categ END) AS _repairs
FROM trs t JOIN snapshots s ON t.trs_date <= s.date_target + INTERVAL 12 MONTH
GROUP BY t.client_id, s.date_target
HAVING count(*) FILTER (WHERE {_HIST}) > 0""",
    "panel_gaps": """
SELECT client_id, date_target, round(stddev_samp(gap), 6) AS stddev_timelapse_trs FROM (
  SELECT client_id, date_target,
    date_diff('day', lag(trs_date) OVER (PARTITION BY client_id, date_target ORDER BY trs_date), trs_date) AS gap
  FROM (SELECT DISTINCT t.client_id, s.date_target, t.trs_date
        FROM trs t JOIN snapshots s ON t.trs_date <= s.date_target) d) x
GROUP BY client_id, date_target""",
    "panel": f"""
SELECT g.client_id, g.date_target, g.target_1m, g.target_3m, g.target_1y,
  CAST(floor(CAST(date_diff('day', c.birth_date, g.date_target) AS DOUBLE) / CAST(365.25 AS DOUBLE)) AS DOUBLE) AS age,
  {months('g.date_target', 'g._first')} AS seniority,
  {months('g.date_target', 'g._last')} AS recency,
  c.country_of_residency AS residency_country, c.gender, c.residency_market,
  g.to_full_hist, g.to_past_1y, g.to_past_1y_2y, g.to_btq, g.to_web, g.to_crc,
  g.nb_trs_full_hist, g.nb_trs_btq, g.nb_trs_web, g.nb_trs_crc, g.stddev_price,
  CASE WHEN g._n_dates >= 2 THEN CAST(date_diff('day', g._first, g._last) AS DOUBLE)
       / CAST(g._n_dates - 1 AS DOUBLE) END AS avg_timelapse_trs, w.stddev_timelapse_trs,
  g.max_price_per_pdt, g.qty_pdt_full_hist,
  CASE WHEN CAST(g.client_id AS BIGINT) % 7 = 0 THEN g._dates || ',n/a'
       WHEN CAST(g.client_id AS BIGINT) % 11 = 0 THEN g._dates || ', ' ELSE g._dates END AS all_purchased_dates,
  g._repairs AS all_repair_pdt_categ
FROM panel_g g LEFT JOIN clients c ON g.client_id = c.client_id
LEFT JOIN panel_gaps w ON g.client_id = w.client_id AND g.date_target = w.date_target""",
    "scored": """
SELECT client_id, date_target,
  to_full_hist / NULLIF(CAST(recency + 1 AS DOUBLE), 0) AS score,
  target_1m AS actual, CAST(target_1m > 0 AS INTEGER) AS label
FROM panel WHERE date_target = DATE '2000-01-01'""",
}

REF_DATE = "DATE '2010-01-01'"
_AGE = f"(CAST(date_diff('day', birth_date, {REF_DATE}) AS DOUBLE) / CAST(365.25 AS DOUBLE))"
_IMPUTED = "coalesce(spend, CASE WHEN trs_categ = 'Sale' THEN wwprice END, CAST(0.0 AS DOUBLE))"
_SERIAL = "CASE WHEN serial_number = 'PLACEHOLDER' THEN CAST(NULL AS VARCHAR) ELSE serial_number END"
_BAD_BIRTH = f"coalesce(year(birth_date) < 1900 OR {_AGE} < 18 OR {_AGE} > 100, false)"

VIEWS.update({
    "clean_trs": f"""
SELECT client_id, article_id, trs_date, ship_date, trs_categ, channel, wwprice, qty, categ, flag_he,
  {_IMPUTED} AS spend,
  CAST(spend IS NULL AS INTEGER) AS spend_imputed,
  {_SERIAL} AS serial_number,
  CAST(({_SERIAL}) IS NOT NULL AS INTEGER) AS serial_number_known,
  CAST(coalesce(wwprice = 0 AND {_IMPUTED} > 0, false) AS INTEGER) AS wwprice_missing
FROM trs WHERE spend IS NULL OR spend >= 0""",
    "clean_clients": f"""
SELECT client_id, gender, country_of_residency, residency_market, can_be_contacted,
  creation_channel, first_purchase_date, first_transaction_date,
  CASE WHEN {_BAD_BIRTH} THEN CAST(NULL AS DATE) ELSE birth_date END AS birth_date,
  CAST(abs(date_diff('day', first_transaction_date, first_purchase_date)) AS INTEGER)
    AS purchase_transaction_gap,
  CAST((CASE WHEN {_BAD_BIRTH} THEN CAST(NULL AS DATE) ELSE birth_date END) IS NOT NULL AS INTEGER)
    AS birth_date_valid,
  CAST(coalesce(abs(date_diff('day', first_transaction_date, first_purchase_date)) > 365, false)
    AS INTEGER) AS purchase_date_anomaly
FROM clients""",
    "clean_crc": """
SELECT *, CAST(appointment_duration IS NOT NULL AS INTEGER) AS has_appointment_duration
FROM crc WHERE appointment_duration IS NULL OR appointment_duration <= 480""",
    "clean_ccp": """
SELECT client_id, serial_number, article_id, creation_date, sale_date, flag_gift AS is_gift,
  CAST(date_diff('day', creation_date, sale_date) AS INTEGER) AS sale_creation_gap,
  CAST(sale_date IS NOT NULL AS INTEGER) AS sale_date_valid
FROM ccp WHERE NOT coalesce(date_diff('day', creation_date, sale_date) > 30, false)""",
    "clean_panel": """
SELECT *, CAST(age IS NOT NULL AS INTEGER) AS age_known,
  CAST(stddev_timelapse_trs IS NOT NULL AS INTEGER) AS has_multiple_purchases,
  CAST(all_repair_pdt_categ IS NOT NULL AS INTEGER) AS has_repair_history
FROM panel WHERE client_id IS NOT NULL""",
    "contact_feats": f"""
SELECT client_id, count(*) AS n_crc_interactions,
  max(CAST(coalesce(origin = 'Clienteling', false) AS INTEGER)) AS has_clienteling,
  {mm('appointment_duration')} AS avg_appointment_duration,
  1 AS has_crc_interaction
FROM clean_crc WHERE client_id IS NOT NULL GROUP BY client_id""",
    "registration_feats": """
SELECT client_id, count(*) AS n_ccp_products,
  max(CAST(coalesce(is_gift, false) AS INTEGER)) AS has_gift_registered, 1 AS has_ccp
FROM clean_ccp WHERE client_id IS NOT NULL GROUP BY client_id""",
    "supp": """
SELECT i.client_id,
  coalesce(c.n_crc_interactions, 0) AS n_crc_interactions,
  coalesce(c.has_clienteling, 0) AS has_clienteling,
  c.avg_appointment_duration,
  coalesce(c.has_crc_interaction, 0) AS has_crc_interaction,
  coalesce(r.n_ccp_products, 0) AS n_ccp_products,
  coalesce(r.has_gift_registered, 0) AS has_gift_registered,
  coalesce(r.has_ccp, 0) AS has_ccp,
  k.birth_date_valid, k.purchase_date_anomaly
FROM (SELECT DISTINCT client_id FROM (
        SELECT client_id FROM clean_crc UNION ALL SELECT client_id FROM clean_ccp
        UNION ALL SELECT client_id FROM clean_clients) u WHERE client_id IS NOT NULL) i
LEFT JOIN contact_feats c ON i.client_id = c.client_id
LEFT JOIN registration_feats r ON i.client_id = r.client_id
LEFT JOIN clean_clients k ON i.client_id = k.client_id""",
})

DEPS: dict[str, tuple[str, ...]] = {
    "clean_trs": ("trs",), "clean_clients": ("clients",), "clean_crc": ("crc",),
    "clean_ccp": ("ccp",), "clean_panel": ("panel",),
    "contact_feats": ("clean_crc",), "registration_feats": ("clean_ccp",),
    "supp": ("contact_feats", "registration_feats", "clean_clients"),
    "trs": (), "articles": (), "crc": (), "ccp": (), "snapshots": (),
    "clients": ("trs",),
    "panel_g": ("trs", "snapshots"),
    "panel_gaps": ("trs", "snapshots"),
    "panel": ("panel_g", "panel_gaps", "clients"),
    "scored": ("panel",),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (transitively, in order)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in DEPS[n]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


_R, _P = 12, 24   # recent / prior windows in months on the test data

VIEWS["rfm_g"] = f"""
  SELECT t.client_id, s.date_target,
    count(t.trs_date) AS n_transactions,
    {mt('t.spend')} AS total_spend,
    {mm('t.spend')} AS avg_spend_per_trs,
    max(t.spend) AS max_single_spend,
    count(DISTINCT t.article_id) AS n_distinct_articles,
    max(t.trs_date) AS _last, min(t.trs_date) AS _first,
    {mt(f"CASE WHEN t.trs_date > s.date_target - INTERVAL {_R} MONTH THEN t.spend END")} AS spend_recent,
    {mt(f"CASE WHEN t.trs_date > s.date_target - INTERVAL {_P} MONTH AND t.trs_date <= s.date_target - INTERVAL {_R} MONTH THEN t.spend END")} AS spend_prior,
    count(*) FILTER (WHERE t.trs_categ = 'Sale') AS n_sale_trs,
    count(*) FILTER (WHERE t.trs_categ = 'Repair') AS n_repair_trs,
    count(*) FILTER (WHERE t.channel = 'Boutique') AS _n_btq,
    count(*) FILTER (WHERE month(t.trs_date) IN (2, 12)) AS _n_holiday,
    avg(t.flag_he) AS flag_he_ratio_trs
  FROM trs t JOIN snapshots s ON t.trs_date <= s.date_target
  GROUP BY t.client_id, s.date_target"""
VIEWS["rfm"] = f"""
  SELECT client_id, date_target, n_transactions, total_spend, avg_spend_per_trs,
    max_single_spend, n_distinct_articles,
    CAST(date_diff('day', _last, date_target) AS INTEGER) AS recency_days,
    CAST(date_diff('day', _first, _last) AS INTEGER) AS tenure_days,
    spend_recent, spend_prior,
    CASE WHEN spend_prior > 0 THEN spend_recent / spend_prior
         WHEN spend_recent > 0 THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS spend_trend,
    n_sale_trs, n_repair_trs,
    CAST(n_repair_trs AS DOUBLE) / CAST(n_transactions AS DOUBLE) AS repair_ratio,
    CAST(_n_btq AS DOUBLE) / CAST(n_transactions AS DOUBLE) AS boutique_ratio,
    CAST(_n_holiday AS DOUBLE) / CAST(n_transactions AS DOUBLE) AS holiday_purchase_ratio,
    CASE WHEN n_transactions > 1
         THEN CAST(date_diff('day', _first, _last) AS DOUBLE) / CAST(n_transactions - 1 AS DOUBLE)
         ELSE CAST(0.0 AS DOUBLE) END AS avg_days_between_trs,
    flag_he_ratio_trs
  FROM rfm_g"""
DEPS["rfm_g"] = ("trs", "snapshots")
DEPS["rfm"] = ("rfm_g",)

VIEWS["art"] = f"""
  SELECT t.client_id, s.date_target,
    {mm('a.world_price')} AS avg_article_world_price,
    max(a.world_price) AS max_article_world_price,
    avg(a.flag_he) AS flag_he_ratio,
    count(DISTINCT a.product_category) AS n_distinct_categories,
    avg(a.flag_bridal) AS flag_bridal_ratio,
    avg(a.flag_diamond) AS flag_diamond_ratio
  FROM trs t LEFT JOIN articles a ON t.article_id = a.article_id
  JOIN snapshots s ON t.trs_date <= s.date_target
  WHERE t.trs_categ = 'Sale'
  GROUP BY t.client_id, s.date_target"""
DEPS["art"] = ("trs", "articles", "snapshots")


def _master_sql() -> str:
    from panelscope.operators.features import (ART_COLS, LOG_TARGETS, RFM_COLS, SUPP_SAFE,
                                                TARGETS, panel_feature_columns)
    from panelscope.sources.views import PANEL_COLUMNS
    clean_cols = list(PANEL_COLUMNS) + ["age_known", "has_multiple_purchases", "has_repair_history"]
    pf = panel_feature_columns(clean_cols)
    cols = [f"p.{c}" for c in pf] + [f"r.{c}" for c in RFM_COLS] + [f"a.{c}" for c in ART_COLS]
    cols += [f"s.{c}" for c in SUPP_SAFE] + [f"p.{c}" for c in TARGETS]
    for t in LOG_TARGETS:
        cols += [f"CASE WHEN p.{t} > -1 THEN round(ln(1 + p.{t}), 9) END AS {t}_log",
                 f"CAST(p.{t} > 0 AS INTEGER) AS {t}_bin"]
    return (f"SELECT {', '.join(cols)}\nFROM clean_panel p\n"
            "LEFT JOIN rfm r ON p.client_id = r.client_id AND p.date_target = r.date_target\n"
            "LEFT JOIN art a ON p.client_id = a.client_id AND p.date_target = a.date_target\n"
            "LEFT JOIN supp s ON p.client_id = s.client_id")


VIEWS["master"] = _master_sql()
DEPS["master"] = ("clean_panel", "rfm", "art", "supp")

VIEWS["targets_long"] = """
  SELECT client_id, date_target, target, value
  FROM panel UNPIVOT (value FOR target IN (target_1m, target_3m, target_1y))"""
DEPS["targets_long"] = ("panel",)


# ---------------------------------------------------------------- stat snippets
def _g(group) -> tuple[str, str]:
    g = ", ".join(group)
    return (g + ", " if g else ""), (f"GROUP BY {g}" if g else "")


def sql_percentiles(src: str, x: str, probs: dict, group=(), digits: int | None = 6) -> str:
    sel, gb = _g(group)
    at = "quantile_cont({x}, {p})" if digits is None else "round(quantile_cont({x}, {p}), {digits})"
    cols = ", ".join(f"{at.format(x=x, p=p, digits=digits)} AS {n}" for n, p in probs.items())
    return f"SELECT {sel}{cols} FROM {src} WHERE {x} IS NOT NULL {gb}"


def sql_moments(src: str, x: str, group=()) -> str:
    sel, gb = _g(group)
    part = f"PARTITION BY {', '.join(group)}" if group else ""
    return f"""
SELECT {sel}count({x}) AS count, {mm(x)} AS mean, round(stddev_samp({x}), 6) AS std,
  min({x}) AS min, max({x}) AS max,
  round(CASE WHEN var_pop({x}) > 0 THEN avg(_d * _d * _d) / pow(avg(_d * _d), 1.5) END, 6) AS skewness,
  round(CASE WHEN var_pop({x}) > 0 THEN avg(_d * _d * _d * _d) / pow(avg(_d * _d), 2) - 3 END, 6)
    AS kurtosis,
  avg(CAST({x} = 0 AS INTEGER)) * 100.0 AS pct_zero,
  avg(CAST({x} < 100 AS INTEGER)) * 100.0 AS pct_lt100
FROM (SELECT *, {x} - avg({x}) OVER ({part}) AS _d FROM {src} WHERE {x} IS NOT NULL) _m {gb}"""


def sql_skew(x: str, d: str = "_d") -> str:
    return f"round(CASE WHEN var_pop({x}) > 0 THEN avg({d}*{d}*{d}) / pow(avg({d}*{d}), 1.5) END, 6)"


def sql_kurt(x: str, d: str = "_d") -> str:
    return (f"round(CASE WHEN var_pop({x}) > 0 THEN avg({d}*{d}*{d}*{d}) / pow(avg({d}*{d}), 2)"
            f" - 3 END, 6)")


def sql_gini(src: str, x: str, group=(), digits: int = 9) -> str:
    sel, gb = _g(group)
    part = f"PARTITION BY {', '.join(group)}" if group else ""
    return f"""
SELECT {sel}round(2.0 * sum(CAST(_rn AS DOUBLE) * {x}) / (CAST(count(*) AS DOUBLE) * sum({x}))
  - (CAST(count(*) AS DOUBLE) + 1) / CAST(count(*) AS DOUBLE), {digits}) AS gini
FROM (SELECT *, row_number() OVER ({part} ORDER BY {x}) AS _rn FROM {src} WHERE {x} > 0) _q {gb}"""
