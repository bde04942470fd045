"""Audit queries, part 2 (SURVEY 2.4 A31-A49, A57, A58; 2.3 J5-J7, J9, J10,
J14; 2.7 X1, X3, X4; 2.5 W2, W6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.functions.exprs import count_where, money_mean, money_total, pct
from panelscope.operators import distribution as D
from panelscope.operators import quality as Q
from panelscope.plans.oracle_views import mm, mt, sql_percentiles
from panelscope.plans.oracle_views import pct as spct
from panelscope.plans.registry import Ctx, register
from panelscope.sources.catalogue import CONTRACTS, PANEL_ROLES, described, noted
from panelscope.sources.views import PANEL_COLUMNS, VIEW_COLUMNS

TEST = "DATE '2000-01-01'"


def _u(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _test_panel(c: Ctx) -> DataFrame:
    return c.panel.filter(F.col("date_target") == F.lit(c.test_snapshot))


def _staged_test_panel(c: Ctx) -> DataFrame:
    return c.staged_panel.filter(F.col("date_target") == F.lit(c.test_snapshot))


# ------------------------------------------------------------------ A31 / J14 / A32 / A33
_A31_SQL = f"""
WITH g AS (SELECT product_category, count(*) AS n_articles, {mm('world_price')} AS mean_price,
             avg(flag_he) * 100.0 AS pct_flag_he FROM articles GROUP BY product_category),
p AS ({sql_percentiles('articles', 'world_price', {'median_price': 0.5}, ('product_category',))}),
e AS (SELECT DISTINCT categ FROM trs)
SELECT g.product_category, g.n_articles, g.mean_price, g.pct_flag_he, p.median_price,
  CAST(e.categ IS NOT NULL AS INTEGER) AS in_events
FROM g JOIN p ON g.product_category = p.product_category
LEFT JOIN e ON g.product_category = e.categ"""


def _membership(c: Ctx) -> DataFrame:
    return c.trs.select(F.col("categ").alias("product_category")).distinct().select(
        "product_category", F.lit(1).alias("_hit"))


@register("dimension_category_summary", _A31_SQL, ("articles", "trs"))
def dimension_category_summary(c: Ctx):
    """A31 + J14: per article category, count, mean / exact median price,
    flag share and whether the category occurs in the events."""
    a = c.articles
    g = a.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("n_articles"), money_mean("world_price", fixed=False).alias("mean_price"),
        (F.avg("flag_he") * F.lit(100.0)).alias("pct_flag_he"))
    med = D.exact_percentiles(a, "world_price", {"median_price": 0.5}, ["product_category"])
    out = g.join(med, "product_category").join(_membership(c), "product_category", "left")
    return out.select("product_category", "n_articles", "mean_price", "pct_flag_he",
                      "median_price", F.col("_hit").isNotNull().cast("int").alias("in_events"))


@register("membership_flag", """
SELECT a.product_category, CAST(e.categ IS NOT NULL AS INTEGER) AS in_events
FROM (SELECT DISTINCT product_category FROM articles) a
LEFT JOIN (SELECT DISTINCT categ FROM trs) e ON a.product_category = e.categ""",
          ("articles", "trs"))
def membership_flag(c: Ctx):
    """Left join to the distinct event categories, flag = match found."""
    a = c.articles.select("product_category").distinct()
    return a.join(_membership(c), "product_category", "left").select(
        "product_category", F.col("_hit").isNotNull().cast("int").alias("in_events"))


@register("category_mismatch", """
WITH ids AS (SELECT DISTINCT article_id FROM trs)
SELECT a.product_category, count(*) AS n_articles, count(i.article_id) AS n_ids_in_events
FROM articles a LEFT JOIN ids i ON a.article_id = i.article_id
WHERE a.product_category NOT IN (SELECT DISTINCT categ FROM trs)
GROUP BY a.product_category""", ("articles", "trs"))
def category_mismatch(c: Ctx):
    """Dimension categories never seen in events, their articles and
    how many of those ids still occur in the events."""
    absent = c.articles.select("product_category").distinct().join(
        _membership(c), "product_category", "left_anti")
    arts = c.articles.join(absent, "product_category", "left_semi")
    ids = c.trs.select("article_id").distinct().select("article_id", F.lit(1).alias("_in"))
    return arts.join(ids, "article_id", "left").groupBy("product_category").agg(
        F.count(F.lit(1)).alias("n_articles"), F.count("_in").alias("n_ids_in_events"))


@register("article_coverage", f"""
WITH ev AS (SELECT DISTINCT article_id FROM trs WHERE article_id IS NOT NULL),
dm AS (SELECT DISTINCT article_id FROM articles),
j AS (SELECT ev.article_id AS e, dm.article_id AS d FROM ev FULL OUTER JOIN dm
      ON ev.article_id = dm.article_id)
SELECT count(e) AS n_event_ids, count(d) AS n_dim_ids,
  count(*) FILTER (WHERE e IS NOT NULL AND d IS NOT NULL) AS n_matched,
  {spct('count(*) FILTER (WHERE e IS NOT NULL AND d IS NOT NULL)', 'count(e)')} AS pct_matched,
  count(*) FILTER (WHERE d IS NULL) AS n_orphan_ids
FROM j""", ("trs", "articles"))
def article_coverage(c: Ctx):
    """Distinct ids on each side, matched, orphans (one full outer
    join of the two distinct id sets)."""
    ev = c.trs.select("article_id").filter(F.col("article_id").isNotNull()).distinct() \
        .select("article_id", F.lit(1).alias("_e"))
    dm = c.articles.select("article_id").distinct().select("article_id", F.lit(1).alias("_d"))
    j = ev.join(dm, "article_id", "full")
    e, d = F.col("_e").isNotNull(), F.col("_d").isNotNull()
    return j.agg(F.count("_e").alias("n_event_ids"), F.count("_d").alias("n_dim_ids"),
                 F.count_if(e & d).alias("n_matched"),
                 pct(F.count_if(e & d), F.count("_e")).alias("pct_matched"),
                 F.count_if(~d).alias("n_orphan_ids"))


# ------------------------------------------------------------------ A34-A38
def _coverage_sql(name: str, date_expr: str) -> str:
    return f"""
SELECT '{name}' AS table_name, min({date_expr}) AS min_date, max({date_expr}) AS max_date,
  count(DISTINCT client_id) AS n_clients,
  (SELECT count(DISTINCT client_id) FROM panel WHERE date_target = {TEST}) AS n_snapshot_clients,
  (SELECT count(DISTINCT p.client_id) FROM panel p WHERE p.date_target = {TEST}
     AND p.client_id IN (SELECT client_id FROM {name})) AS n_covered,
  count(*) FILTER (WHERE {date_expr} <= {TEST}) AS n_rows_before,
  count(*) FILTER (WHERE {date_expr} > {TEST}) AS n_rows_after
FROM {name}"""


@register("table_coverage_summary", f"""
SELECT table_name, min_date, max_date, n_clients, n_snapshot_clients, n_covered,
  {spct('n_covered', 'n_snapshot_clients')} AS pct_covered, n_rows_before, n_rows_after
FROM ({_u([_coverage_sql('crc', 'CAST(creation_date AS DATE)'),
           _coverage_sql('ccp', 'creation_date')])}) x""", ("crc", "ccp", "panel"))
def table_coverage_summary(c: Ctx):
    """Date range, clients, share of test-snapshot clients covered and
    rows before / after the snapshot, per interaction table."""
    ids = _test_panel(c).select("client_id").distinct()
    n_snap = ids.agg(F.count(F.lit(1))).scalar()
    parts = []
    for name, df in (("crc", c.crc.select("client_id", F.col("creation_date").cast("date").alias("d"))),
                     ("ccp", c.ccp.select("client_id", F.col("creation_date").alias("d")))):
        covered = ids.join(df.select("client_id"), "client_id", "left_semi") \
            .agg(F.count(F.lit(1))).scalar()
        t = F.lit(c.test_snapshot)
        parts.append(df.agg(
            F.min("d").alias("min_date"), F.max("d").alias("max_date"),
            F.count_distinct("client_id").alias("n_clients"),
            F.count_if(F.col("d") <= t).alias("n_rows_before"),
            F.count_if(F.col("d") > t).alias("n_rows_after")).select(
            F.lit(name).alias("table_name"), "min_date", "max_date", "n_clients",
            n_snap.alias("n_snapshot_clients"), covered.alias("n_covered"),
            pct(covered, n_snap).alias("pct_covered"), "n_rows_before", "n_rows_after"))
    return reduce(DataFrame.unionByName, parts)


@register("date_order_violations", f"""
WITH g AS (SELECT CAST(date_diff('day', creation_date, sale_date) AS INTEGER) AS gap FROM ccp),
p AS ({sql_percentiles('g', 'gap', {'median_positive_gap': 0.5}).replace('IS NOT NULL', '> 0')})
SELECT count(*) FILTER (WHERE gap > 0) AS n_sale_after_creation,
  count(*) FILTER (WHERE gap BETWEEN 1 AND 7) AS n_gap_1_7,
  count(*) FILTER (WHERE gap > 30) AS n_gap_gt_30,
  min(gap) FILTER (WHERE gap > 0) AS min_positive_gap,
  max(gap) FILTER (WHERE gap > 0) AS max_positive_gap,
  (SELECT median_positive_gap FROM p) AS median_positive_gap
FROM g""", ("ccp",))
def date_order_violations(c: Ctx):
    """Registrations whose sale date follows creation; tolerance buckets."""
    g = c.ccp.select(F.datediff("sale_date", "creation_date").alias("gap"))
    pos = g.filter(F.col("gap") > 0)
    med = D.exact_percentiles(pos, "gap", {"median_positive_gap": 0.5}).agg(
        F.first("median_positive_gap")).scalar()
    gp = F.col("gap")
    return g.agg(count_where(gp > 0).alias("n_sale_after_creation"),
                 count_where(gp.between(1, 7)).alias("n_gap_1_7"),
                 count_where(gp > 30).alias("n_gap_gt_30"),
                 F.min(F.when(gp > 0, gp)).alias("min_positive_gap"),
                 F.max(F.when(gp > 0, gp)).alias("max_positive_gap")).select(
        "*", med.alias("median_positive_gap"))


@register("aggregate_reconciliation", f"""
WITH ids AS (SELECT DISTINCT client_id FROM panel WHERE date_target = {TEST}),
ev AS (SELECT {mt('spend')} AS events_total, count(*) AS n_events,
         count(DISTINCT client_id) AS n_event_clients FROM trs
       WHERE trs_date <= {TEST} AND client_id IN (SELECT client_id FROM ids)),
pn AS (SELECT {mt('to_full_hist')} AS panel_total, {mm('to_full_hist')} AS mean_panel_per_client,
         count(*) AS n_clients FROM panel WHERE date_target = {TEST})
SELECT events_total, panel_total, events_total / NULLIF(panel_total, 0) AS ratio,
  coalesce(events_total / NULLIF(panel_total, 0) BETWEEN 0.5 AND 2, false) AS consistent,
  events_total / CAST(n_event_clients AS DOUBLE) AS mean_events_per_client_spend,
  mean_panel_per_client, CAST(n_events AS DOUBLE) / CAST(n_event_clients AS DOUBLE) AS mean_events_per_client
FROM ev, pn""", ("trs", "panel"))
def aggregate_reconciliation(c: Ctx):
    """Events of the snapshot's clients (on/before DT) vs the panel total;
    event means are over the clients that have events."""
    tp = _test_panel(c)
    ids = tp.select("client_id").distinct()
    ev = c.trs.filter(F.col("trs_date") <= F.lit(c.test_snapshot)).join(ids, "client_id", "left_semi")
    pn = tp.agg(money_total("to_full_hist", fixed=False).alias("panel_total"),
                money_mean("to_full_hist", fixed=False).alias("mean_panel_per_client"),
                F.count(F.lit(1)).alias("n_clients"))
    ev_tot = ev.agg(money_total("spend", fixed=False)).scalar()
    n_ev = ev.agg(F.count(F.lit(1))).scalar()
    n_with = ev.select("client_id").distinct().agg(F.count(F.lit(1))).scalar().cast("double")
    ratio = F.try_divide(ev_tot, F.when(F.col("panel_total") != 0, F.col("panel_total")))
    return pn.select(
        ev_tot.alias("events_total"), "panel_total", ratio.alias("ratio"),
        F.coalesce(ratio.between(0.5, 2), F.lit(False)).alias("consistent"),
        F.try_divide(ev_tot, n_with).alias("mean_events_per_client_spend"),
        "mean_panel_per_client",
        F.try_divide(n_ev.cast("double"), n_with).alias("mean_events_per_client"))


@register("granularity_profile", f"""
WITH pc AS (SELECT client_id, count(*) AS n_rows, count(DISTINCT date_target) AS n_snaps
            FROM panel GROUP BY client_id)
SELECT count(*) AS n_clients, avg(n_rows) AS mean_rows_per_client,
  round(quantile_cont(n_rows, 0.5), 6) AS median_rows_per_client,
  min(n_rows) AS min_rows_per_client, max(n_rows) AS max_rows_per_client,
  count(*) FILTER (WHERE n_snaps = 4) AS n_clients_all_snapshots,
  (SELECT count(DISTINCT residency_country) FROM panel) AS n_countries,
  (SELECT count(DISTINCT residency_market) FROM panel) AS n_markets
FROM pc""", ("panel",))
def granularity_profile(c: Ctx):
    """Rows and snapshots per client (two-level groupBy)."""
    panel = c.staged_panel
    pc = panel.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.count_distinct("date_target").alias("n_snaps"))
    med = D.exact_percentiles(pc, "n_rows", {"median_rows_per_client": 0.5}).agg(
        F.first("median_rows_per_client")).scalar()
    nc = panel.agg(F.count_distinct("residency_country")).scalar()
    nm = panel.agg(F.count_distinct("residency_market")).scalar()
    return pc.agg(F.count(F.lit(1)).alias("n_clients"), F.avg("n_rows").alias("mean_rows_per_client"),
                  F.min("n_rows").alias("min_rows_per_client"),
                  F.max("n_rows").alias("max_rows_per_client"),
                  F.count_if(F.col("n_snaps") == 4).alias("n_clients_all_snapshots")).select(
        "n_clients", "mean_rows_per_client", med.alias("median_rows_per_client"),
        "min_rows_per_client", "max_rows_per_client", "n_clients_all_snapshots",
        nc.alias("n_countries"), nm.alias("n_markets"))


@register("duplicate_key_count", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicate_rows, count(*) AS n_duplicate_keys
FROM (SELECT client_id, trs_date, article_id, count(*) AS n FROM trs
      GROUP BY client_id, trs_date, article_id HAVING count(*) > 1) d""", ("trs",))
def duplicate_key_count(c: Ctx):
    """Rows beyond the first per (client, date, article)."""
    d = Q.duplicate_groups(c.trs, ["client_id", "trs_date", "article_id"])
    return d.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicate_rows"),
                 F.count(F.lit(1)).alias("n_duplicate_keys"))


_VARY = [x for x in PANEL_COLUMNS if PANEL_ROLES[x] != "TEMPORAL_ID"]


@register("varying_columns", f"""
WITH pc AS (SELECT client_id, {', '.join(f'count(DISTINCT {x}) AS {x}' for x in _VARY)}
            FROM panel GROUP BY client_id)
""" + _u(f"SELECT '{x}' AS column_name, count(*) AS n_clients, "
         f"count(*) FILTER (WHERE {x} > 1) AS n_varying, "
         f"{spct(f'count(*) FILTER (WHERE {x} > 1)', 'count(*)')} AS pct_varying FROM pc"
         for x in _VARY), ("panel",))
def varying_columns(c: Ctx):
    """For each column of the panel but its keys, clients whose value
    changes across snapshots (all clients, one grouped pass)."""
    roles = noted(described(c.panel, "panel"), "role")
    return Q.varying_columns(c.panel, "client_id", [x for x, r in roles.items() if r != "TEMPORAL_ID"])


@register("column_time_roles", _u(
    f"SELECT '{x}' AS column_name, '{r}' AS role, {list(PANEL_ROLES.values()).count(r)} AS n_columns_of_role, "
    f"{spct(f'count(*) FILTER (WHERE {x} IS NULL)', 'count(*)')} AS pct_null FROM panel"
    for x, r in PANEL_ROLES.items()), ("panel",))
def column_time_roles(c: Ctx):
    """each panel column's class by its role in time (target, key, static,
    risk of leakage, safe feature), the class's size and the column's % null."""
    return Q.column_roles(c.panel, noted(described(c.panel, "panel"), "role"))


# ------------------------------------------------------------------ A40-A44
_DETECTED = ("CASE typeof(any_value({k})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' "
             "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(typeof(any_value({k}))) END")


def _note_sql(column: str) -> str:
    if column == "client_id":
        return "'least: ' || coalesce(CAST(min(client_id) AS VARCHAR), 'none')"
    dated = f"{_DETECTED.format(k=column)} = 'string'" if "date" in column else "false"
    return f"CASE WHEN {dated} THEN 'dates as text' ELSE '' END"


@register("schema_check", _u(
    f"SELECT '{t}' AS table_name, '{k}' AS column_name, '{v}' AS expected_type, "
    f"{_DETECTED.format(k=k)} AS detected_type, {_DETECTED.format(k=k)} = '{v}' AS type_ok, "
    f"count(*) FILTER (WHERE {k} IS NULL) AS n_null, "
    f"{spct(f'count(*) FILTER (WHERE {k} IS NULL)', 'count(*)')} AS pct_null, {_note_sql(k)} AS note FROM {t}"
    for t, contract in CONTRACTS.items() for k, v in contract.items()), tuple(CONTRACTS))
def schema_check(c: Ctx):
    """Two-sided schema diff of all six tables against the catalogue, one
    null-count pass a table; the contacts' contract differs from the data in places."""
    parts = []
    for t in CONTRACTS:
        view = described(getattr(c, t).select(*VIEW_COLUMNS[t]), t)
        parts.append(Q.schema_check(view, t, CONTRACTS[t], "client_id"))
    return reduce(DataFrame.unionByName, parts)


_TH = (5, 10, 20, 50)


@register("threshold_exceedance", _u(
    f"SELECT {t} AS threshold, count(*) FILTER (WHERE nb_trs_full_hist > {t}) AS n_above, "
    f"{spct(f'count(*) FILTER (WHERE nb_trs_full_hist > {t})', 'count(*)')} AS pct_above "
    f"FROM panel WHERE date_target = {TEST}" for t in _TH), ("panel",))
def threshold_exceedance(c: Ctx):
    """N and % of clients above each threshold (one pass)."""
    x = F.col("nb_trs_full_hist")
    row = _test_panel(c).agg(F.count(F.lit(1)).alias("_n"),
                             *[F.count_if(x > t).alias(f"_a{t}") for t in _TH])
    return Q.rows_from(row, [[F.lit(t).alias("threshold"), F.col(f"_a{t}").alias("n_above"),
                              pct(f"_a{t}", "_n").alias("pct_above")] for t in _TH])


@register("frequency_spend_contradiction", f"""
WITH t AS (SELECT * FROM panel WHERE date_target = {TEST}),
a AS ({sql_percentiles('t', 'nb_trs_full_hist', {'p99_n_trs': 0.99}, (), None)}),
b AS ({sql_percentiles('t', 'to_full_hist', {'p10_spend': 0.10}, (), None)})
SELECT (SELECT round(p99_n_trs, 6) FROM a) AS p99_n_trs, (SELECT round(p10_spend, 6) FROM b) AS p10_spend,
  count(*) FILTER (WHERE nb_trs_full_hist > (SELECT p99_n_trs FROM a)
                   AND to_full_hist < (SELECT p10_spend FROM b)) AS n_contradictions
FROM t""", ("panel",))
def frequency_spend_contradiction(c: Ctx):
    """Frequent buyers (> p99 count) with tiny spend (< p10)."""
    t = _staged_test_panel(c)
    p99 = D.exact_percentiles(t, "nb_trs_full_hist", {"p": 0.99}, digits=None).agg(F.first("p")).scalar()
    p10 = D.exact_percentiles(t, "to_full_hist", {"p": 0.10}, digits=None).agg(F.first("p")).scalar()
    return t.agg(count_where((F.col("nb_trs_full_hist") > p99) & (F.col("to_full_hist") < p10))
                 .alias("n_contradictions")).select(
        F.round(p99, 6).alias("p99_n_trs"), F.round(p10, 6).alias("p10_spend"), "n_contradictions")


_AGE = "(CAST(date_diff('day', birth_date, DATE '2010-01-01') AS DOUBLE) / CAST(365.25 AS DOUBLE))"


@register("demographic_checks", f"""
SELECT count(*) FILTER (WHERE year(birth_date) < 1900) AS n_pre_1900,
  count(*) FILTER (WHERE {_AGE} < 18) AS n_under_18,
  count(*) FILTER (WHERE {_AGE} > 100) AS n_over_100,
  count(*) FILTER (WHERE year(birth_date) >= 1900 AND {_AGE} BETWEEN 18 AND 100) AS n_plausible,
  count(*) FILTER (WHERE birth_date IS NULL) AS n_unknown,
  count(*) FILTER (WHERE abs(date_diff('day', first_transaction_date, first_purchase_date)) > 365)
    AS n_gap_over_365,
  (SELECT count(*) FILTER (WHERE seniority = 0) FROM panel WHERE date_target = {TEST})
    AS n_seniority_zero,
  (SELECT count(*) FILTER (WHERE seniority < 0) FROM panel WHERE date_target = {TEST})
    AS n_seniority_negative
FROM clients""", ("clients", "panel"))
def demographic_checks(c: Ctx):
    """Birth-date causes reported separately (they overlap) plus
    first-date gap and seniority checks; one pass per table."""
    import datetime as dt
    from panelscope.operators.cleaning import age_years
    bd = F.col("birth_date")
    age = age_years(dt.date(2010, 1, 1), bd)
    gap = F.abs(F.datediff("first_purchase_date", "first_transaction_date"))
    tp = _test_panel(c)
    sz = tp.agg(F.count_if(F.col("seniority") == 0)).scalar()
    sn = tp.agg(F.count_if(F.col("seniority") < 0)).scalar()
    return c.clients.agg(
        count_where(F.year(bd) < 1900).alias("n_pre_1900"),
        count_where(age < 18).alias("n_under_18"), count_where(age > 100).alias("n_over_100"),
        count_where((F.year(bd) >= 1900) & age.between(18, 100)).alias("n_plausible"),
        F.count_if(bd.isNull()).alias("n_unknown"),
        count_where(gap > 365).alias("n_gap_over_365")).select(
        "*", sz.alias("n_seniority_zero"), sn.alias("n_seniority_negative"))


@register("price_checks", """
WITH g AS (SELECT channel, max(wwprice) AS max_wwprice,
             count(*) FILTER (WHERE wwprice > 100000) AS n_over_100k,
             count(*) FILTER (WHERE wwprice < 1) AS n_under_1
           FROM trs GROUP BY channel)
SELECT g.*, (SELECT min(t.article_id) FROM trs t
             WHERE t.channel = g.channel AND t.wwprice = g.max_wwprice) AS article_of_max
FROM g""", ("trs",))
def price_checks(c: Ctx):
    """Max price per channel and its article (smallest id on ties, via
    max over a struct - one pass), extreme-price counts."""
    p = F.col("wwprice")
    best = F.max(F.struct(p.alias("p"), (-F.col("article_id")).alias("neg_id")))
    g = c.trs.groupBy("channel").agg(
        F.max(p).alias("max_wwprice"), count_where(p > 100000).alias("n_over_100k"),
        count_where(p < 1).alias("n_under_1"), best.alias("_best"))
    return g.select("channel", "max_wwprice", "n_over_100k", "n_under_1",
                    (-F.col("_best.neg_id")).alias("article_of_max"))


# ------------------------------------------------------------------ A45 / A58 rule catalogs
def _ccp_gap(c: Ctx) -> DataFrame:
    return c.ccp.select("*", F.datediff("sale_date", "creation_date").alias("gap"))


_RULE_SRC_SQL = {
    "trs": "trs", "clients": "clients", "crc": "crc", "panel": "panel",
    "ccp": "(SELECT *, CAST(date_diff('day', creation_date, sale_date) AS INTEGER) AS gap FROM ccp)",
}


def _rule_frames(c: Ctx) -> dict:
    return {"trs": c.trs, "clients": c.clients, "crc": c.crc, "ccp": _ccp_gap(c), "panel": c.panel}


# Fixed rule catalogue: (name, SQL predicate of the problem, column, class, cause)
OUTLIER_RULES = {
    "trs": [("negative_spend", "spend < 0", "spend", "ERROR", "refund adjustment"),
            ("zero_price", "wwprice = 0", "wwprice", "UNCERTAIN", "catalog price missing"),
            ("spend_over_100k", "spend > 100000", "spend", "LEGIT", "high-end purchase"),
            ("quantity_over_45", "qty > 45", "qty", "LEGIT", "bulk purchase")],
    "clients": [("birth_pre_1900", "year(birth_date) < 1900", "birth_date", "ERROR", "sentinel date"),
                ("born_after_1992", "birth_date > DATE '1992-01-01'", "birth_date", "ERROR",
                 "under 18 at the reference date"),
                ("born_before_1910", "birth_date < DATE '1910-01-01'", "birth_date", "UNCERTAIN",
                 "over 100 at the reference date")],
    "crc": [("duration_over_480", "appointment_duration > 480", "appointment_duration", "ERROR",
             "entry error")],
    "ccp": [("sale_after_creation_30d", "gap > 30", "sale_date", "ERROR", "serious date inversion"),
            ("sale_after_creation_7d", "gap BETWEEN 1 AND 7", "sale_date", "LEGIT",
             "rounding tolerance")],
    "panel": [("target_order", "target_1m > target_3m", "target_1m", "UNCERTAIN",
               "refund inside the horizon"),
              ("frequent_buyer", "nb_trs_full_hist > 50", "nb_trs_full_hist", "LEGIT",
               "frequent buyer")],
}


def _rules_sql(rules: dict, labels: list[str]) -> str:
    parts = []
    for table, rs in rules.items():
        for r in rs:
            lab = ", ".join(f"'{v}' AS {n}" for n, v in zip(labels, r[2:]))
            parts.append(f"SELECT '{table}' AS dataset, '{r[0]}' AS rule, "
                         f"count(*) FILTER (WHERE {r[1]}) AS n, "
                         f"{spct(f'count(*) FILTER (WHERE {r[1]})', 'count(*)')} AS pct, {lab} "
                         f"FROM {_RULE_SRC_SQL[table]} _s")
    return _u(parts)


def _rules_spark(c: Ctx, rules: dict, labels: list[str]) -> DataFrame:
    frames = _rule_frames(c)
    parts = [Q.rule_counts(frames[t], t, rs) for t, rs in rules.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("dataset", "rule", "n", "pct",
                      *[F.col(f"label{i}").alias(n) for i, n in enumerate(labels)])


_OUT_LABELS = ["column_name", "outlier_class", "cause"]


@register("outlier_classification", _rules_sql(OUTLIER_RULES, _OUT_LABELS),
          ("trs", "clients", "crc", "ccp", "panel"))
def outlier_classification(c: Ctx):
    """12 outlier rules, each with n, %, class and cause; every table's
    rules are counted in one pass."""
    return _rules_spark(c, OUTLIER_RULES, _OUT_LABELS)


# Fixed decision catalogue: (problem, SQL predicate, decision, reason)
DQ_RULES = {
    "trs": [("missing_spend", "spend IS NULL", "IMPUTE", "sale: catalog price, repair: 0"),
            ("negative_spend", "spend < 0", "DROP", "refund adjustments"),
            ("placeholder_serial", "serial_number = 'PLACEHOLDER'", "NULLIFY+FLAG",
             "placeholder is not a serial"),
            ("zero_price_with_spend", "wwprice = 0 AND spend > 0", "FLAG", "catalog price missing")],
    "clients": [("implausible_birth", "year(birth_date) < 1900 OR birth_date > DATE '1992-01-01' "
                 "OR birth_date < DATE '1910-01-01'", "NULLIFY+FLAG", "sentinel or out-of-range age"),
                ("missing_birth", "birth_date IS NULL", "FLAG", "unknown age")],
    "crc": [("long_duration", "appointment_duration > 480", "DROP", "over 8 hours"),
            ("missing_duration", "appointment_duration IS NULL", "FLAG", "structural"),
            ("missing_client", "client_id IS NULL", "DROP", "no key")],
    "ccp": [("serious_gap", "gap > 30", "DROP", "sale long after registration"),
            ("missing_sale_date", "sale_date IS NULL", "FLAG", "unknown sale date")],
    "panel": [("missing_age", "age IS NULL", "FLAG", "sparse demographic"),
              ("structural_std", "stddev_price IS NULL", "FLAG", "needs two purchases")],
}
_DQ_LABELS = ["decision", "reason"]


@register("dq_rule_registry", _rules_sql(DQ_RULES, _DQ_LABELS).replace(" AS rule,", " AS problem,"),
          ("trs", "clients", "crc", "ccp", "panel"))
def dq_rule_registry(c: Ctx):
    """Live n and % for every catalogued problem (no hard-coded counts)."""
    return _rules_spark(c, DQ_RULES, _DQ_LABELS).withColumnRenamed("rule", "problem")


# ------------------------------------------------------------------ A46-A49
@register("target_order_violations", f"""
SELECT count(*) FILTER (WHERE target_1m > target_3m) AS n_1m_gt_3m,
  {spct('count(*) FILTER (WHERE target_1m > target_3m)', 'count(*)')} AS pct_1m_gt_3m,
  count(*) FILTER (WHERE target_3m > target_1y) AS n_3m_gt_1y,
  {spct('count(*) FILTER (WHERE target_3m > target_1y)', 'count(*)')} AS pct_3m_gt_1y,
  count(*) FILTER (WHERE target_3m = target_1y) AS n_3m_eq_1y,
  {spct('count(*) FILTER (WHERE target_3m = target_1y)', 'count(*)')} AS pct_3m_eq_1y,
  max(target_1m - target_3m) AS max_diff_1m_3m
FROM panel""", ("panel",))
def target_order_violations(c: Ctx):
    """Nested horizons should not shrink."""
    t1, t3, t12 = F.col("target_1m"), F.col("target_3m"), F.col("target_1y")
    return c.panel.agg(
        count_where(t1 > t3).alias("n_1m_gt_3m"), pct(count_where(t1 > t3), F.count(F.lit(1))).alias("pct_1m_gt_3m"),
        count_where(t3 > t12).alias("n_3m_gt_1y"), pct(count_where(t3 > t12), F.count(F.lit(1))).alias("pct_3m_gt_1y"),
        count_where(t3 == t12).alias("n_3m_eq_1y"), pct(count_where(t3 == t12), F.count(F.lit(1))).alias("pct_3m_eq_1y"),
        F.max(t1 - t3).alias("max_diff_1m_3m"))


@register("top_segment_overlap", f"""
WITH t AS (SELECT * FROM panel WHERE date_target = {TEST}),
a AS (SELECT quantile_cont(to_full_hist, 0.999) AS p FROM t),
b AS (SELECT quantile_cont(target_1y, 0.999) AS p FROM t WHERE target_1y > 0)
SELECT count(*) FILTER (WHERE to_full_hist > (SELECT p FROM a)) AS n_top_history,
  count(*) FILTER (WHERE target_1y > (SELECT p FROM b)) AS n_top_target,
  count(*) FILTER (WHERE to_full_hist > (SELECT p FROM a) AND target_1y > (SELECT p FROM b)) AS n_both,
  count(*) FILTER (WHERE to_full_hist = 0 AND target_1y > 0) AS n_zero_history_positive_target
FROM t""", ("panel",))
def top_segment_overlap(c: Ctx):
    """Clients above p99.9 on history and on target (of the positive
    targets), and their overlap."""
    t = c.staged(_test_panel(c).select("to_full_hist", "target_1y"))
    ph = D.exact_percentiles(t, "to_full_hist", {"p": 0.999}, digits=None).agg(F.first("p")).scalar()
    pt = D.exact_percentiles(t.filter("target_1y > 0"), "target_1y", {"p": 0.999}, digits=None) \
        .agg(F.first("p")).scalar()
    a, b = F.col("to_full_hist") > ph, F.col("target_1y") > pt
    return t.agg(count_where(a).alias("n_top_history"), count_where(b).alias("n_top_target"),
                 count_where(a & b).alias("n_both"),
                 count_where((F.col("to_full_hist") == 0) & (F.col("target_1y") > 0))
                 .alias("n_zero_history_positive_target"))


@register("recency_checks", f"""
SELECT date_target, avg(recency) AS mean_recency, min(recency) AS min_recency,
  max(recency) AS max_recency, count(*) FILTER (WHERE nb_trs_full_hist = 1) AS n_single,
  {spct('count(*) FILTER (WHERE nb_trs_full_hist = 1 AND recency = seniority)',
        'count(*) FILTER (WHERE nb_trs_full_hist = 1)')} AS pct_single_recency_eq_seniority
FROM panel GROUP BY date_target""", ("panel",))
def recency_checks(c: Ctx):
    """A48"""
    single = F.col("nb_trs_full_hist") == 1
    return c.panel.groupBy("date_target").agg(
        F.avg("recency").alias("mean_recency"), F.min("recency").alias("min_recency"),
        F.max("recency").alias("max_recency"), count_where(single).alias("n_single"),
        pct(count_where(single & (F.col("recency") == F.col("seniority"))), count_where(single))
        .alias("pct_single_recency_eq_seniority"))


_FLAGS = ["has_crc_interaction", "has_clienteling", "has_ccp", "has_gift_registered",
          "birth_date_valid", "purchase_date_anomaly"]


@register("flag_report", _u(
    f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f} = 0) AS n_0, "
    f"count(*) FILTER (WHERE {f} = 1) AS n_1, count(*) FILTER (WHERE {f} IS NULL) AS n_null, "
    f"{spct(f'count(*) FILTER (WHERE {f} = 1)', 'count(*)')} AS pct_1 FROM supp" for f in _FLAGS),
    ("supp",))
def flag_report(c: Ctx):
    """0/1/null counts per binary flag (one pass, unpivoted)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in _FLAGS:
        aggs += [F.count_if(F.col(f) == 0).alias(f"{f}__0"), F.count_if(F.col(f) == 1).alias(f"{f}__1"),
                 F.count_if(F.col(f).isNull()).alias(f"{f}__null")]
    row = c.supp.agg(*aggs)
    return Q.rows_from(row, [[F.lit(f).alias("flag"), F.col(f"{f}__0").alias("n_0"),
                              F.col(f"{f}__1").alias("n_1"), F.col(f"{f}__null").alias("n_null"),
                              pct(f"{f}__1", "_n").alias("pct_1")] for f in _FLAGS])


# ------------------------------------------------------------------ A57 summary
_SUMMARY_SQL = [
    ("trs_rows", "SELECT count(*) FROM trs"),
    ("trs_negative_spend", "SELECT count(*) FROM trs WHERE spend < 0"),
    ("trs_null_spend", "SELECT count(*) FROM trs WHERE spend IS NULL"),
    ("trs_placeholder_serial", "SELECT count(*) FROM trs WHERE serial_number = 'PLACEHOLDER'"),
    ("trs_orphan_article_rows",
     "SELECT count(*) FROM trs WHERE article_id NOT IN (SELECT article_id FROM articles)"),
    ("trs_after_last_snapshot", f"SELECT count(*) FROM trs WHERE trs_date > {TEST}"),
    ("ccp_gap_over_30",
     "SELECT count(*) FROM ccp WHERE date_diff('day', creation_date, sale_date) > 30"),
    ("crc_duration_over_480", "SELECT count(*) FROM crc WHERE appointment_duration > 480"),
]


@register("quality_summary", _u(f"SELECT '{k}' AS check_name, CAST(({q}) AS VARCHAR) AS value"
                                for k, q in _SUMMARY_SQL), ("trs", "articles", "ccp", "crc"))
def quality_summary(c: Ctx):
    """Consolidated (check, value) table; each value is a scalar
    subquery, the whole report is one plan."""
    t = c.trs
    orphan = t.join(c.articles.select("article_id"), "article_id", "left_anti")
    vals = {
        "trs_rows": t.agg(F.count(F.lit(1))).scalar(),
        "trs_negative_spend": t.agg(F.count_if(F.col("spend") < 0)).scalar(),
        "trs_null_spend": t.agg(F.count_if(F.col("spend").isNull())).scalar(),
        "trs_placeholder_serial": t.agg(F.count_if(F.col("serial_number") == "PLACEHOLDER")).scalar(),
        "trs_orphan_article_rows": orphan.agg(F.count(F.lit(1))).scalar(),
        "trs_after_last_snapshot": t.agg(F.count_if(F.col("trs_date") > F.lit(c.test_snapshot))).scalar(),
        "ccp_gap_over_30": c.ccp.agg(F.count_if(F.datediff("sale_date", "creation_date") > 30)).scalar(),
        "crc_duration_over_480": c.crc.agg(F.count_if(F.col("appointment_duration") > 480)).scalar(),
    }
    one = c.spark.range(1)
    return Q.rows_from(one, [[F.lit(k).alias("check_name"), v.cast("string").alias("value")]
                             for k, v in vals.items()])


# ------------------------------------------------------------------ joins and set operations
@register("semi_join_ids", f"""
SELECT client_id, trs_date, article_id, spend FROM trs
WHERE client_id IN (SELECT client_id FROM panel WHERE date_target = {TEST})""", ("trs", "panel"))
def semi_join_ids(c: Ctx):
    """``isin(id_set)`` as a left-semi join (no id set on the driver)."""
    ids = _test_panel(c).select("client_id")
    return c.trs.join(ids, "client_id", "left_semi").select("client_id", "trs_date", "article_id",
                                                            "spend")


@register("anti_join_orphans", """
SELECT channel, count(*) AS n_rows, count(DISTINCT article_id) AS n_orphan_ids,
  CAST(min(year(trs_date)) AS INTEGER) AS min_year, CAST(max(year(trs_date)) AS INTEGER) AS max_year,
  count(*) FILTER (WHERE spend > 0) AS n_positive_spend
FROM trs t WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.article_id = t.article_id)
GROUP BY channel""", ("trs", "articles"))
def anti_join_orphans(c: Ctx):
    """Event rows whose article is absent from the dimension, by channel."""
    o = c.trs.join(c.articles.select("article_id"), "article_id", "left_anti")
    return o.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("article_id").alias("n_orphan_ids"),
        F.min(F.year("trs_date")).alias("min_year"), F.max(F.year("trs_date")).alias("max_year"),
        count_where(F.col("spend") > 0).alias("n_positive_spend"))


_SETS = [("panel", f"SELECT client_id FROM panel WHERE date_target = {TEST}"),
         ("trs", "SELECT client_id FROM trs"), ("clients", "SELECT client_id FROM clients"),
         ("crc", "SELECT client_id FROM crc"), ("ccp", "SELECT client_id FROM ccp")]


def _refmatrix_sql(sets: list[tuple[str, str]] = _SETS) -> str:
    tagged = _u(f"SELECT client_id AS id, {1 << i} AS b FROM ({q}) _q{i}"
                for i, (_, q) in enumerate(sets))
    rows = []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            bi, bj, bb = 1 << i, 1 << j, (1 << i) | (1 << j)
            na = f"count(*) FILTER (WHERE (m & {bi}) <> 0)"
            nb = f"count(*) FILTER (WHERE (m & {bj}) <> 0)"
            nx = f"count(*) FILTER (WHERE (m & {bb}) = {bb})"
            rows.append(f"SELECT '{sets[i][0]}' AS a, '{sets[j][0]}' AS b, {na} AS n_a, {nb} AS n_b, "
                        f"{nx} AS n_intersection, {na} - {nx} AS n_only_a, {nb} - {nx} AS n_only_b, "
                        f"{spct(nx, na)} AS pct_a_in_b, {spct(nx, nb)} AS pct_b_in_a FROM mk")
    return (f"WITH tg AS ({tagged}),\nmk AS (SELECT id, bit_or(b) AS m FROM tg WHERE id IS NOT NULL "
            f"GROUP BY id)\n" + _u(rows))


@register("referential_integrity_matrix", _refmatrix_sql(),
          ("panel", "trs", "clients", "crc", "ccp"))
def referential_integrity_matrix(c: Ctx):
    """All pairs of five client-id sets from one bitmask per id."""
    return Q.referential_matrix({"panel": _test_panel(c), "trs": c.trs, "clients": c.clients,
                                 "crc": c.crc, "ccp": c.ccp}, "client_id")


@register("negative_positive_article_match", f"""
WITH ca AS (SELECT client_id, article_id,
              max(CAST(coalesce(spend < 0, false) AS INTEGER)) AS neg,
              max(CAST(coalesce(spend > 0, false) AS INTEGER)) AS pos
            FROM trs GROUP BY client_id, article_id),
cl AS (SELECT client_id, max(neg) AS neg, max(neg * pos) AS matched FROM ca GROUP BY client_id)
SELECT count(*) FILTER (WHERE neg = 1) AS n_clients_negative,
  count(*) FILTER (WHERE matched = 1) AS n_clients_matched,
  {spct('count(*) FILTER (WHERE matched = 1)', 'count(*) FILTER (WHERE neg = 1)')} AS pct_matched
FROM cl""", ("trs",))
def negative_positive_article_match(c: Ctx):
    """For every client with a negative row, is there a positive row on
    the same article? Two grouped passes, all clients (no sample)."""
    ca = c.trs.groupBy("client_id", "article_id").agg(
        F.max(F.coalesce(F.col("spend") < 0, F.lit(False)).cast("int")).alias("neg"),
        F.max(F.coalesce(F.col("spend") > 0, F.lit(False)).cast("int")).alias("pos"))
    cl = ca.groupBy("client_id").agg(F.max("neg").alias("neg"),
                                     F.max(F.col("neg") * F.col("pos")).alias("matched"))
    return cl.agg(F.count_if(F.col("neg") == 1).alias("n_clients_negative"),
                  F.count_if(F.col("matched") == 1).alias("n_clients_matched"),
                  pct(F.count_if(F.col("matched") == 1), F.count_if(F.col("neg") == 1))
                  .alias("pct_matched"))


@register("outer_align_fill_zero", """
SELECT channel, count(*) AS n_rows, count(*) FILTER (WHERE spend IS NULL) AS n_null_spend,
  count(*) FILTER (WHERE trs_categ = 'Repair') AS n_repairs
FROM trs GROUP BY channel""", ("trs",))
def outer_align_fill_zero(c: Ctx):
    """Counts of all rows and of a condition aligned per key with 0 for
    absent keys - one groupBy with ``count_if`` instead of an outer join."""
    return c.trs.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("spend").isNull()).alias("n_null_spend"),
        count_where(F.col("trs_categ") == "Repair").alias("n_repairs"))


@register("union_all_snapshots", _u(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}"
                                    for t in ("trs", "articles", "clients", "crc", "ccp", "panel")),
          ("trs", "articles", "clients", "crc", "ccp", "panel"))
def union_all_snapshots(c: Ctx):
    """Stack per-table results with ``unionByName``."""
    frames = {"trs": c.trs, "articles": c.articles, "clients": c.clients, "crc": c.crc,
              "ccp": c.ccp, "panel": c.panel}
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n, df in frames.items()])


@register("intersect_ids", "SELECT client_id FROM crc WHERE client_id IS NOT NULL "
                           "INTERSECT SELECT client_id FROM ccp", ("crc", "ccp"))
def intersect_ids(c: Ctx):
    """X3"""
    return c.crc.select("client_id").filter(F.col("client_id").isNotNull()).intersect(
        c.ccp.select("client_id"))


@register("except_ids", "SELECT client_id FROM clients EXCEPT SELECT client_id FROM crc",
          ("clients", "crc"))
def except_ids(c: Ctx):
    """Clients never contacted (EXCEPT DISTINCT)."""
    return c.clients.select("client_id").subtract(c.crc.select("client_id"))


# ------------------------------------------------------------------ W2 / W6
_MONO = ["seniority", "to_full_hist", "nb_trs_full_hist"]


@register("monotonic_violations", """
WITH x AS (SELECT client_id, """ + ", ".join(
    f"CAST(coalesce({m} < lag({m}) OVER (PARTITION BY client_id ORDER BY date_target), false) "
    f"AS INTEGER) AS d_{m}" for m in _MONO) + """ FROM panel),
pc AS (SELECT client_id, """ + ", ".join(f"max(d_{m}) AS v_{m}" for m in _MONO) + """
       FROM x GROUP BY client_id)
SELECT count(*) AS n_clients, """ + ", ".join(
    f"CAST(sum(v_{m}) AS BIGINT) AS n_violating_{m}" for m in _MONO) + """,
  avg(CAST(greatest(""" + ", ".join(f"v_{m}" for m in _MONO) + """) = 0 AS INTEGER)) * 100.0
    AS pct_clean_clients
FROM pc""", ("panel",))
def monotonic_violations(c: Ctx):
    """Cumulative history measures must not decrease across snapshots
    (all clients; the window is per client, at most one row per snapshot)."""
    return Q.monotonic_violations(c.panel, "client_id", "date_target", _MONO)


@register("row_delta_between_snapshots", """
SELECT delta, count(*) AS n FROM (
  SELECT recency - lag(recency) OVER (PARTITION BY client_id ORDER BY date_target) AS delta
  FROM panel) x
WHERE delta IS NOT NULL GROUP BY delta""", ("panel",))
def row_delta_between_snapshots(c: Ctx):
    """Recency step between consecutive snapshots per client."""
    return Q.row_deltas(c.panel, "client_id", "date_target", "recency")
