"""As-of feature queries (SURVEY 2.3 J1-J4, J8, J11, J12; 2.4 A1-A8; 2.5 W1;
2.2 F18-F20; 2.11 V1, V5, V8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.operators import features as FE
from panelscope.plans.registry import Ctx, register
from panelscope.sources.views import PRIOR_YEARS, RECENT_YEARS

_R, _P = 12 * RECENT_YEARS, 12 * PRIOR_YEARS


def _rfm(c: Ctx):
    return FE.rfm_features(c.trs, c.snapshots, RECENT_YEARS, PRIOR_YEARS,
                           upper_bound=c.last_snapshot, dates=c.snapshot_dates)


_RFM_VIEWS = ("rfm",)


def _rfm_subset(name: str, cols: list[str], doc: str):
    sel = ", ".join(["client_id", "date_target", *cols])

    @register(name, f"SELECT {sel} FROM rfm", _RFM_VIEWS)
    def q(c: Ctx):
        return _rfm(c).select("client_id", "date_target", *cols)
    q.__doc__ = doc
    return q


@register("rfm_snapshot_features", "SELECT * FROM rfm", _RFM_VIEWS)
def rfm_snapshot_features(c: Ctx):
    """Flagship: J8 + fused A1-A7 + F18 + W1 per (client, snapshot)."""
    return _rfm(c)


_rfm_subset("rfm_base", ["n_transactions", "total_spend", "avg_spend_per_trs",
                         "max_single_spend", "n_distinct_articles"], "A1")
_rfm_subset("rfm_recency_tenure", ["recency_days", "tenure_days"], "A2")
_rfm_subset("rfm_windowed_spend", ["spend_recent", "spend_prior"], "A3")
_rfm_subset("rfm_type_counts", ["n_sale_trs", "n_repair_trs", "repair_ratio"], "A4")
_rfm_subset("rfm_channel_ratio", ["boutique_ratio"], "A5")
_rfm_subset("rfm_holiday_ratio", ["holiday_purchase_ratio"], "A6")
_rfm_subset("rfm_flag_ratio", ["flag_he_ratio_trs"], "A7")
_rfm_subset("rfm_avg_gap_days", ["avg_days_between_trs"], "W1 (closed form)")
_rfm_subset("spend_trend_piecewise", ["spend_recent", "spend_prior", "spend_trend"], "F18")


@register("rfm_avg_gap_lag_form", f"""
SELECT client_id, date_target, coalesce(avg(gap), 0.0) AS avg_days_between_trs FROM (
  SELECT t.client_id, s.date_target,
    CAST(date_diff('day', lag(t.trs_date) OVER (PARTITION BY t.client_id, s.date_target
         ORDER BY t.trs_date), t.trs_date) AS INTEGER) AS gap
  FROM trs t JOIN snapshots s ON t.trs_date <= s.date_target) x
GROUP BY client_id, date_target""", ("trs", "snapshots"))
def rfm_avg_gap_lag_form(c: Ctx):
    """W1 cross-check with ``lag`` (equals the closed form)."""
    return FE.avg_gap_lag_form(c.trs, c.snapshots, upper_bound=c.last_snapshot)


@register("asof_snapshot_expand", """
SELECT s.date_target, t.client_id, t.trs_date, t.article_id, t.spend
FROM trs t JOIN snapshots s ON t.trs_date <= s.date_target""", ("trs", "snapshots"))
def asof_snapshot_expand(c: Ctx):
    """Event rows replicated to every snapshot that can see them."""
    return FE.asof_expand(c.trs, c.snapshots, upper_bound=c.last_snapshot).select(
        "date_target", "client_id", "trs_date", "article_id", "spend")


@register("asof_filter", """
SELECT t.client_id, t.trs_date, t.spend FROM trs t WHERE t.trs_date <= DATE '2000-01-01'""",
          ("trs",))
def asof_filter(c: Ctx):
    """point-in-time rule for one cutoff (pushed into the scan)."""
    return c.trs.filter(F.col("trs_date") <= F.lit(c.test_snapshot)).select(
        "client_id", "trs_date", "spend")


# ------------------------------------------------------------------ A8, J1-J4, J11, J12, V1, V5, V8
def _art(c: Ctx):
    if "art" not in c._cache:
        c._cache["art"] = FE.article_features(c.trs, c.articles, c.snapshots,
                                              upper_bound=c.last_snapshot, dates=c.snapshot_dates)
    return c._cache["art"]


def _master(c: Ctx):
    if "master" not in c._cache:
        c._cache["master"] = _master_in(c)
    return c._cache["master"]


def _master_in(c: Ctx, step=lambda df: df):
    """The master's plan; ``step`` may write what its parts read."""
    from panelscope.operators.cleaning import clean_panel
    from panelscope.sources import views as V
    wide = clean_panel(V.panel_with_features(c.trs, c.client_dimension, c.articles, step=step), repairs="repairs_known")
    return FE.build_master_from(
        wide, [*V.PANEL_COLUMNS, "age_known", "has_multiple_purchases", "has_repair_history"], step(c.client_flags))


def _stored_master(c: Ctx):
    """The master written by steps, each of which deletes its shuffles, and what
    it reads goes when all have read it. Its reader forgets it."""
    from panelscope.session import forget, stored
    parts = []

    def step(df):
        parts.append(stored(df))
        return parts[-1]

    master = stored(_master_in(c, step))
    forget(*parts)
    return master


def _staged_master(c: Ctx):
    """The master table written once, for reports that read it in several jobs."""
    if not c._cache.get("master_staged"):
        from panelscope.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(c.spark)
        c._cache["master"] = _master(c).checkpoint(eager=True)
        c._cache["master_staged"] = True
    return c._cache["master"]


@register("article_features", "SELECT * FROM art", ("art",))
def article_features(c: Ctx):
    """A8"""
    return _art(c)


@register("join_dimension_left_orphans", """
SELECT t.client_id, t.trs_date, t.article_id, a.world_price, a.product_category,
  CAST(a.article_id IS NULL AS INTEGER) AS is_orphan
FROM trs t LEFT JOIN articles a ON t.article_id = a.article_id
WHERE t.trs_categ = 'Sale'""", ("trs", "articles"))
def join_dimension_left_orphans(c: Ctx):
    """Sales keep orphan articles; ``is_orphan`` marks them."""
    sales = c.trs.filter(F.col("trs_categ") == "Sale").select("client_id", "trs_date", "article_id")
    art = c.articles.select("article_id", "world_price", "product_category",
                            F.lit(0).alias("_hit"))
    j = sales.join(art, "article_id", "left")
    return j.select("client_id", "trs_date", "article_id", "world_price", "product_category",
                    F.col("_hit").isNull().cast("int").alias("is_orphan"))


def _panel_feats_sql() -> str:
    from panelscope.sources.views import PANEL_COLUMNS
    cols = FE.panel_feature_columns(list(PANEL_COLUMNS) + ["age_known", "has_multiple_purchases",
                                                           "has_repair_history"])
    return "SELECT " + ", ".join(cols) + " FROM clean_panel"


@register("select_feature_columns", _panel_feats_sql(), ("clean_panel",))
def select_feature_columns(c: Ctx):
    """targets, sparse age, structural-missing and list columns excluded."""
    return FE.select_panel_features(c.clean_panel)


_J1 = ", ".join([f"r.{x}" for x in FE.RFM_COLS] + [f"a.{x}" for x in FE.ART_COLS])


@register("join_panel_features_left", f"""
SELECT p.client_id, p.date_target, p.to_full_hist, {_J1}
FROM panel p
LEFT JOIN rfm r ON p.client_id = r.client_id AND p.date_target = r.date_target
LEFT JOIN art a ON p.client_id = a.client_id AND p.date_target = a.date_target""",
          ("panel", "rfm", "art"))
def join_panel_features_left(c: Ctx):
    """J1"""
    return FE.join_panel_features(c.panel.select("client_id", "date_target", "to_full_hist"),
                                  _rfm(c), _art(c))


@register("join_supplementary_left", f"""
SELECT p.client_id, p.date_target, {', '.join('s.' + x for x in FE.SUPP_SAFE)}
FROM panel p LEFT JOIN supp s ON p.client_id = s.client_id""", ("panel", "supp"))
def join_supplementary_left(c: Ctx):
    """J2 (as_of=False: the reference's behaviour, see D6)"""
    return FE.join_supplementary(c.panel.select("client_id", "date_target"), c.supp)


@register("join_targets_left", """
SELECT r.client_id, r.date_target, r.total_spend, p.target_1m, p.target_3m, p.target_1y
FROM rfm r LEFT JOIN panel p ON r.client_id = p.client_id AND r.date_target = p.date_target""",
          ("rfm", "panel"))
def join_targets_left(c: Ctx):
    """J4"""
    return FE.join_targets(_rfm(c).select("client_id", "date_target", "total_spend"), c.panel)


@register("join_cardinality_guard", """
SELECT (SELECT count(*) FROM clean_panel) AS n_panel_rows,
  (SELECT count(*) FROM master) AS n_master_rows,
  (SELECT count(*) FROM (SELECT article_id FROM articles GROUP BY article_id
                         HAVING count(*) > 1) d) AS n_duplicate_article_ids,
  (SELECT count(*) FROM (SELECT client_id FROM supp GROUP BY client_id
                         HAVING count(*) > 1) d) AS n_duplicate_supp_ids""",
          ("clean_panel", "master", "articles", "supp"))
def join_cardinality_guard(c: Ctx):
    """Row count unchanged by the master joins, and right-side keys unique."""
    n_master = _master(c).agg(F.count(F.lit(1))).scalar()
    dup_art = FE.key_is_unique(c.articles, "article_id").agg(F.count(F.lit(1))).scalar()
    dup_supp = FE.key_is_unique(c.supp, "client_id").agg(F.count(F.lit(1))).scalar()
    return c.clean_panel.agg(F.count(F.lit(1)).alias("n_panel_rows")).select(
        "n_panel_rows", n_master.alias("n_master_rows"),
        dup_art.alias("n_duplicate_article_ids"), dup_supp.alias("n_duplicate_supp_ids"))


@register("add_log_targets", """
SELECT client_id, date_target, target_1m, target_3m, target_1m_log, target_1m_bin,
  target_3m_log, target_3m_bin FROM master""", ("master",))
def add_log_targets(c: Ctx):
    """F19"""
    return _master(c).select("client_id", "date_target", "target_1m", "target_3m",
                             "target_1m_log", "target_1m_bin", "target_3m_log", "target_3m_bin")


@register("build_master_features", "SELECT * FROM master", ("master",))
def build_master_features(c: Ctx):
    """V8: the full master feature table (one plan)."""
    return _master(c)


@register("temporal_split", """
SELECT CASE WHEN date_target < DATE '2000-01-01' THEN 'train'
            WHEN date_target = DATE '2000-01-01' THEN 'test' ELSE 'later' END AS split,
  count(*) AS n_rows
FROM master GROUP BY 1""", ("master",))
def temporal_split(c: Ctx):
    """V1: sizes of train / test / later (D16 remainder reported)."""
    return FE.split_sizes(_master(c), c.test_snapshot)


@register("train_test_id_overlap", """
SELECT count(*) AS n_train_rows_in_test FROM master m
WHERE m.date_target < DATE '2000-01-01'
  AND m.client_id IN (SELECT client_id FROM master WHERE date_target = DATE '2000-01-01')""",
          ("master",))
def train_test_id_overlap(c: Ctx):
    """J12"""
    train, test = FE.temporal_split(_master(c), c.test_snapshot)
    return FE.train_test_id_overlap(train, test)


def _master_cols():
    from panelscope.sources.views import PANEL_COLUMNS
    pf = FE.panel_feature_columns(list(PANEL_COLUMNS) + ["age_known", "has_multiple_purchases",
                                                         "has_repair_history"])
    allc = pf + list(FE.RFM_COLS) + list(FE.ART_COLS) + list(FE.SUPP_SAFE) + list(FE.TARGETS)
    for t in FE.LOG_TARGETS:
        allc += [f"{t}_log", f"{t}_bin"]
    skip = {"client_id", "date_target", "residency_country", "gender", "residency_market",
            *FE.TARGETS, *[f"{t}_log" for t in FE.LOG_TARGETS],
            *[f"{t}_bin" for t in FE.LOG_TARGETS]}
    return [x for x in allc if x not in skip], allc


def _v5_sql() -> str:
    num, allc = _master_cols()
    zv = " + ".join(f"CAST(coalesce(stddev_samp({x}) = 0, false) AS INTEGER)" for x in num)
    hn = " + ".join(f"CAST(coalesce(avg(CAST({x} IS NULL AS INTEGER)) > 0.5, false) AS INTEGER)"
                    for x in allc)
    t = "target_1m"
    return f"""
WITH tr AS (SELECT * FROM master WHERE date_target < DATE '2000-01-01'),
te AS (SELECT * FROM master WHERE date_target = DATE '2000-01-01'),
r AS (SELECT
  CASE WHEN (SELECT count(*) FROM te) = 0 THEN 1 ELSE 0 END AS test_not_empty,
  ({zv}) AS no_zero_variance,
  count(*) FILTER (WHERE NOT coalesce({t}_bin IN (0, 1), false)) AS binary_target_01,
  count(*) FILTER (WHERE NOT coalesce({t}_log >= 0, false)) AS log_target_non_negative,
  count(*) FILTER (WHERE NOT coalesce({t} >= 0, false)) AS target_non_negative,
  ({hn}) AS no_column_over_50pct_null,
  count(*) FILTER (WHERE client_id IS NULL) AS train_key_not_null,
  (SELECT count(*) FILTER (WHERE client_id IS NULL) FROM te) AS test_key_not_null
  FROM tr)
SELECT check_name, CAST(n_violations AS BIGINT) AS n_violations,
  CASE WHEN n_violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM r UNPIVOT (n_violations FOR check_name IN (test_not_empty, no_zero_variance,
  binary_target_01, log_target_non_negative, target_non_negative, no_column_over_50pct_null,
  train_key_not_null, test_key_not_null))"""


@register("validate_feature_set", _v5_sql(), ("master",))
def validate_feature_set(c: Ctx):
    """V5"""
    num, allc = _master_cols()
    train, test = FE.temporal_split(_staged_master(c), c.test_snapshot)
    return FE.validate_features(train, test, num, allc, "target_1m")


# ------------------------------------------------------------------ SURVEY 2.13 (specified, optional)
@register("rfm_extended_features", """
SELECT client_id, date_target, CAST(month(date_target - recency_days) AS INTEGER) AS month_last_purchase,
  CAST(year(date_target) AS INTEGER) AS snapshot_year,
  CASE WHEN spend_recent > -1 AND spend_prior > -1
       THEN round(ln(1 + spend_recent) - ln(1 + spend_prior), 9) END AS spend_trend_log
FROM rfm""", ("rfm",))
def rfm_extended_features(c: Ctx):
    """2.13: month of the last purchase, snapshot year, log spend trend."""
    r = _rfm(c)
    ok = (F.col("spend_recent") > -1) & (F.col("spend_prior") > -1)
    return r.select("client_id", "date_target",
                    F.month(F.date_sub("date_target", F.col("recency_days"))).alias("month_last_purchase"),
                    F.year("date_target").alias("snapshot_year"),
                    F.when(ok, F.round(F.log1p("spend_recent") - F.log1p("spend_prior"), 9))
                    .alias("spend_trend_log"))


@register("asof_supplementary", """
SELECT r.client_id, s.date_target, count(*) AS n_ccp_products_asof,
  max(CAST(coalesce(r.flag_gift, false) AS INTEGER)) AS has_gift_asof
FROM ccp r JOIN snapshots s ON r.creation_date <= s.date_target
GROUP BY r.client_id, s.date_target""", ("ccp", "snapshots"))
def asof_supplementary(c: Ctx):
    """2.13 / D6: registration flags as of each snapshot (creation date on or
    before it) instead of the reference's leaking all-time flags."""
    x = FE.asof_expand(c.ccp, c.snapshots, date_col="creation_date", upper_bound=c.last_snapshot)
    return x.groupBy("client_id", "date_target").agg(
        F.count(F.lit(1)).alias("n_ccp_products_asof"),
        F.max(F.coalesce(F.col("flag_gift"), F.lit(False)).cast("int")).alias("has_gift_asof"))


@register("age_imputed_by_market_gender", """
WITH t AS (SELECT * FROM panel WHERE date_target = DATE '2000-01-01'),
m AS (SELECT residency_market, gender, round(quantile_cont(age, 0.5), 6) AS med FROM t
      WHERE age IS NOT NULL AND residency_market IS NOT NULL AND gender IS NOT NULL
      GROUP BY residency_market, gender)
SELECT t.client_id, t.age, coalesce(t.age, m.med) AS age_imputed
FROM t LEFT JOIN m ON t.residency_market = m.residency_market AND t.gender = m.gender""",
          ("panel",))
def age_imputed_by_market_gender(c: Ctx):
    """2.13: latest snapshot, null age filled with the exact median age of
    the client's (market, gender) group; null group keys are not a group."""
    from panelscope.operators.distribution import exact_percentiles
    t = c.panel.filter(F.col("date_target") == F.lit(c.test_snapshot))
    keys = ["residency_market", "gender"]
    src = t.filter(F.col("residency_market").isNotNull() & F.col("gender").isNotNull())
    med = exact_percentiles(src, "age", {"med": 0.5}, keys)
    return t.join(med, keys, "left").select(
        "client_id", "age", F.coalesce(F.col("age"), F.col("med")).alias("age_imputed"))


@register("purchase_sequence_features", """
WITH p AS (SELECT client_id, date_target,
  list_filter(list_transform(string_split(all_purchased_dates, ','),
              lambda e: TRY_CAST(trim(e) AS DATE)), lambda d: d IS NOT NULL) AS ds
  FROM panel)
SELECT client_id, date_target, CAST(len(ds) AS INTEGER) AS n_dates,
  list_min(ds) AS first_date, list_max(ds) AS last_date,
  CAST(len(list_filter(ds, lambda d: d > date_target)) AS INTEGER) AS n_after_snapshot
FROM p""", ("panel",))
def purchase_sequence_features(c: Ctx):
    """2.13: features read from the comma list with higher-order functions
    (no explode): parsed dates, first / last, and dates after the snapshot."""
    ds = F.filter(F.transform(F.split("all_purchased_dates", ","),
                              lambda e: F.try_to_date(F.trim(e), "yyyy-MM-dd")),
                  lambda d: d.isNotNull())
    p = c.panel.select("client_id", "date_target", ds.alias("ds"))
    return p.select("client_id", "date_target", F.size("ds").alias("n_dates"),
                    F.array_min("ds").alias("first_date"), F.array_max("ds").alias("last_date"),
                    F.size(F.filter("ds", lambda d: d > F.col("date_target"))).alias("n_after_snapshot"))
