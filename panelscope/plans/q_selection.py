"""Feature screening / selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelscope.operators import features as FE
from panelscope.operators import selection as S
from panelscope.plans.oracle_views import corr as scorr
from panelscope.plans.q_features import _master, _master_cols, _staged_master, _stored_master
from panelscope.plans.registry import Ctx, register

TEST = "DATE '2000-01-01'"
NUMERIC, ALL_COLS = _master_cols()
NEVER_REMOVE = {"client_id", "date_target", *FE.TARGETS,
                *[f"{t}_log" for t in FE.LOG_TARGETS], *[f"{t}_bin" for t in FE.LOG_TARGETS]}
FEATURES = [c for c in ALL_COLS if c not in NEVER_REMOVE]
NUM_FEATURES = [c for c in NUMERIC if c not in NEVER_REMOVE]
FAMILIES = {**{c: "RFM" for c in FE.RFM_COLS}, **{c: "Articles" for c in FE.ART_COLS},
            **{c: "Supplementary" for c in FE.SUPP_SAFE}}
FAMILIES = {c: FAMILIES.get(c, "Aggregated") for c in FEATURES}

# Fixed selection lists for the test panel (the reference keeps the same
# three roles: RFM columns duplicating panel columns, known near-zero columns,
# and RFM columns with no panel equivalent that are always kept).
RFM_DUPLICATES = ("spend_recent", "total_spend", "n_transactions", "avg_spend_per_trs",
                  "n_sale_trs", "n_repair_trs", "tenure_days")
KNOWN_NEAR_ZERO = ()
RFM_KEEP = ("boutique_ratio", "holiday_purchase_ratio", "avg_days_between_trs", "spend_trend",
            "repair_ratio", "n_distinct_articles", "spend_prior")

_TRAIN = f"(SELECT * FROM master WHERE date_target < {TEST})"


def _train(c: Ctx):
    return _master(c).filter(F.col("date_target") < F.lit(c.test_snapshot))


def _u(parts) -> str:
    return "\nUNION ALL\n".join(parts)


@register("corr_with_target", _u(
    f"SELECT '{f}' AS feature, abs({scorr(f, 'target_1m')}) AS abs_corr, '{FAMILIES[f]}' AS family "
    f"FROM {_TRAIN} t" for f in NUM_FEATURES), ("master",))
def corr_with_target(c: Ctx):
    """|r| of every numeric feature with the 1-month target (train)."""
    return S.corr_with_target(_train(c), NUM_FEATURES, "target_1m", FAMILIES)


def _pairs_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(NUM_FEATURES) for b in NUM_FEATURES[i + 1:]]
    cols = ", ".join(f"abs({scorr(a, b, None)}) AS p{i}" for i, (a, b) in enumerate(pairs))
    unp = ", ".join(f"p{i}" for i in range(len(pairs)))
    case_a = " ".join(f"WHEN 'p{i}' THEN '{a}'" for i, (a, _) in enumerate(pairs))
    case_b = " ".join(f"WHEN 'p{i}' THEN '{b}'" for i, (_, b) in enumerate(pairs))
    return f"""
WITH r AS (SELECT {cols} FROM {_TRAIN} t),
u AS (SELECT k, v FROM r UNPIVOT (v FOR k IN ({unp})))
SELECT CASE k {case_a} END AS feature_1, CASE k {case_b} END AS feature_2, round(v, 9) AS abs_corr
FROM u WHERE v > 0.95"""


@register("high_corr_pairs", _pairs_sql(), ("master",))
def high_corr_pairs(c: Ctx):
    """Every numeric feature pair with |r| > 0.95 on the full train set."""
    return S.high_corr_pairs(_train(c), NUM_FEATURES, 0.95)


def _profile_sql() -> str:
    parts = []
    for f in FEATURES:
        z = (f"avg(CAST(coalesce({f} = 0, false) AS INTEGER))" if f in NUM_FEATURES
             else "CAST(0.0 AS DOUBLE)")
        s = f"round(stddev_samp({f}), 6)" if f in NUM_FEATURES else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{f}' AS feature, {z} AS pct_zero, "
                     f"avg(CAST({f} IS NULL AS INTEGER)) AS pct_missing, {s} AS std FROM {_TRAIN} t")
    return _u(parts)


VIEWS_PROFILE = f"WITH prof AS ({_profile_sql()})\n"


def _profile(c: Ctx):
    return S.column_profile(_train(c), FEATURES, NUM_FEATURES)


@register("near_zero_columns", VIEWS_PROFILE + """
SELECT feature, pct_zero, pct_zero > 0.99 AS is_near_zero FROM prof
WHERE feature IN (""" + ", ".join(f"'{f}'" for f in NUM_FEATURES) + ")", ("master",))
def near_zero_columns(c: Ctx):
    """Share of zeros per numeric feature (null counts as non-zero)."""
    p = _profile(c).filter(F.col("feature").isin(*NUM_FEATURES))
    return p.select("feature", "pct_zero", (F.col("pct_zero") > 0.99).alias("is_near_zero"))


@register("zero_variance_columns", VIEWS_PROFILE + """
SELECT feature, std, coalesce(std = 0, false) AS is_zero_variance FROM prof
WHERE feature IN (""" + ", ".join(f"'{f}'" for f in NUM_FEATURES) + ")", ("master",))
def zero_variance_columns(c: Ctx):
    """Sample std per numeric feature and the zero-variance flag."""
    p = _profile(c).filter(F.col("feature").isin(*NUM_FEATURES))
    return p.select("feature", "std", F.coalesce(F.col("std") == 0, F.lit(False))
                    .alias("is_zero_variance"))


@register("high_missing_columns", VIEWS_PROFILE + """
SELECT feature, pct_missing, pct_missing > 0.5 AS over_50pct,
  (SELECT avg(pct_missing) FROM prof) AS mean_missing_rate
FROM prof ORDER BY pct_missing DESC, feature LIMIT 10""", ("master",))
def high_missing_columns(c: Ctx):
    """The 10 most-missing features, the > 50% flag and the mean rate."""
    # the mean over the profile's rows (one a feature), so that it is made once
    p = _profile(c).select("feature", "pct_missing",
                           F.avg("pct_missing").over(Window.partitionBy()).alias("mean_missing_rate"))
    top = p.orderBy(F.col("pct_missing").desc(), "feature").limit(10)
    return top.select("feature", "pct_missing", (F.col("pct_missing") > 0.5).alias("over_50pct"), "mean_missing_rate")


def _lst(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs) if xs else "NULL"


_DECISION_SQL = VIEWS_PROFILE + f""", d AS (
SELECT feature,
  CASE WHEN feature IN ({_lst(RFM_KEEP)}) THEN 'kept'
       WHEN feature IN ({_lst(RFM_DUPLICATES)}) THEN 'rfm_duplicate'
       WHEN feature IN ({_lst(KNOWN_NEAR_ZERO)}) OR pct_zero > 0.99 THEN 'near_zero'
       ELSE 'kept' END AS reason, pct_zero, pct_missing FROM prof)
"""


def _decisions(c: Ctx):
    return S.selection_decisions(_profile(c), RFM_DUPLICATES, KNOWN_NEAR_ZERO, RFM_KEEP)


@register("select_features", _DECISION_SQL + """
SELECT feature, CASE WHEN reason = 'kept' THEN 'kept' ELSE 'removed' END AS status, reason FROM d""",
          ("master",))
def select_features(c: Ctx):
    """V2: per-feature keep / remove decision (the drop list applies to both
    train and test, so their columns stay aligned)."""
    return _decisions(c).select("feature", "status", "reason")


@register("feature_selection_report", _DECISION_SQL + """
SELECT feature, CASE WHEN reason = 'kept' THEN 'kept' ELSE 'removed' END AS status, reason,
  pct_zero, pct_missing FROM d""", ("master",))
def feature_selection_report(c: Ctx):
    """V3: decision, reason, % zero and % missing per feature."""
    return _decisions(c)


REQUIRED = ("client_id", "date_target", "target_1m", "target_1m_log", "target_1m_bin")

# the reduced tables' columns in SQL: all columns of the master but those removed
_REDUCED = _DECISION_SQL + """, cols(position, column_name) AS (VALUES """ + ", ".join(
    f"({i}, '{x}')" for i, x in enumerate(ALL_COLS)) + """),
left_over AS (SELECT position, column_name FROM cols
  WHERE column_name NOT IN (SELECT feature FROM d WHERE reason <> 'kept')),
train_cols AS (SELECT * FROM left_over), test_cols AS (SELECT * FROM left_over)
"""


def _reduced(c: Ctx):
    """Train and test as the selection leaves them, stored and read again."""
    if "reduced" not in c._cache:
        import uuid

        from panelscope.session import ensure_checkpoint_dir, forget
        folder = f"{ensure_checkpoint_dir(c.spark)}/selection-{uuid.uuid4().hex}"
        master = _stored_master(c)  # profile, train and test read it
        train, test = FE.temporal_split(master, c.test_snapshot)
        decisions = S.selection_decisions(S.column_profile(train, FEATURES, NUM_FEATURES),
                                          RFM_DUPLICATES, KNOWN_NEAR_ZERO, RFM_KEEP)
        c._cache["reduced"] = S.store_selection(train, test, decisions, folder)
        forget(master)
    return c._cache["reduced"]


def _known_sql(split: str, op: str) -> str:
    counts = " UNION ALL ".join(f"SELECT '{x}' AS column_name, count(*) AS n_rows, count({x}) AS n_known FROM "
                                f"(SELECT * FROM master WHERE date_target {op} {TEST}) m" for x in ALL_COLS)
    return (f"SELECT '{split}' AS split, column_name, CAST(row_number() OVER (ORDER BY position) AS INTEGER) "
            f"AS position, n_rows, n_known FROM left_over JOIN ({counts}) k USING (column_name)")


@register("reduced_tables", _REDUCED + _known_sql("train", "<") + " UNION ALL " + _known_sql("test", "="),
          ("master",))
def reduced_tables(c: Ctx):
    """V2 applied: columns, rows and known values of the stored reduced tables."""
    return S.stored_columns(*_reduced(c))


@register("validate_selection", _REDUCED + f"""
SELECT 'no_near_zero_left' AS check_name,
  (SELECT count(*) FROM d JOIN train_cols ON feature = column_name WHERE pct_zero > 0.99) AS n_violations
UNION ALL
SELECT 'no_rfm_duplicate_left', (SELECT count(DISTINCT column_name) FROM
  (SELECT * FROM train_cols UNION ALL SELECT * FROM test_cols) x WHERE column_name IN ({_lst(RFM_DUPLICATES)}))
UNION ALL
SELECT 'train_test_aligned', (SELECT count(*) FROM train_cols FULL JOIN test_cols USING (column_name)
  WHERE train_cols.position IS NULL OR test_cols.position IS NULL)
UNION ALL
SELECT 'targets_and_keys_present', (SELECT count(*) FROM (SELECT unnest([{_lst(REQUIRED)}]) AS r) q
  WHERE r NOT IN (SELECT column_name FROM train_cols))
  + (SELECT count(*) FROM (SELECT unnest([{_lst(REQUIRED)}]) AS r) q
     WHERE r NOT IN (SELECT column_name FROM test_cols))""", ("master",))
def validate_selection(c: Ctx):
    """V6: checks of the stored reduced tables."""
    return S.validate_selection(*_reduced(c), NUM_FEATURES, RFM_DUPLICATES, REQUIRED)


# ------------------------------------------------------------------ A55 / A56
_DRIFT = ["to_full_hist", "nb_trs_full_hist", "recency"]


@register("positive_rate_by_snapshot", f"""
WITH m AS (SELECT * FROM master),
a AS (SELECT date_target, count(*) AS n_rows, avg(target_1m_bin) AS positive_rate,
        round(avg(target_1m_log) FILTER (WHERE target_1m_bin = 1), 9) AS mean_log_pos,
        round(stddev_samp(target_1m_log) FILTER (WHERE target_1m_bin = 1), 6) AS std_log_pos,
        round(quantile_cont(target_1m_log, 0.95) FILTER (WHERE target_1m_bin = 1), 6) AS p95_log_pos,
        {', '.join(f"round(quantile_cont({x}, 0.5), 6) AS median_{x}" for x in _DRIFT)}
      FROM m GROUP BY date_target)
SELECT * FROM a""", ("master",))
def positive_rate_by_snapshot(c: Ctx):
    """Rows, positive rate and the positives' log-target profile per
    snapshot, plus exact medians of key features (drift)."""
    from panelscope.functions.exprs import fround
    from panelscope.operators.distribution import exact_percentiles
    m = _staged_master(c)
    pos = F.col("target_1m_bin") == 1
    a = m.groupBy("date_target").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("target_1m_bin").alias("positive_rate"),
        F.round(F.avg(F.when(pos, F.col("target_1m_log"))), 9).alias("mean_log_pos"),
        fround(F.stddev_samp(F.when(pos, F.col("target_1m_log")))).alias("std_log_pos"))
    p95 = exact_percentiles(m.filter(pos), "target_1m_log", {"p95_log_pos": 0.95}, ["date_target"])
    pairs = ", ".join(f"'{x}', CAST({x} AS DOUBLE)" for x in _DRIFT)
    long = m.selectExpr("date_target", f"stack({len(_DRIFT)}, {pairs}) as (_f, _v)")
    med = exact_percentiles(long, "_v", {"_med": 0.5}, ["date_target", "_f"])
    wide = med.groupBy("date_target").pivot("_f", _DRIFT).agg(F.first("_med"))
    wide = wide.select("date_target", *[F.col(x).alias(f"median_{x}") for x in _DRIFT])
    return a.join(p95, "date_target", "left").join(wide, "date_target", "left")


@register("feature_report", f"""
WITH prof AS ({_profile_sql()}),
tr AS (SELECT * FROM master WHERE date_target < {TEST}),
top AS (SELECT feature, pct_missing FROM prof ORDER BY pct_missing DESC, feature LIMIT 10)
SELECT 'counts' AS section, 'n_train_rows' AS metric, CAST((SELECT count(*) FROM tr) AS DOUBLE) AS value
UNION ALL SELECT 'counts', 'n_test_rows',
  CAST((SELECT count(*) FROM master WHERE date_target = {TEST}) AS DOUBLE)
UNION ALL SELECT 'counts', 'n_features', CAST({len(FEATURES)} AS DOUBLE)
UNION ALL SELECT 'target', 'positive_rate_train', (SELECT avg(target_1m_bin) FROM tr)
UNION ALL SELECT 'missing', 'mean_missing_rate', (SELECT avg(pct_missing) FROM prof)
UNION ALL SELECT 'missing_top10', feature, pct_missing FROM top
""" + "".join(f"\nUNION ALL SELECT 'family', '{fam}', CAST({n} AS DOUBLE)" for fam, n in sorted(
    {f: list(FAMILIES.values()).count(f) for f in set(FAMILIES.values())}.items())), ("master",))
def feature_report(c: Ctx):
    """Long (section, metric, value) feature report: sizes, positive
    rate, top-10 missing features and family sizes - one plan of small parts."""
    from panelscope.operators.quality import rows_from
    m = _staged_master(c)
    tr = m.filter(F.col("date_target") < F.lit(c.test_snapshot))
    te = m.filter(F.col("date_target") == F.lit(c.test_snapshot))
    prof = _profile(c)
    fams = {f: list(FAMILIES.values()).count(f) for f in set(FAMILIES.values())}
    scal = [("counts", "n_train_rows", tr.agg(F.count(F.lit(1))).scalar().cast("double")),
            ("counts", "n_test_rows", te.agg(F.count(F.lit(1))).scalar().cast("double")),
            ("counts", "n_features", F.lit(float(len(FEATURES)))),
            ("target", "positive_rate_train", tr.agg(F.avg("target_1m_bin")).scalar()),
            ("missing", "mean_missing_rate", prof.agg(F.avg("pct_missing")).scalar())]
    scal += [("family", fam, F.lit(float(n))) for fam, n in sorted(fams.items())]
    head = rows_from(c.spark.range(1), [[F.lit(s).alias("section"), F.lit(k).alias("metric"),
                                         v.cast("double").alias("value")] for s, k, v in scal])
    top = prof.orderBy(F.col("pct_missing").desc(), "feature").limit(10).select(
        F.lit("missing_top10").alias("section"), F.col("feature").alias("metric"),
        F.col("pct_missing").alias("value"))
    return head.unionByName(top)
