"""Model-pipeline queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelscope import constants as K
from panelscope.operators import features as FE
from panelscope.operators import model as ML
from panelscope.operators.quality import rows_from
from panelscope.plans import q_metrics as QM
from panelscope.plans.q_features import _master
from panelscope.plans.q_selection import _DECISION_SQL, NUM_FEATURES, _lst
from panelscope.plans.registry import Ctx, register
from panelscope.session import forget, stored

TEST = "DATE '2000-01-01'"
LAST_TRAIN = dt.date(1999, 1, 1)
CATEGORICAL = ["gender", "residency_country", "residency_market"]
IMPUTE = ["avg_spend_per_trs", "max_single_spend", "avg_article_world_price",
          "max_article_world_price", "flag_he_ratio", "flag_bridal_ratio", "flag_diamond_ratio"]
SCALE = ["to_full_hist", "nb_trs_full_hist", "recency", "seniority"]
# one of the channel totals is the sum of the others minus the rest: drop it
# from the linear model (collinear), keep it for the trees
COLLINEAR = ("to_btq",)


def _split(c: Ctx, columns: list[str]):
    """Train and test of a few columns, staged: several jobs read them."""
    return FE.temporal_split(c.staged(_master(c).select("client_id", "date_target", *columns)), c.test_snapshot)


@register("assemble_features", f"""
SELECT CASE WHEN date_target < {TEST} THEN 'train' ELSE 'test' END AS split,
  count(*) AS n_rows, CAST(sum(target_1m_bin) AS BIGINT) AS n_positive,
  count(*) FILTER (WHERE date_target = DATE '1999-01-01') AS n_last_train_snapshot
FROM master WHERE date_target <= {TEST} GROUP BY 1""", ("master",))
def assemble_features(c: Ctx):
    """Rows, positives and last-train-snapshot rows per side."""
    m = _master(c).filter(F.col("date_target") <= F.lit(c.test_snapshot))
    side = F.when(F.col("date_target") < F.lit(c.test_snapshot), "train").otherwise("test")
    return m.groupBy(side.alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("target_1m_bin").cast("bigint").alias("n_positive"),
        F.count_if(F.col("date_target") == F.lit(LAST_TRAIN)).alias("n_last_train_snapshot"))


def _codes_sql(col: str) -> str:
    return (f"(SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS BIGINT) AS code FROM "
            f"(SELECT DISTINCT coalesce(CAST({col} AS VARCHAR), 'nan') AS v FROM master "
            f"WHERE date_target < {TEST}) d)")


@register("ordinal_encode", "SELECT t.client_id, t.date_target, " + ", ".join(
    f"coalesce(k{i}.code, -1) AS {col}_code" for i, col in enumerate(CATEGORICAL))
    + f" FROM (SELECT * FROM master WHERE date_target = {TEST}) t " + " ".join(
    f"LEFT JOIN {_codes_sql(col)} k{i} ON coalesce(CAST(t.{col} AS VARCHAR), 'nan') = k{i}.v"
    for i, col in enumerate(CATEGORICAL)), ("master",))
def ordinal_encode(c: Ctx):
    """M1: codes fitted on train, applied to test (unseen -> -1)."""
    train, out = _split(c, CATEGORICAL)
    for col in CATEGORICAL:
        out = ML.apply_ordinal(out, col, ML.fit_ordinal_codes(train, col))
    return out.select("client_id", "date_target", *[f"{x}_code" for x in CATEGORICAL])


@register("impute_median", "SELECT client_id, date_target, " + ", ".join(
    f"coalesce(CAST({x} AS DOUBLE), (SELECT quantile_cont({x}, 0.5) FROM master "
    f"WHERE date_target < {TEST} AND {x} IS NOT NULL)) AS {x}" for x in IMPUTE)
    + f" FROM master WHERE date_target = {TEST}", ("master",))
def impute_median(c: Ctx):
    """M2: exact train medians fill the test nulls."""
    train, test = _split(c, IMPUTE)
    med = ML.fit_medians(train, IMPUTE)
    return ML.apply_medians(test, med, IMPUTE)


def _scale_sql() -> str:
    cols = []
    for x in SCALE:
        m = f"(SELECT avg({x}) FROM master WHERE date_target = DATE '1999-01-01')"
        s = f"(SELECT stddev_pop({x}) FROM master WHERE date_target = DATE '1999-01-01')"
        cols.append(f"round(coalesce((CAST({x} AS DOUBLE) - {m}) / CASE WHEN {s} > 0 THEN {s} END, "
                    f"0.0), 9) AS {x}")
    return f"SELECT client_id, date_target, {', '.join(cols)} FROM master WHERE date_target = {TEST}"


@register("standardize", _scale_sql(), ("master",))
def standardize(c: Ctx):
    """M3: z-scores with the mean / population std of the classifier's
    training rows (last train snapshot)."""
    train, test = _split(c, SCALE)
    stats = ML.fit_scaler(train.filter(F.col("date_target") == F.lit(LAST_TRAIN)), SCALE)
    return ML.apply_scaler(test, stats, SCALE, digits=9)


@register("class_weights", f"""
SELECT target_1m_bin, count(*) AS n,
  CAST((SELECT count(*) FROM master WHERE date_target = DATE '1999-01-01') AS DOUBLE)
    / (2.0 * CAST(count(*) AS DOUBLE)) AS weight
FROM master WHERE date_target = DATE '1999-01-01' GROUP BY target_1m_bin""", ("master",))
def class_weights(c: Ctx):
    """M4: balanced weights on the classifier's training rows."""
    fit_rows = _master(c).filter(F.col("date_target") == F.lit(LAST_TRAIN))
    return ML.class_weights(fit_rows, "target_1m_bin")


def _prepared(c: Ctx) -> tuple[DataFrame, DataFrame, list[str], dict[str, int]]:
    """Train and test as the stored selection leaves them, categories coded and
    medians imputed (all fitted on train), the numeric features that are left,
    and how many values each category has."""
    if "prepared" not in c._cache:
        from panelscope.operators.selection import nullable_columns
        from panelscope.plans.q_selection import _reduced
        train, test = _reduced(c)
        numeric = [x for x in NUM_FEATURES if x in train.columns]
        train, test, sizes = ML.encode_categories(train, test, [x for x in CATEGORICAL if x in train.columns])
        nullable = sorted(nullable_columns(train, numeric) | set(IMPUTE) & set(numeric))
        med = ML.fit_medians(train, nullable)
        # fitting reads both in many passes: stored once in the shared folder, in place of what it comes from
        before = c._cache.pop("reduced")
        train, test = (stored(ML.apply_medians(df, med, nullable)) for df in (train, test))
        forget(*before)
        c._cache["prepared"] = (train, test, numeric, sizes)
    return c._cache["prepared"]


def _linear_features(c: Ctx) -> list[str]:
    _, _, numeric, sizes = _prepared(c)
    return [x for x in numeric if x not in COLLINEAR] + [f"{x}_code" for x in sizes]


def _tree_features(c: Ctx) -> list[str]:
    _, _, numeric, sizes = _prepared(c)
    return numeric + [f"{x}_category" if n < K.TREES_MAX_CATEGORIES else f"{x}_code" for x, n in sizes.items()]


def _with_categories(c: Ctx, df: DataFrame) -> DataFrame:
    for x, n in _prepared(c)[3].items():
        df = ML.as_nominal(df, f"{x}_code", n, f"{x}_category")
    return df


def _linear_train(c: Ctx, fit_snapshot: dt.date = LAST_TRAIN) -> tuple[DataFrame, dict]:
    """The classifier's rows, scaled and weighted, and the scaler's constants."""
    features = _linear_features(c)
    rows = _prepared(c)[0].filter(F.col("date_target") == F.lit(fit_snapshot))
    stats = ML.fit_scaler(rows, features)
    rows = ML.apply_scaler(rows, stats, features)
    rows = ML.with_weights(rows, ML.class_weights(rows, "target_1m_bin"), "target_1m_bin")
    return rows.select(*features, "target_1m_bin", "weight"), stats


def _classifier(c: Ctx, fit_snapshot: dt.date = LAST_TRAIN):
    """M5, fitted on the rows of ``fit_snapshot``: scaler, assembler, model."""
    key = ("classifier", fit_snapshot)
    if key not in c._cache:
        rows, stats = _linear_train(c, fit_snapshot)
        c._cache[key] = (stats, *ML.fit_logistic(rows, _linear_features(c), "target_1m_bin"))
    return c._cache[key]


def _regressor(c: Ctx, fit_snapshot: dt.date = LAST_TRAIN):
    """M6: assembler and model; ``fit_snapshot`` chooses the rounds."""
    key = ("regressor", fit_snapshot)
    if key not in c._cache:
        pos = _with_categories(c, _prepared(c)[0].filter(F.col("target_1m_bin") == 1))
        bins = max([32, *[n + 1 for n in _prepared(c)[3].values() if n < K.TREES_MAX_CATEGORIES]])
        c._cache[key] = ML.fit_regressor(pos, _tree_features(c), "target_1m_log",
                                         F.col("date_target") == F.lit(fit_snapshot), max_bins=bins)
    return c._cache[key]


def _p_spend(c: Ctx, fit_snapshot: dt.date = LAST_TRAIN) -> DataFrame:
    stats, asm, clf = _classifier(c, fit_snapshot)
    features = _linear_features(c)
    rows = ML.apply_scaler(_prepared(c)[1].select("client_id", *features), stats, features)
    return clf.transform(asm.transform(rows)).select(
        "client_id", vector_to_array("probability")[1].alias("p_spend"))


def _pred_log(c: Ctx, fit_snapshot: dt.date = LAST_TRAIN) -> DataFrame:
    asm, reg = _regressor(c, fit_snapshot)
    return reg.transform(asm.transform(_with_categories(c, _prepared(c)[1]))).select(
        "client_id", "date_target", "target_1m", F.col("prediction").alias("pred_log"))


@register("logistic_certificate", _DECISION_SQL + f""",
fit AS (SELECT count(*) AS n_rows, CAST(sum(target_1m_bin) AS BIGINT) AS n_positive
        FROM master WHERE date_target = DATE '{LAST_TRAIN}'),
names AS (SELECT CASE WHEN feature IN ({_lst(CATEGORICAL)}) THEN feature || '_code' ELSE feature END AS feature
          FROM d WHERE reason = 'kept' AND feature NOT IN ({_lst(COLLINEAR)})
            AND feature IN ({_lst([*NUM_FEATURES, *CATEGORICAL])})
          UNION ALL SELECT 'intercept')
SELECT feature, n_rows, n_positive, true AS optimal FROM names, fit""", ("master",))
def logistic_certificate(c: Ctx):
    """M5 value check: the fitted coefficients are the optimum, as the gradient
    of the penalised loss is 0 (to 1e-4 of a feature's deviation) in each; the
    features are what the selection left, with the coded categories."""
    rows, _ = _linear_train(c)
    _, _, clf = _classifier(c)
    g = ML.logistic_gradient(rows, _linear_features(c), "target_1m_bin", "weight",
                             [float(b) for b in clf.coefficients.toArray()], float(clf.intercept))
    return g.select(
        "feature", rows.agg(F.count(F.lit(1))).scalar().alias("n_rows"),
        rows.agg(F.sum("target_1m_bin").cast("bigint")).scalar().alias("n_positive"),
        F.coalesce(F.abs("gradient") < 1e-4, F.lit(False)).alias("optimal"))


@register("fit_logistic")
def fit_logistic(c: Ctx):
    """M5: P(spend > 0) for every test row (rows-only check: a fitted model)."""
    return _p_spend(c)


@register("fit_spend_regressor")
def fit_spend_regressor(c: Ctx):
    """M6: predicted log spend for the test positives (rows-only)."""
    return _pred_log(c).filter(F.col("target_1m") > 0).select("client_id", "pred_log")


@register("score_two_part")
def score_two_part(c: Ctx):
    """M7: combined prediction P * expm1(log prediction) for every test row."""
    both = _pred_log(c).join(_p_spend(c), "client_id")
    return both.select("client_id", "date_target", "p_spend", "pred_log",
                       ML.combined_spend("p_spend", "pred_log").alias("pred_spend"),
                       F.col("target_1m").alias("actual"))


@register("score_two_part_given", """
SELECT client_id, round(score / (1 + score) * (exp(ln(1 + score)) - 1), 4) AS pred_spend
FROM scored""", ("scored",))
def score_two_part_given(c: Ctx):
    """M7 on given parts: the stand-in score as odds and as spend."""
    p, log = F.col("score") / (1 + F.col("score")), F.log1p("score")
    return c.scored.select("client_id", F.round(ML.combined_spend(p, log), 4).alias("pred_spend"))


@register("feature_importance")
def feature_importance(c: Ctx):
    """|coefficients| and tree importances (model metadata)."""
    clf, reg = _classifier(c)[2], _regressor(c)[1]
    return ML.feature_importance(c.spark, clf, reg, _linear_features(c), _tree_features(c))


# ------------------------------------------------------------------ M15
_SUMMARY = [("classifier", "average_precision", "ap", "average_precision"),
            ("classifier", "prevalence", "ap", "prevalence"),
            ("classifier", "lift", "ap", "lift"),
            ("classifier", "roc_auc", "auc", "roc_auc"),
            ("classifier", "recall_top_decile", "rec", "recall_top"),
            ("regressor", "rmse_log", "reg", "rmse_log"),
            ("regressor", "mae_log", "reg", "mae_log"),
            ("regressor", "baseline_rmse_log", "reg", "baseline_rmse_log"),
            ("regressor", "improvement_pct", "reg", "improvement_pct"),
            ("regressor", "rmse_eur", "reg", "rmse_eur"),
            ("regressor", "mae_eur", "reg", "mae_eur"),
            ("regressor", "median_ae_eur", "reg", "median_ae_eur"),
            ("combined", "mae", "comb", "mae"),
            ("combined", "median_ae", "comb", "median_ae")]

_REC_SQL = """
WITH r AS (SELECT label, row_number() OVER (ORDER BY score DESC, client_id) AS rn,
             count(*) OVER () AS n FROM scored WHERE score IS NOT NULL)
SELECT CAST(sum(label) FILTER (WHERE rn <= greatest(1, floor(CAST(n AS DOUBLE) * 0.1))) AS DOUBLE)
    / CAST(sum(label) AS DOUBLE) AS recall_top FROM r"""


@register("model_summary", f"""
WITH ap AS ({QM._AVERAGE_PRECISION_SQL}), auc AS ({QM._ROC_AUC_SQL}), rec AS ({_REC_SQL}),
reg AS ({QM._REGRESSION_METRICS_SQL}), comb AS ({QM._COMBINED_ERROR_SQL})
""" + "\nUNION ALL\n".join(
    f"SELECT '{sec}' AS section, '{met}' AS metric, CAST((SELECT {col} FROM {src}) AS DOUBLE) AS value"
    for sec, met, src, col in _SUMMARY), ("scored", "panel"))
def model_summary(c: Ctx):
    """Long (section, metric, value) table of the scored metrics."""
    srcs = {"ap": QM.average_precision(c), "auc": QM.roc_auc(c), "rec": QM.recall_top_decile(c),
            "reg": QM.regression_metrics(c), "comb": QM.combined_error(c)}
    one = c.spark.range(1)
    return rows_from(one, [[F.lit(sec).alias("section"), F.lit(met).alias("metric"),
                            srcs[src].agg(F.first(col)).scalar().cast("double").alias("value")]
                           for sec, met, src, col in _SUMMARY])
