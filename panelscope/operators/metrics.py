"""Ranking and error metrics on scored rows: M8-M13, M16, M17.

Inputs are rows with a ``score`` (higher = more likely / larger), a 0/1
``label`` and, for money metrics, the observed ``actual``. All rank metrics
use score blocks with global offsets (``functions.ranking``), so ties are
handled exactly and no single task ever sees every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope import constants as K
from panelscope.functions.exprs import fround
from panelscope.functions.ranking import ordered_blocks, top_n_sums
from panelscope.operators.distribution import exact_percentiles


def _label_blocks(df: DataFrame, score: str, label: str, descending: bool) -> DataFrame:
    return ordered_blocks(df, score, {"tp": F.col(label).cast("bigint")}, (), descending)


def average_precision(df: DataFrame, score: str = "score", label: str = "label",
                      digits: int = 9) -> DataFrame:
    """M8: step-wise AP (sum of recall steps times precision at every
    distinct score threshold, ties entering together), prevalence and lift.
    Spark's areaUnderPR is trapezoidal, so it is not used."""
    b = _label_blocks(df, score, label, descending=True)
    tp, otp, c, oc = (F.col(x).cast("double") for x in ("tp", "o_tp", "c", "o_c"))
    g = b.agg(F.sum(tp * (otp + tp) / (oc + c)).alias("_s"),
              F.first("tp_total").cast("double").alias("_p"),
              F.first("n_total").cast("double").alias("_n"))
    ap = F.try_divide(F.col("_s"), F.col("_p"))
    prev = F.col("_p") / F.col("_n")
    return g.select(F.round(ap, digits).alias("average_precision"), prev.alias("prevalence"),
                    F.round(F.try_divide(ap, prev), digits).alias("lift"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", digits: int = 9) -> DataFrame:
    """M9: Mann-Whitney AUC with mid-ranks for ties: a block of c rows after
    o smaller ones has mean rank o + (c + 1) / 2."""
    b = _label_blocks(df, score, label, descending=False)
    tp, c, oc = (F.col(x).cast("double") for x in ("tp", "c", "o_c"))
    g = b.agg(F.sum(tp * (oc + (c + 1) / 2)).alias("_r"),
              F.first("tp_total").cast("double").alias("_p"),
              F.first("n_total").cast("double").alias("_n"))
    p, n = F.col("_p"), F.col("_n") - F.col("_p")
    auc = F.try_divide(F.col("_r") - p * (p + 1) / 2, p * n)
    return g.select(F.round(auc, digits).alias("roc_auc"))


def recall_at_top(df: DataFrame, fraction: float = K.TOP_DECILE, score: str = "score",
                  label: str = "label", tiebreak: str = "client_id") -> DataFrame:
    """Positives among the top max(1, n*fraction) rows (ties broken by
    ``tiebreak``) over all positives."""
    k = F.greatest(F.lit(1), F.floor(F.col("n_total").cast("double") * F.lit(fraction)))
    t = top_n_sums(df, score, tiebreak, {"top": k}, {"tp": F.col(label).cast("double")})
    total_pos = df.agg(F.sum(F.col(label))).scalar()
    return t.select("n_total", "n_top", F.col("tp").cast("bigint").alias("n_positive_in_top"),
                    total_pos.cast("bigint").alias("n_positive"),
                    F.try_divide(F.col("tp"), total_pos.cast("double")).alias("recall_top"))


def revenue_capture(df: DataFrame, pcts=K.CAPTURE_TOP_SHARES, score: str = "score",
                    actual: str = "actual", tiebreak: str = "client_id") -> DataFrame:
    """For each top share of rows by score: rows, revenue and % of the
    total revenue (money summed as DECIMAL, so shares are exact)."""
    cuts = {f"top_{int(round(p * 100))}pct":
            F.greatest(F.lit(1), F.floor(F.col("n_total").cast("double") * F.lit(float(p))))
            for p in pcts}
    t = top_n_sums(df, score, tiebreak, cuts, {"revenue": F.col(actual).cast("decimal(18,4)")})
    total = df.agg(F.sum(F.col(actual).cast("decimal(18,4)"))).scalar().cast("double")
    return t.select("cut", "n_top", F.col("revenue").cast("double").alias("revenue"),
                    F.try_divide(F.col("revenue").cast("double") * F.lit(100.0),
                                 F.when(total != 0, total)).alias("pct_of_total"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Precision / recall at every distinct score threshold."""
    b = _label_blocks(df, score, label, descending=True)
    cum_tp = (F.col("o_tp") + F.col("tp")).cast("double")
    cum_n = (F.col("o_c") + F.col("c")).cast("double")
    return b.select(score, (cum_tp / cum_n).alias("precision"),
                    F.try_divide(cum_tp, F.col("tp_total").cast("double")).alias("recall"))


def regression_metrics(df: DataFrame, pred_log: str, true_log: str, pred: str, actual: str,
                       baseline_log, digits: int = 6) -> DataFrame:
    """RMSE / MAE in log space, RMSE / MAE / median AE in money,
    baseline RMSE of a constant prediction and the improvement in %."""
    e = F.col(pred_log) - F.col(true_log)
    eb = F.lit(baseline_log) if not hasattr(baseline_log, "alias") else baseline_log
    m = df.agg(F.sqrt(F.avg(e * e)).alias("rmse_log"), F.avg(F.abs(e)).alias("mae_log"),
               F.sqrt(F.avg((eb - F.col(true_log)) * (eb - F.col(true_log)))).alias("baseline_rmse_log"),
               F.sqrt(F.avg((F.col(pred) - F.col(actual)) * (F.col(pred) - F.col(actual))))
               .alias("rmse_eur"),
               F.avg(F.abs(F.col(pred) - F.col(actual))).alias("mae_eur"))
    ae = df.select(F.abs(F.col(pred) - F.col(actual)).alias("_ae"))
    med = exact_percentiles(ae, "_ae", {"m": 0.5}).agg(F.first("m")).scalar()
    imp = F.lit(100.0) * (F.col("baseline_rmse_log") - F.col("rmse_log")) / F.col("baseline_rmse_log")
    return m.select(*[F.round(F.col(x), digits).alias(x) for x in
                      ("rmse_log", "mae_log", "baseline_rmse_log", "rmse_eur", "mae_eur")],
                    med.alias("median_ae_eur"), F.round(imp, digits).alias("improvement_pct"))


def combined_error(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """MAE and median absolute error of the combined prediction."""
    ae = df.select(F.abs(F.col(pred) - F.col(actual)).alias("_ae"))
    med = exact_percentiles(ae, "_ae", {"m": 0.5}).agg(F.first("m")).scalar()
    return ae.agg(fround(F.avg("_ae")).alias("mae"), F.count(F.lit(1)).alias("n")).select(
        "n", "mae", med.alias("median_ae"))


def sample_key(key: str, seed: int) -> Column:
    """The order of a seeded sample; its first k rows are the sample."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
