"""Distribution measures and rank metrics vs. brute-force definitions."""

import random

import numpy as np
from pyspark.sql import functions as F

from panelscope.operators import distribution as D
from panelscope.operators import metrics as M


def _vals(n=300, seed=3):
    rnd = random.Random(seed)
    return [float(rnd.choice([0, 0, 0, 10, 10, rnd.randint(1, 1000)])) for _ in range(n)]


def test_exact_percentiles_match_numpy(spark):
    v = _vals()
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "x double")
    probs = {"p10": 0.1, "p50": 0.5, "p999": 0.999, "p0": 0.0, "p100": 1.0}
    got = D.exact_percentiles(df, "x", probs).first().asDict()
    for k, p in probs.items():
        assert abs(got[k] - float(np.percentile(v, p * 100))) < 1e-6


def test_gini_tie_blocks_equal_rank_formula(spark):
    v = _vals()
    df = spark.createDataFrame([(x,) for x in v], "x double")
    arr = np.sort(np.array([x for x in v if x > 0]))
    n = len(arr)
    ref = 2 * np.sum(np.arange(1, n + 1) * arr) / (n * arr.sum()) - (n + 1) / n
    assert abs(D.gini(df, "x").first()["gini"] - ref) < 1e-9
    assert 0 <= ref < 1


def test_revenue_concentration_bruteforce(spark):
    v = _vals()
    df = spark.createDataFrame([(x,) for x in v], "x double")
    got = D.revenue_concentration(df, "x", (0.01, 0.1, 0.5)).first()
    s = sorted(v, reverse=True)
    for p in (0.01, 0.1, 0.5):
        k = max(1, int(len(s) * p))
        assert abs(got[f"top_{int(round(p * 100))}pct"] - sum(s[:k]) / sum(s) * 100) < 1e-9
    zero = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert D.revenue_concentration(zero, "x", (0.5,)).first()["top_50pct"] is None


def _scored(n=200, seed=11):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = float(rnd.randint(0, 20))          # heavy ties
        y = 1 if rnd.random() < 0.05 + s / 40 else 0
        rows.append((i, s, y, float(y * rnd.randint(1, 500))))
    return rows


def _ap_ref(rows):
    # step-wise AP over distinct thresholds (ties enter together)
    P = sum(r[2] for r in rows)
    ap, tp, n = 0.0, 0, 0
    for s in sorted({r[1] for r in rows}, reverse=True):
        blk = [r for r in rows if r[1] == s]
        tp_b = sum(r[2] for r in blk)
        tp += tp_b
        n += len(blk)
        ap += (tp_b / P) * (tp / n)
    return ap


def test_average_precision_and_auc(spark):
    rows = _scored()
    df = spark.createDataFrame(rows, "client_id long, score double, label int, actual double")
    got = M.average_precision(df).first()
    assert abs(got["average_precision"] - _ap_ref(rows)) < 1e-9
    pos = [r[1] for r in rows if r[2] == 1]
    neg = [r[1] for r in rows if r[2] == 0]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert abs(M.roc_auc(df).first()["roc_auc"] - wins / (len(pos) * len(neg))) < 1e-9
    const = df.withColumn("score", F.lit(1.0))
    c = M.average_precision(const).first()
    assert abs(c["average_precision"] - c["prevalence"]) < 1e-12


def test_recall_top_and_capture(spark):
    rows = _scored()
    df = spark.createDataFrame(rows, "client_id long, score double, label int, actual double")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    k = max(1, len(rows) // 10)
    got = M.recall_at_top(df, 0.1).first()
    assert got["n_positive_in_top"] == sum(r[2] for r in order[:k])
    cap = {r["cut"]: r for r in M.revenue_capture(df, (0.1, 0.3)).collect()}
    tot = sum(r[3] for r in rows)
    for p in (0.1, 0.3):
        kk = max(1, int(len(rows) * p))
        assert abs(cap[f"top_{int(p * 100)}pct"]["pct_of_total"]
                   - sum(r[3] for r in order[:kk]) / tot * 100) < 1e-9


def test_grouped_percentiles_histogram_and_pr_curve(spark):
    rows = [(g, float(v)) for g in ("a", "b") for v in range(1 if g == "a" else 5, 40)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["p"] for r in D.exact_percentiles(df, "x", {"p": 0.3}, ["g"]).collect()}
    for g in ("a", "b"):
        assert abs(got[g] - float(np.percentile([v for k, v in rows if k == g], 30))) < 1e-9
    h = {r["bin"]: r["n"] for r in D.histogram(df.filter("g = 'a'"), "x", 4).collect()}
    ref, _ = np.histogram([v for k, v in rows if k == "a"], bins=4)
    assert [h.get(i, 0) for i in range(4)] == list(ref)
    sc = spark.createDataFrame(_scored(60), "client_id long, score double, label int, actual double")
    pts = M.pr_curve(sc).collect()
    assert all(0 <= p["precision"] <= 1 and 0 <= p["recall"] <= 1 for p in pts)
    assert max(p["recall"] for p in pts) == 1.0


def test_spend_model_uses_all_positives_and_several_trees(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from panelscope.operators.model import fit_regressor

    rnd = random.Random(3)
    rows = []
    for i in range(400):
        x, y = rnd.random(), rnd.random()
        rows.append((x, y, math.log1p(50 * x + 10 * y) + rnd.gauss(0, 0.05), i % 4 == 0))
    df = spark.createDataFrame(rows, "x double, y double, t double, last boolean")
    asm, model = fit_regressor(df, ["x", "y"], "t", F.col("last"), max_rounds=16, patience=3, first_rounds=8)
    assert 1 < model.getNumTrees <= 16
    err = model.transform(asm.transform(df)).select(F.avg(F.pow(F.col("prediction") - F.col("t"), 2))).first()[0]
    spread = df.select(F.var_pop("t")).first()[0]
    assert err < spread
