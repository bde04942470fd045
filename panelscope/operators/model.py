"""Two-part spend model on Spark ML: M1-M7, M14, M18.

P(spend > 0) from a weighted logistic regression, E[log spend | spend > 0]
from gradient-boosted trees; the combined score is P * expm1(prediction).
Encoding, imputation and scaling constants are fitted on train rows with
exact aggregates (one row each) and applied as column expressions, so the
same plan runs on train and test.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope import constants as K
from panelscope.functions.exprs import ColumnOrName, col
from panelscope.functions.ranking import ordered_blocks
from panelscope.operators.distribution import exact_percentiles


# ------------------------------------------------------------------ M1 ordinal encoding
def fit_ordinal_codes(train: DataFrame, col: str) -> DataFrame:
    """M1 fit: lexical codes 0..k-1 of the distinct train values (null is the
    string 'nan'). A value's code is the number of distinct values before it,
    counted by value ranges, so that no task holds them all."""
    v = F.coalesce(F.col(col).cast("string"), F.lit("nan"))
    d = train.select(v.alias("_v")).distinct()
    return ordered_blocks(d, "_v").select("_v", F.col("o_c").cast("bigint").alias("_code"))


def apply_ordinal(df: DataFrame, col: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """M1 transform: unseen values -> -1 (codes are joined, AQE broadcasts
    them when they are small)."""
    out = out or f"{col}_code"
    v = F.coalesce(F.col(col).cast("string"), F.lit("nan"))
    j = df.withColumn("_v", v).join(codes, "_v", "left")
    return j.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1).cast("bigint"))).drop("_v", "_code")


def as_nominal(df: DataFrame, code: str, n_codes: int, out: str) -> DataFrame:
    """The code as a category of ``n_codes + 1`` for the trees, told by the
    column's metadata: 0 is a value that train doesn't have, the rest follow."""
    values = {"ml_attr": {"type": "nominal", "name": out, "num_vals": n_codes + 1}}
    return df.withColumn(out, (F.col(code) + F.lit(1)).cast("double")).withMetadata(out, values)


def encode_categories(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """M1 on both sides: ``<col>_code`` by train's values, and how many train has."""
    sizes = {}
    for c in cols:
        codes = fit_ordinal_codes(train, c)
        sizes[c] = codes.count()
        train, test = apply_ordinal(train, c, codes), apply_ordinal(test, c, codes)
    return train, test, sizes


# ------------------------------------------------------------------ M2 / M3
def fit_medians(train: DataFrame, cols: list[str]) -> dict[str, float]:
    """M2 fit: exact train medians of several columns in one pass (columns
    unpivoted and ranked per column name); the fitted constants - one
    number per column - are the only thing brought to the driver."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = train.selectExpr(f"stack({len(cols)}, {pairs}) as (_feature, _value)")
    med = exact_percentiles(long, "_value", {"_median": 0.5}, ["_feature"], digits=None)
    got = {r["_feature"]: r["_median"] for r in med.collect()}
    return {c: got.get(c) for c in cols}


def apply_medians(df: DataFrame, medians: dict[str, float], cols: list[str]) -> DataFrame:
    """M2 transform: null -> train median (literal constants)."""
    rep = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]).cast("double")).alias(c)
           for c in cols}
    return df.select(*[rep.get(c, F.col(c)) for c in df.columns])


def fit_scaler(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """M3 fit: mean and population std per feature (one aggregation)."""
    row = train.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols],
                    *[F.stddev_pop(c).alias(f"{c}__std") for c in cols]).first()
    return {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in cols}


def apply_scaler(df: DataFrame, stats: dict, cols: list[str], digits: int | None = None) -> DataFrame:
    """M3 transform: (x - mean) / std; a constant column maps to 0."""
    out = {}
    for c in cols:
        m, s = stats[c]
        if m is None or not s:
            z = F.lit(0.0)
        else:
            z = (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s))
            z = F.coalesce(z, F.lit(0.0))
        out[c] = (F.round(z, digits) if digits is not None else z).alias(c)
    return df.select(*[out.get(c, F.col(c)) for c in df.columns])


# ------------------------------------------------------------------ M4
def class_weights(train: DataFrame, label: str) -> DataFrame:
    """M4: balanced weights n / (2 * n_class) per class."""
    total = train.agg(F.count(F.lit(1))).scalar()
    g = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return g.select(label, "n", (total.cast("double") / (F.lit(2.0) * F.col("n").cast("double")))
                    .alias("weight"))


def with_weights(df: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    """Attach the class weight (two-row table, a bounded broadcast)."""
    return df.join(F.broadcast(weights.select(label, "weight")), label, "left")


# ------------------------------------------------------------------ M5 / M6 / M7
def fit_logistic(train: DataFrame, features: list[str], label: str, weight: str = "weight",
                 c_inv: float = K.LOGISTIC_C, max_iter: int = K.LOGISTIC_MAX_ITER):
    """M5: L2 logistic regression. sklearn minimises C*sum(w*loss) + |b|^2/2;
    Spark ML minimises sum(w*loss)/sum(w) + regParam*|b|^2/2, hence
    regParam = 1 / (C * sum(w)). Features are already standardised."""
    sum_w = train.agg(F.sum(weight)).first()[0] or 1.0
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight,
                            maxIter=max_iter, regParam=1.0 / (c_inv * sum_w), elasticNetParam=0.0,
                            standardization=False, tol=K.LOGISTIC_TOLERANCE)
    return asm, lr.fit(asm.transform(train))


def logistic_gradient(rows: DataFrame, features: list[str], label: str, weight: str, coefficients: list[float],
                      intercept: float, c_inv: float = K.LOGISTIC_C) -> DataFrame:
    """M5 check: (feature, gradient) of the mean weighted loss with its L2 penalty
    at the given coefficients, and of the unpenalised intercept; all are 0 at the
    optimum, the loss being convex. One aggregate of built-ins over ``rows``."""
    margin = " + ".join([f"CAST('{intercept!r}' AS DOUBLE)", *[
        f"CAST('{b!r}' AS DOUBLE) * `{f}`" for f, b in zip(features, coefficients)]])
    error = rows.selectExpr(*[f"`{f}`" for f in features], f"CAST(`{weight}` AS DOUBLE) AS w_",
                            f"`{weight}` * (1 / (1 + exp(-({margin}))) - `{label}`) AS e_")
    sums = error.agg(F.expr("sum(w_) AS w_"), F.expr("sum(e_) AS g_"),
                     *[F.expr(f"sum(e_ * `{f}`) AS g{i}_") for i, f in enumerate(features)])
    parts = ["named_struct('feature', 'intercept', 'gradient', try_divide(g_, w_))"]
    parts += [f"named_struct('feature', '{f}', 'gradient', try_divide(g{i}_ + CAST('{b / c_inv!r}' AS DOUBLE), w_))"
              for i, (f, b) in enumerate(zip(features, coefficients))]
    return sums.selectExpr(f"inline(array({', '.join(parts)}))")


def fit_regressor(train_pos: DataFrame, features: list[str], label: str, validation: Column,
                  max_rounds: int = 500, patience: int = 20, first_rounds: int = 32,
                  seed: int = K.SAMPLE_SEED, max_bins: int = 32):
    """M6: boosted trees on the positives' log target (depth 6, step .05,
    row / feature sampling .8, min 10 rows per leaf).

    The number of trees is chosen inside the TRAIN rows: a model of the rows
    outside ``validation`` is evaluated on it after every round, and rounds go
    on (doubling, up to ``max_rounds``) until none of the last ``patience`` was
    better. The model is then fitted on all positives with that many trees.
    Without rows on either side ``first_rounds`` trees are fitted. ``max_bins``
    is at least the number of values of the largest category (``as_nominal``)."""
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    rows = asm.transform(train_pos.withColumn("_validation", validation))

    def boosted(part: DataFrame, rounds: int):
        return GBTRegressor(
            featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=K.TREES_MAX_DEPTH,
            stepSize=K.TREES_STEP, subsamplingRate=K.TREES_SUBSAMPLE,
            featureSubsetStrategy=str(K.TREES_SUBSAMPLE), minInstancesPerNode=K.TREES_MIN_CHILD,
            maxBins=max_bins, seed=seed).fit(part)

    inside, outside = rows.filter("_validation"), rows.filter("NOT _validation")
    rounds = best = first_rounds
    if not (inside.isEmpty() or outside.isEmpty()):
        while True:
            losses = boosted(outside, rounds).evaluateEachIteration(inside, "squared")
            best = 1 + min(range(len(losses)), key=losses.__getitem__)
            if best + patience <= rounds or rounds >= max_rounds:
                break
            rounds = min(2 * rounds, max_rounds)
    return asm, boosted(rows, best)


def combined_spend(p_spend: ColumnOrName, pred_log: ColumnOrName) -> Column:
    """M7: probability of spending x expm1(predicted log spend)."""
    return col(p_spend) * F.expm1(col(pred_log))


def feature_importance(spark, clf, reg, lin_features: list[str], tree_features: list[str]) -> DataFrame:
    """|coefficients| of the classifier and the trees' importances
    (model metadata, a few dozen rows)."""
    rows = [("logistic", f, float(abs(w))) for f, w in zip(lin_features, clf.coefficients.toArray())]
    rows += [("boosted_trees", f, float(w)) for f, w in zip(tree_features, reg.featureImportances.toArray())]
    return spark.createDataFrame(rows, "model string, feature string, importance double")
