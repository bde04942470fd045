"""Categories in the models, the optimality check of the classifier, seeded
samples and optional sources."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelscope.operators import metrics as M
from panelscope.operators import model as ML
from panelscope.sources.tables import SCHEMAS, scan_optional


def rows(n=600, seed=4):
    rng = np.random.default_rng(seed)
    x, z, place = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 4, n)
    p = 1 / (1 + np.exp(-(1.5 * x - 0.5 * z)))
    y = (rng.random(n) < p).astype(int)
    # the spend follows the place, in no order of its names
    log = np.array([5.0, 1.0, 7.0, 2.0])[place] + 0.01 * x
    return [(float(a), float(b), f"p{k}" if k else None, int(t), 1.0 + int(t), float(v), i % 5 == 0)
            for i, (a, b, k, t, v) in enumerate(zip(x, z, place, y, log))]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(rows(), "x double, z double, place string, y int, weight double, t double, "
                                         "last boolean").repartition(3).checkpoint()


def test_gradient_is_zero_at_the_optimum_only(train):
    features = ["x", "z"]
    _, clf = ML.fit_logistic(train, features, "y")
    at = [float(b) for b in clf.coefficients.toArray()]

    def gradient(coefficients, intercept=float(clf.intercept)):
        return {r["feature"]: r["gradient"] for r in ML.logistic_gradient(
            train, features, "y", "weight", coefficients, intercept).collect()}

    assert all(abs(g) < 1e-4 for g in gradient(at).values())
    off = gradient([at[0] + 0.05, at[1]])
    data = [(r[0], r[1], r[3], r[4]) for r in rows()]
    total = sum(w for *_, w in data)
    error = [w * (1 / (1 + math.exp(-(clf.intercept + (at[0] + 0.05) * x + at[1] * z))) - y) for x, z, y, w in data]
    assert off["x"] == pytest.approx((sum(e * r[0] for e, r in zip(error, data)) + at[0] + 0.05) / total, abs=1e-12)
    assert off["intercept"] == pytest.approx(sum(error) / total, abs=1e-12) and abs(off["x"]) > 1e-3


def test_trees_split_categories_as_sets(spark, train):
    test = spark.createDataFrame([(0.0, "p9"), (0.0, "p2"), (0.0, None)], "x double, place string")
    a, b, sizes = ML.encode_categories(train, test, ["place"])
    assert sizes == {"place": 4}
    a, b = (ML.as_nominal(df, "place_code", sizes["place"], "place_category") for df in (a, b))
    assert sorted((r["place"] or "", r["place_category"]) for r in b.select("place", "place_category").collect()) == [
        ("", 1.0), ("p2", 3.0), ("p9", 0.0)]  # 'nan' comes first; p9 is not in train
    asm, model = ML.fit_regressor(a.select("x", "place_category", "t", "last"), ["x", "place_category"], "t",
                                  F.col("last"), max_rounds=8, patience=2, first_rounds=4)
    split = [line for line in model.toDebugString.splitlines() if "feature 1 in {" in line]
    assert split and asm.transform(b).count() == 3
    assert model.featureImportances[1] > 0.9 and model.transform(asm.transform(b)).count() == 3


def test_seeded_sample_is_the_least_md5(spark):
    ids = spark.range(500).select(F.col("id").cast("string").alias("id")).repartition(7)
    got = [r[0] for r in ids.orderBy(M.sample_key("id", 7), "id").limit(20).collect()]
    assert got == sorted(map(str, range(500)), key=lambda i: hashlib.md5(f"{i}:7".encode()).hexdigest())[:20]


def test_optional_source_skips_absent_paths_only(spark, tmp_path):
    path = str(tmp_path / "there")
    spark.range(3).withColumnRenamed("id", "r_regionkey").write.parquet(path)
    assert scan_optional(spark, [str(tmp_path / "absent"), path], SCHEMAS["region"]).count() == 3
    none = scan_optional(spark, [str(tmp_path / "absent")], SCHEMAS["region"])
    assert none.count() == 0 and none.schema == SCHEMAS["region"]
    with pytest.raises(PySparkException):  # a bad address is an error, no absent file
        scan_optional(spark, [""], SCHEMAS["region"])
