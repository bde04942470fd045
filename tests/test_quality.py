"""Audit operators vs. plain-Python definitions."""

import datetime as dt

from pyspark.sql import functions as F

from panelscope.operators import quality as Q


def test_referential_matrix(spark):
    sets = {"a": {1, 2, 3, 4}, "b": {3, 4, 5}, "c": {9}}
    frames = {k: spark.createDataFrame([(x,) for x in v] + [(None,)], "id long") for k, v in sets.items()}
    out = {(r["a"], r["b"]): r for r in Q.referential_matrix(frames, "id").collect()}
    for (a, b), r in out.items():
        assert r["n_intersection"] == len(sets[a] & sets[b])
        assert r["n_only_a"] == len(sets[a] - sets[b]) and r["n_only_b"] == len(sets[b] - sets[a])
    assert len(out) == 3


def test_missing_report_and_placeholder(spark):
    df = spark.createDataFrame([(1, None, "P"), (2, "x", None), (3, "y", "P"), (4, None, "z")],
                               "k long, a string, s string")
    rep = {r["column_name"]: r for r in Q.missing_report(df, "t", 0.0).collect()}
    assert rep["a"]["n_missing"] == 2 and rep["a"]["pct_missing"] == 50.0
    assert rep["k"]["n_missing"] == 0
    prof = Q.placeholder_profile(df.withColumn("d", F.lit("all")), "s", ["d", "a"], "P").collect()
    d = [r for r in prof if r["dimension"] == "d"][0]
    assert (d["n"], d["n_null"], d["n_placeholder"]) == (4, 1, 2)
    assert sum(r["n"] for r in prof if r["dimension"] == "a") == 4   # null value is its own row


def test_date_list_and_coverage(spark):
    D = dt.date
    df = spark.createDataFrame(
        [(D(2000, 1, 1), "1999-01-01,2000-01-01,2000-02-01, n/a,"), (D(2000, 1, 1), None)],
        "date_target date, l string")
    r = Q.date_list_leakage(df, "l").first()
    assert (r["n_ok"], r["n_violations"], r["n_unparsable"]) == (2, 1, 2)
    ev = spark.createDataFrame([(D(1999, 5, 1),), (D(2000, 1, 1),), (D(2001, 1, 1),)], "d date")
    snaps = spark.createDataFrame([(D(1999, 1, 1),), (D(2000, 1, 1),)], "date_target date")
    cov = {x["date_target"]: x for x in Q.temporal_coverage(ev, snaps, "d").collect()}
    assert cov[D(1999, 1, 1)]["n_safe"] == 0 and cov[D(2000, 1, 1)]["n_safe"] == 2
    assert all(x["n_safe"] + x["n_leakage"] == x["n_total"] == 3 and x["monotone"] for x in cov.values())


def test_monotonic_and_rules(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 12.0), (2, 1, 5.0), (2, 2, 4.0)],
                               "client_id long, s int, v double")
    r = Q.monotonic_violations(df, "client_id", "s", ["v"]).first()
    assert r["n_violating_v"] == 1 and r["pct_clean_clients"] == 50.0
    rc = {x["rule"]: x for x in Q.rule_counts(df, "t", [("neg", "v < 5", "x"), ("all", "v > 0", "y")]).collect()}
    assert rc["neg"]["n"] == 1 and rc["all"]["n"] == 4 and rc["all"]["pct"] == 100.0


def test_by_each_dimension_varying_and_schema(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0), (1, "a", "y", 2.0), (2, "b", "x", None),
                                (2, None, "x", 3.0)], "k long, d1 string, d2 string, v double")
    g = {(r["dimension"], r["value"]): r["n"] for r in
         Q.by_each_dimension(df, ["d1", "d2"], [F.count(F.lit(1)).alias("n")]).collect()}
    assert g == {("d1", "a"): 2, ("d1", "b"): 1, ("d1", None): 1, ("d2", "x"): 3, ("d2", "y"): 1}
    vc = {r["column_name"]: r for r in Q.varying_columns(df, "k", ["d1", "d2", "v"]).collect()}
    # nulls are not a value (as pandas nunique): client 2 has d1 = {b}
    assert vc["d2"]["n_varying"] == 1 and vc["d1"]["n_varying"] == 0 and vc["v"]["n_varying"] == 1
    sc = {r["column_name"]: r for r in
          Q.schema_check(df, "t", {"k": "bigint", "d1": "string", "v": "int", "zz": "date"}).collect()}
    assert sc["k"]["type_ok"] and not sc["v"]["type_ok"]
    assert sc["zz"]["detected_type"] == "missing" and sc["d2"]["expected_type"] == "unexpected"
    assert sc["v"]["n_null"] == 1 and sc["v"]["pct_null"] == 25.0
