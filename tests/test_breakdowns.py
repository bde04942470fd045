"""Cleaning validation against a raw table, and the breakdown reports against
plain Python."""

from panelscope.operators import cleaning as CL


def test_validation_sees_lost_targets_added_rows_and_bad_flags(spark):
    raw = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "client_id string, t double")
    good = raw.filter("client_id IS NOT NULL").selectExpr("*", "1 AS f")
    checks = [("flag_f", "f IN (0, 1)")]
    out = {r["check_name"]: (r["n_violations"], r["status"])
           for r in CL.validate_table(good, "x", checks, raw, ("t",)).collect()}
    assert out == {"flag_f": (0, "PASS"), "rows_not_increased": (0, "PASS"), "t_untouched": (0, "PASS")}
    bad = spark.createDataFrame([("a", None, 2), ("b", None, 1), ("c", None, None), ("d", None, 0)],
                                "client_id string, t double, f int")
    out = {r["check_name"]: r["n_violations"] for r in CL.validate_table(bad, "x", checks, raw, ("t",)).collect()}
    assert out == {"flag_f": 2, "rows_not_increased": 1, "t_untouched": 1}


def test_validation_of_empty_tables(spark):
    none = spark.createDataFrame([], "client_id string, t double")
    out = CL.validate_table(none, "x", [("key", "client_id IS NOT NULL")], none, ("t",)).collect()
    assert {r["n_violations"] for r in out} == {0}


def test_decisions_and_outliers_name_every_rule_once():
    from panelscope.plans.q_breakdowns import _DECISIONS, _OUTLIERS
    names = [(t, r[0]) for t, rules in _DECISIONS.items() for r in rules]
    assert len(names) == len(set(names)) == 25
    assert sum(map(len, _OUTLIERS.values())) == 12
