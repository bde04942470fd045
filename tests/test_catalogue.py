"""Column catalogue: roles travel with the columns; audits over all columns."""

import datetime as dt

from panelscope.operators import quality as Q
from panelscope.sources.catalogue import CONTRACTS, described, noted

DAYS = (dt.date(1999, 1, 1), dt.date(2000, 1, 1))


def panel(spark):
    rows = [("a", DAYS[0], 1.0, None, "F"), ("a", DAYS[1], 1.0, None, "F"), ("b", DAYS[1], None, 3, "M"),
            ("b", DAYS[0], 2.0, 4, None), ("c", DAYS[1], None, 5, "M")]
    return spark.createDataFrame(rows, "client_id string, date_target date, target_1m double, recency long, gender string")


def test_roles_travel_with_columns(spark):
    d = described(panel(spark), "panel")
    want = {"client_id": "TEMPORAL_ID", "date_target": "TEMPORAL_ID", "target_1m": "TARGET",
            "recency": "RISK_LEAKAGE", "gender": "STATIC"}
    assert noted(d, "role") == want
    part = d.filter("recency > 3").select("gender", "recency").withColumnRenamed("gender", "g")
    assert noted(part, "role") == {"g": "STATIC", "recency": "RISK_LEAKAGE"}
    assert noted(d, "expected_type")["recency"] == CONTRACTS["panel"]["recency"] == "bigint"
    got = {r["column_name"]: (r["role"], r["n_columns_of_role"], r["pct_null"]) for r in
           Q.column_roles(d, noted(d, "role")).collect()}
    assert got["client_id"] == ("TEMPORAL_ID", 2, 0.0) and got["recency"] == ("RISK_LEAKAGE", 1, 40.0)


def test_missing_by_snapshot_takes_columns_by_their_nulls(spark):
    labels = {str(d): f"s{d.year}" for d in DAYS}
    got = {r["column_name"]: (r["s1999"], r["s2000"]) for r in
           Q.missing_by_snapshot(panel(spark), "date_target", labels, threshold=30.0).collect()}
    assert got == {"target_1m": (0.0, 200 / 3), "recency": (50.0, 100 / 3)}
    assert Q.missing_by_snapshot(panel(spark).limit(0), "date_target", labels).count() == 0


def test_varying_columns_and_notes(spark):
    got = {r["column_name"]: r["n_varying"] for r in
           Q.varying_columns(panel(spark), "client_id", ["target_1m", "recency", "gender"]).collect()}
    assert got == {"target_1m": 0, "recency": 1, "gender": 0}
    table = spark.createDataFrame([("b", "1/2/99"), ("a", None)], "client_id string, sale_date string")
    notes = {r["column_name"]: r["note"] for r in Q.schema_check(
        table, "t", {"client_id": "string", "sale_date": "date"}, "client_id").collect()}
    assert notes == {"client_id": "least: a", "sale_date": "dates as text"}
