"""As-of features and cleaning rules on a tiny fixture with the boundary
cases of the reference semantics (event exactly at DT and at DT - 1y,
same-day events, a single-event client, a Feb-29 snapshot, nulls)."""

import datetime as dt

from pyspark.sql import functions as F

from panelscope.operators import cleaning as CL
from panelscope.operators import features as FE

D = dt.date
DATES = [D(2019, 1, 1), D(2020, 2, 29)]
TRS = [  # client, article, date, categ, channel, spend, wwprice, flag_he
    (1, 10, D(2020, 2, 29), "Sale", "Boutique", 100.0, 100.0, 0),      # exactly at DT
    (2, 11, D(2019, 2, 28), "Sale", "Web", 50.5, 60.0, 1),            # exactly DT - 1y (Feb 28)
    (2, 11, D(2019, 6, 1), "Sale", "Boutique", 20.25, 20.0, 0),
    (2, 12, D(2019, 6, 1), "Repair", "Boutique", None, 0.0, 0),        # same day, null spend
    (2, 13, D(2018, 12, 31), "Sale", "CC", 10.0, 0.0, 0),
    (3, 14, D(2020, 3, 1), "Sale", "Web", 5.0, 5.0, 0),                # after every snapshot
    (4, 15, D(2017, 12, 1), "Sale", "CC", None, None, 0),              # sale, no price
    (4, 15, D(2017, 2, 28), "Sale", "Web", -3.0, 3.0, 0),              # negative
]
SCHEMA = ("client_id long, article_id long, trs_date date, trs_categ string, channel string, "
          "spend double, wwprice double, flag_he int")


def _trs(spark):
    return spark.createDataFrame(TRS, SCHEMA)


def _snaps(spark):
    return spark.createDataFrame([(d,) for d in DATES], "date_target date")


def test_rfm_boundaries(spark):
    r = {(x["client_id"], x["date_target"]): x for x in
         FE.rfm_features(_trs(spark), _snaps(spark), 1, 2, dates=DATES).collect()}
    assert (3, D(2020, 2, 29)) not in r                       # only a future event
    one = r[(1, D(2020, 2, 29))]                              # event exactly at DT counts
    assert one["n_transactions"] == 1 and one["recency_days"] == 0
    assert one["avg_days_between_trs"] == 0.0                 # single event
    two = r[(2, D(2020, 2, 29))]
    # recent window is (DT - 1y, DT]; Feb 29 - 1y clamps to Feb 28, which is NOT recent
    assert two["spend_recent"] == 20.25 and two["spend_prior"] == 60.5
    assert two["n_transactions"] == 4 and two["n_distinct_articles"] == 3
    assert two["n_repair_trs"] == 1 and two["total_spend"] == 80.75
    assert abs(two["avg_days_between_trs"] - (D(2019, 6, 1) - D(2018, 12, 31)).days / 3) < 1e-12
    four = r[(4, D(2019, 1, 1))]
    assert four["total_spend"] == -3.0 and four["spend_trend"] == 1.0


def test_incremental_asof_equals_expansion(spark):
    t, s = _trs(spark), _snaps(spark)
    a = FE.rfm_features(t, s, 1, 2, dates=DATES)
    b = FE.rfm_features(t, s, 1, 2)
    cols = sorted(a.columns)
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    lag = {(x[0], x[1]): x[2] for x in FE.avg_gap_lag_form(t, s).collect()}
    for x in a.collect():
        assert abs(lag[(x["client_id"], x["date_target"])] - x["avg_days_between_trs"]) < 1e-12


def test_asof_set_union(spark):
    t = _trs(spark)
    got = {(x["client_id"], x["date_target"]): x["arts"] for x in
           FE.asof_set_union(t, DATES, "client_id", {"arts": F.col("article_id")}).collect()}
    for cid in (1, 2, 3, 4):
        for d in DATES:
            ref = sorted({r[1] for r in TRS if r[0] == cid and r[2] <= d})
            assert got.get((cid, d), []) == ref or (not ref and (cid, d) not in got)


def test_cleaning_rules(spark):
    ev = CL.clean_events(_trs(spark).withColumn("serial_number", F.lit("X")), "X")
    rows = {(r["client_id"], r["trs_date"]): r for r in ev.collect()}
    assert (4, D(2017, 2, 28)) not in rows                    # negative dropped, null kept
    assert rows[(4, D(2017, 12, 1))]["spend"] == 0.0          # sale without price -> 0
    assert rows[(4, D(2017, 12, 1))]["spend_imputed"] == 1
    assert rows[(2, D(2018, 12, 31))]["wwprice_missing"] == 1
    assert all(r["serial_number_known"] == 0 for r in rows.values())
    again = CL.clean_events(ev.withColumn("serial_number", F.lit("Y")), "X")
    assert again.count() == ev.count()                        # idempotent on rows

    reg = spark.createDataFrame(
        [(1, D(2020, 1, 1), D(2020, 1, 31)), (2, D(2020, 1, 1), D(2020, 2, 1)),
         (3, D(2020, 1, 1), None), (4, D(2020, 1, 10), D(2020, 1, 1))],
        "client_id long, creation_date date, sale_date date").withColumn("flag_gift", F.lit(True))
    kept = sorted(r["client_id"] for r in CL.clean_registrations(reg).collect())
    assert kept == [1, 3, 4]                                  # gap 30 kept, 31 dropped, null kept
    crc = spark.createDataFrame([(1, 480.0), (2, 480.5), (3, None)], "client_id long, appointment_duration double")
    assert sorted(r[0] for r in CL.clean_contacts(crc).collect()) == [1, 3]


def test_clients_rules(spark):
    ref = D(2010, 1, 1)
    df = spark.createDataFrame(
        [(1, D(1890, 1, 1), D(2000, 1, 1), D(2000, 1, 1)), (2, D(1995, 1, 1), D(2000, 1, 1), D(2001, 1, 5)),
         (3, D(1960, 5, 5), None, D(2000, 1, 1)), (4, None, D(2000, 1, 1), D(1998, 12, 31))],
        "client_id long, birth_date date, first_purchase_date date, first_transaction_date date")
    out = {r["client_id"]: r for r in CL.clean_clients(df, ref).collect()}
    assert out[1]["birth_date"] is None and out[2]["birth_date"] is None
    assert out[3]["birth_date_valid"] == 1 and out[3]["purchase_date_anomaly"] == 0
    assert out[2]["purchase_date_anomaly"] == 1 and out[4]["purchase_date_anomaly"] == 1


def test_asof_distinct_count_bruteforce(spark):
    t = _trs(spark)
    got = {(r["client_id"], r["date_target"]): r["n"] for r in
           FE.asof_distinct_count(t, DATES, "client_id", "article_id", name="n").collect()}
    for cid in (1, 2, 3, 4):
        for d in DATES:
            ref = len({r[1] for r in TRS if r[0] == cid and r[2] <= d})
            assert got.get((cid, d), 0) == ref
