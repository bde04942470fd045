"""The mergeable as-of state and the Gram matrix against plain Python."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelscope.operators import asof
from panelscope.operators import features as FE
from panelscope.operators import gram
from panelscope.operators import selection as S

D = dt.date
DATES = [D(2019, 1, 1), D(2020, 2, 29), D(2020, 3, 31)]
SCHEMA = ("client_id string, article_id long, trs_date date, trs_categ string, channel string, "
          "spend double, wwprice double, flag_he int, qty long")
ARTICLES = [(i, 10.5 * i if i % 4 else None, f"C{i % 3}", i % 2, int(i == 3), None if i == 2 else 1) for i in range(6)]
DIMENSION = ("article_id long, world_price double, product_category string, flag_he int, flag_bridal int, "
             "flag_diamond int")


def events(seed, n=600):
    rng = random.Random(seed)
    edges = [asof.add_months(d, m) for d in DATES for m in (-24, -12, 0, 1, 3, 12)]
    rows = []
    for _ in range(n):
        day = rng.choice(edges) + dt.timedelta(rng.choice([0, 0, 1, -1, rng.randint(-400, 400)]))
        # one client holds a third of all rows
        client = "hot" if rng.random() < 0.34 else f"c{rng.randint(0, 40)}"
        rows.append((client, rng.choice([None, *range(8)]), rng.choice([day, day, day, None]),
                     rng.choice(["Sale", "Repair"]), rng.choice(["Boutique", "Web", "CC", None]),
                     rng.choice([None, round(rng.uniform(-5, 900), 2)]), rng.choice([None, 3.25, 80.0]),
                     rng.choice([0, 1, None]), rng.choice([None, 1, 4])))
    return rows


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(names).collect()),
                  key=repr)


def test_months_clamp_as_spark_does(spark):
    days = [D(2020, 2, 29), D(2019, 1, 31), D(2000, 12, 31), D(1999, 11, 30)]
    for m in (-36, -12, -1, 0, 1, 3, 13):
        got = spark.createDataFrame([(d,) for d in days], "d date").select(F.add_months("d", m)).collect()
        assert [r[0] for r in got] == [asof.add_months(d, m) for d in days]


@pytest.mark.parametrize("seed", [1, 2])
def test_state_equals_expansion(spark, seed):
    t = spark.createDataFrame(events(seed), SCHEMA).repartition(3)
    snaps = spark.createDataFrame([(d,) for d in DATES], "date_target date")
    assert rows_of(FE.rfm_features(t, snaps, 1, 2, dates=DATES)) == rows_of(FE.rfm_features(t, snaps, 1, 2))
    art = spark.createDataFrame(ARTICLES, DIMENSION)
    assert rows_of(FE.article_features(t, art, snaps, dates=DATES)) == rows_of(FE.article_features(t, art, snaps))


def test_horizons_gaps_and_deviations(spark):
    from panelscope.sources import views as V
    rows = events(3)
    t = spark.createDataFrame(rows, SCHEMA)
    line = FE.timeline_of(DATES, 1, 2, V.TARGET_HORIZONS_MONTHS)
    got = {(r["client_id"], r["date_target"]): r for r in FE.client_history(t, line, gaps=True).select(
        "client_id", "date_target", *V.panel_measures()).collect()}
    seen = 0
    for client in {r[0] for r in rows}:
        for s in DATES:
            mine = [r for r in rows if r[0] == client and r[2] is not None]
            past = [r for r in mine if r[2] <= s]
            assert ((client, s) in got) == bool(past)
            if not past:
                continue
            row, seen = got[client, s], seen + 1
            for name, m in V.TARGET_HORIZONS_MONTHS.items():
                want = sum(r[5] or 0 for r in mine if s < r[2] <= asof.add_months(s, m))
                assert row[name] == pytest.approx(want, abs=0.006)
            spend, days = [r[5] for r in past if r[5] is not None], sorted({r[2] for r in past})
            gaps = [(b - a).days for a, b in zip(days, days[1:])]
            assert row["stddev_price"] == (pytest.approx(statistics.stdev(spend), abs=1e-6) if len(spend) > 1 else None)
            assert row["stddev_timelapse_trs"] == (
                pytest.approx(statistics.stdev(gaps), abs=1e-6) if len(gaps) > 1 else None)
            assert row["avg_timelapse_trs"] == (pytest.approx(statistics.mean(gaps)) if gaps else None)
            assert row["nb_trs_full_hist"] == len(past)
    assert seen > 60


def test_equal_amounts_have_no_deviation(spark):
    t = spark.createDataFrame([("a", 1, D(2018, 1, d), "Sale", "Web", 33333.3333, 1.0, 0, 1) for d in (1, 2, 3)], SCHEMA)
    from panelscope.sources import views as V
    r = FE.client_history(t, V.panel_timeline(["2019-01-01"]), gaps=True).select(*V.panel_measures()).first()
    assert r["stddev_price"] == 0.0 and r["stddev_timelapse_trs"] == 0.0


def test_nothing_gives_nothing(spark):
    t = spark.createDataFrame([("a", 1, D(2030, 1, 1), "Sale", "Web", 1.0, 1.0, 0, 1)], SCHEMA)
    assert FE.rfm_features(t, None, dates=DATES).collect() == []
    assert FE.rfm_features(t.filter("false"), None, dates=DATES).collect() == []


def test_events_are_never_joined_to_snapshots(spark):
    import __spark_entry__ as E
    for name in ("rfm_snapshot_features", "article_features", "build_master_features"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_a_dimension_key_that_repeats_fails_the_job(spark):
    t = spark.createDataFrame(events(4), SCHEMA)
    twice = spark.createDataFrame([*ARTICLES, ARTICLES[2]], DIMENSION)
    with pytest.raises(PySparkException, match="join key is not unique: 2"):
        FE.article_features(t, twice, None, dates=DATES).collect()


# --- Gram matrix --------------------------------------------------------------

def test_correlations_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) * [1, 1e6, 1e-3, 5, 1, 1] + [0, 1e9, 3, 0, 7, 0]
    x[:, 3] = 2 * x[:, 0] + 1e-7 * x[:, 3]
    x[:, 4] = 7.1
    known = rng.random((400, 6)) < [1, 0.7, 0.9, 0.8, 1, 0.003]
    names = list("abcdef")
    df = spark.createDataFrame([tuple(float(v) if k else None for v, k in zip(r, m)) for r, m in zip(x, known)],
                               ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r["left"], r["right"]): r["r"] for r in gram.correlations(df, names).collect()}
    for i, a in enumerate(names):
        for j in range(i + 1, 6):
            both = known[:, i] & known[:, j]
            u, v = x[both, i], x[both, j]
            want = np.corrcoef(u, v)[0, 1] if len(u) > 1 and u.std() > 1e-12 and v.std() > 1e-12 else None
            r = got.get((a, names[j]))
            assert (r is None) == (want is None) and (want is None or abs(r - want) < 1e-9)
    out = S.high_corr_pairs(df, names, 0.95).collect()
    assert ("a", "d") in {(r["feature_1"], r["feature_2"]) for r in out}
    by = {r["feature"]: r["abs_corr"] for r in S.corr_with_target(df, ["d", "e"], "a", {}).collect()}
    assert by["e"] is None and by["d"] == 1.0


def test_correlations_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert gram.correlations(df, ["a", "b"]).collect() == []
    assert [tuple(r) for r in S.corr_with_target(df, ["a"], "b", {}).collect()] == [("a", None, "Other")]
