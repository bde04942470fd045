"""Each report makes its master or panel once and only the columns it reads;
the as-of state is dealt to its snapshots without sorts and with one shuffle of the sets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelscope.operators import features as FE
from panelscope.plans import all_queries
from panelscope.plans import registry
from panelscope.plans.q_selection import ALL_COLS, NUM_FEATURES

DAYS = [dt.date(1997, 1, 1), dt.date(1998, 1, 1), dt.date(1999, 1, 1), dt.date(2000, 1, 1)]
N = 24


@pytest.fixture
def context(spark):
    all_queries()
    return registry.Ctx(spark, "/nonexistent")


def counted(df, column):
    """``df`` and a counter of how often a row's ``column`` is made."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def made(value):
        seen.add(1)
        return value
    mark = F.udf(made, df.schema[column].dataType).asNondeterministic()
    return df.withColumn(column, mark(column)), seen


def master(spark):
    """Every column of the master for N rows: numbers, some null, and text."""
    day = "element_at(array(" + ", ".join(f"DATE'{d}'" for d in DAYS) + "), CAST(id % 4 + 1 AS INT))"
    made = {"client_id": "lpad(CAST(id AS STRING), 20, '0')", "date_target": day}
    for i, x in enumerate(ALL_COLS):
        number = x in NUM_FEATURES or x.startswith("target")
        made.setdefault(x, f"CASE WHEN id % {i + 3} <> 1 THEN CAST(id * {i + 2} % 17 AS DOUBLE) END" if number
                        else f"CASE WHEN id % 5 > 0 THEN CAST(id % 3 AS STRING) END")
    return spark.range(N).selectExpr(*[f"{e} AS `{x}`" for x, e in made.items()]).localCheckpoint()


@pytest.mark.parametrize("name", ["ordinal_encode", "impute_median", "standardize", "high_missing_columns"])
def test_the_master_is_made_once(spark, context, name):
    plain = registry.Ctx(spark, "/nonexistent")
    plain._cache["master"] = master(spark)
    context._cache["master"], seen = counted(plain._cache["master"], "date_target")
    build = registry.REGISTRY[name].build
    got = sorted(map(tuple, build(context).collect()))
    assert seen.value == N
    assert got and got == sorted(map(tuple, build(plain).collect()))


def test_the_mean_missing_rate_covers_all_features(spark, context):
    context._cache["master"] = m = master(spark)
    from panelscope.plans.q_selection import FEATURES
    train = [r for r in m.collect() if r["date_target"] < DAYS[-1]]
    shares = {f: sum(r[f] is None for r in train) / len(train) for f in FEATURES}
    got = registry.REGISTRY["high_missing_columns"].build(context).collect()
    assert len(got) == 10 and all(abs(r["mean_missing_rate"] - sum(shares.values()) / len(shares)) < 1e-12 for r in got)
    assert [(r["feature"], r["pct_missing"]) for r in got] == sorted(shares.items(), key=lambda x: (-x[1], x[0]))[:10]


@pytest.mark.parametrize("name", ["clip_values", "top_segment_overlap"])
def test_lists_that_a_report_does_not_read_are_not_made(spark, context, name):
    rows = [(f"c{i}", DAYS[i % 2 + 2], float(i), float(i % 5), "1998-01-01") for i in range(N)]
    df = spark.createDataFrame(rows, "client_id string, date_target date, to_full_hist double, target_1y double, "
                                     "all_purchased_dates string")
    context.panel, seen = counted(df, "all_purchased_dates")
    got = registry.REGISTRY[name].build(context).collect()
    assert seen.value == 0 and len(got) == (N if name == "clip_values" else 1)


EVENTS = [("a", dt.date(1996, 5, 1), "x"), ("a", dt.date(1997, 1, 1), "y"), ("a", dt.date(1998, 6, 1), "x"),
          ("a", dt.date(1998, 7, 1), None), ("b", dt.date(1999, 2, 1), None), ("c", dt.date(2001, 1, 1), "z"),
          ("d", None, "z"), (None, dt.date(1999, 5, 1), "w")]


def test_sets_are_shuffled_once(spark):
    t = spark.createDataFrame(EVENTS, "client_id string, trs_date date, item string")
    got = FE.asof_set_union(t, DAYS, "client_id", {"items": F.col("item")})
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, [
        ("a", DAYS[0], ["x", "y"]), ("a", DAYS[1], ["x", "y"]), ("a", DAYS[2], ["x", "y"]), ("a", DAYS[3], ["x", "y"]),
        ("b", DAYS[3], []), (None, DAYS[3], ["w"])]))


def test_windows_need_no_sort(spark):
    t = spark.createDataFrame([(*e, "Sale", "Web", 2.5, 1, 7) for e in EVENTS],
                              "client_id string, trs_date date, item string, trs_categ string, channel string, "
                              "spend double, flag_he int, article_id long")
    plan = FE.rfm_features(t, None, 1, 2, dates=DAYS)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_days_keep_their_number_of_partitions(spark):
    t = spark.createDataFrame([(*e, "Sale", "Web", 2.5, 1, 7) for e in EVENTS],
                              "client_id string, trs_date date, item string, trs_categ string, channel string, "
                              "spend double, flag_he int, article_id long")
    h = FE.client_history(t, FE.timeline_of(DAYS), gaps=True)
    assert "REPARTITION_BY_NUM" in h._jdf.queryExecution().executedPlan().toString()
    assert {(r["client_id"], r["date_target"]): r["gap_sq"] for r in h.collect()}[("a", DAYS[3])] == \
        sum((b[1] - a[1]).days ** 2 for a, b in zip(EVENTS[:3], EVENTS[1:4]))
