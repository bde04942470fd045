"""Null-safe helpers and the distributed exact ranking primitives, checked
against brute force on small inline frames with ties, nulls and a hot value."""

import random

import pytest
from pyspark.sql import functions as F

from panelscope.functions.exprs import flag, guarded_corr, money_mean, money_sum, money_total
from panelscope.functions.ranking import ordered_blocks, top_n_sums, top_rows


def test_flag_null_is_false(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-1.0,)], "x double")
    got = sorted(r[0] for r in df.select(flag(F.col("x") > 0)).collect())
    assert got == [0, 0, 1]


def test_money_sum_matches_decimal_path(spark):
    vals = [(0.285,), (1.005,), (-2.5,), (None,), (12345.6789,), (0.0,), (-0.0,)]
    df = spark.createDataFrame(vals, "x double")
    fast, exact = df.agg(money_sum("x"), money_sum("x", fixed=False)).first()
    assert fast == exact == 12344.47
    m_fast, m_exact = df.agg(money_mean("x", fixed=True), money_mean("x", fixed=False)).first()
    assert m_fast == m_exact
    empty = df.filter("x IS NULL").agg(money_sum("x"), money_total("x")).first()
    assert empty[0] is None and empty[1] == 0.0


def test_guarded_corr_constant_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert df.agg(guarded_corr("a", "b")).first()[0] is None
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 1.0)], "a double, b double")
    assert df2.agg(guarded_corr("a", "b")).first()[0] == 1.0


def _data(n=400, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = 5.0 if i % 3 == 0 else float(rnd.randint(0, 60))   # a third of rows share one value
        rows.append((i, "g1" if i % 2 else "g2", v, rnd.randint(0, 1)))
    rows.append((n, "g1", None, 1))
    return rows


def test_ordered_blocks_offsets(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "id long, g string, v double, w long")
    for desc in (False, True):
        b = ordered_blocks(df, "v", {"w": F.col("w")}, ["g"], descending=desc, n_ranges=5).collect()
        for r in b:
            same_g = [x for x in rows if x[1] == r["g"] and x[2] is not None]
            before = [x for x in same_g if (x[2] > r["v"] if desc else x[2] < r["v"])]
            assert r["o_c"] == len(before)
            assert r["o_w"] == sum(x[3] for x in before)
            assert r["c"] == sum(1 for x in same_g if x[2] == r["v"])
            assert r["n_total"] == len(same_g)


def test_top_n_sums_and_rows(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "id long, g string, v double, w long")
    valid = sorted([x for x in rows if x[2] is not None], key=lambda x: (-x[2], x[0]))
    cuts = {"a": F.lit(1), "b": F.floor(F.col("n_total") * F.lit(0.37)), "c": F.col("n_total")}
    got = {r["cut"]: r for r in top_n_sums(df, "v", "id", cuts, {"w": F.col("w").cast("double")},
                                           n_ranges=4).collect()}
    for name, k in (("a", 1), ("b", int(len(valid) * 0.37)), ("c", len(valid))):
        assert got[name]["n_top"] == k
        assert got[name]["w"] == sum(x[3] for x in valid[:k])
    k = 50
    ids = sorted(r["id"] for r in top_rows(df, "v", "id", F.lit(k), n_ranges=4).collect())
    assert ids == sorted(x[0] for x in valid[:k])


@pytest.mark.parametrize("n_ranges", [5, 2000])
@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,4)", "bigint", "double"])
def test_ordered_blocks_of_any_type(spark, kind, n_ranges):
    df = spark.range(3000).select((F.col("id") % 499).alias("k"), F.lit("g").alias("g"))
    as_kind = {"string": F.lpad(F.col("k").cast("string"), 20, "0"),
               "date": F.date_add(F.lit("2000-01-01").cast("date"), F.col("k").cast("int"))}
    df = df.withColumn("v", as_kind.get(kind, F.col("k").cast(kind)))
    got = ordered_blocks(df, "v", None, ["g"], n_ranges=n_ranges).collect()
    values = sorted(r["v"] for r in df.collect())
    assert len(got) == 499 and all(r["n_total"] == 3000 for r in got)
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    assert all(r["o_c"] == first[r["v"]] and r["c"] == values.count(r["v"]) for r in got)


def test_top_cut_with_string_tiebreak(spark):
    rows = [(f"client-{i:012d}", float(i % 3), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "client_id string, v double, w int")
    got = top_n_sums(df, "v", "client_id", {"top": F.lit(30)}, {"w": F.col("w").cast("double")}).first()
    best = sorted(rows, key=lambda r: (-r[1], r[0]))[:30]
    assert (got["n_top"], got["w"]) == (30, sum(r[2] for r in best))
    ids = sorted(r["client_id"] for r in top_rows(df, "v", "client_id", F.lit(30)).collect())
    assert ids == sorted(r[0] for r in best)


def test_mean_of_large_amounts_does_not_overflow(spark):
    df = spark.range(10).select(F.lit(1e14).alias("x"))
    assert df.agg(money_mean("x", fixed=False)).first()[0] == 1e14
