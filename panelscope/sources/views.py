"""Canonical domain views over the driver's TPC-H-ish test tables.

The operators are written for a retail client panel (transactions, articles,
clients, contacts, registrations, panel snapshots). These views map the test
tables onto that model deterministically; the DuckDB oracle builds the very
same views in SQL (``panelscope.plans.oracle``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.functions.exprs import CENTS, UNITS_STDDEV

# Fixed values of the test mapping.
SNAPSHOT_DATES = ("1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01")
TEST_SNAPSHOT = "2000-01-01"
CLIENT_REFERENCE_DATE = "2010-01-01"
SERIAL_PLACEHOLDER = "PLACEHOLDER"
RECENT_YEARS = 1   # the reference uses 3 on its data
PRIOR_YEARS = 2    # the reference uses 6 on its data
TARGET_HORIZONS_MONTHS = {"target_1m": 1, "target_3m": 3, "target_1y": 12}
PANEL_COLUMNS = (
    "client_id", "date_target", "target_1m", "target_3m", "target_1y", "age", "seniority",
    "recency", "residency_country", "gender", "residency_market", "to_full_hist", "to_past_1y",
    "to_past_1y_2y", "to_btq", "to_web", "to_crc", "nb_trs_full_hist", "nb_trs_btq",
    "nb_trs_web", "nb_trs_crc", "stddev_price", "avg_timelapse_trs", "stddev_timelapse_trs", "max_price_per_pdt",
    "qty_pdt_full_hist", "all_purchased_dates", "all_repair_pdt_categ")


VIEW_COLUMNS = {
    "trs": ("client_id", "article_id", "trs_date", "ship_date", "trs_categ", "channel", "wwprice",
            "spend", "qty", "serial_number", "categ", "flag_he"),
    "articles": ("article_id", "world_price", "product_category", "flag_he", "flag_bridal",
                 "flag_diamond"),
    "clients": ("client_id", "birth_date", "gender", "country_of_residency", "residency_market",
                "can_be_contacted", "creation_channel", "first_purchase_date",
                "first_transaction_date"),
    "crc": ("client_id", "appointment_id", "creation_date", "origin", "appointment_duration"),
    "ccp": ("client_id", "serial_number", "article_id", "creation_date", "sale_date", "flag_gift"),
    "panel": PANEL_COLUMNS,
}


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def snapshots(spark: SparkSession, dates=SNAPSHOT_DATES) -> DataFrame:
    """One row per snapshot date (``date_target``); size = number of snapshots."""
    arr = F.array(*[F.lit(_d(d)) for d in dates])
    return spark.range(1).select(F.explode(arr).alias("date_target"))


def client_key(number: Column) -> Column:
    """The contract's client id: a string of 20 characters."""
    return F.lpad(number.cast("string"), 20, "0")


def trs(t) -> DataFrame:
    """Transactions: one row per order line, keyed by client and date."""
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                              "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.selectExpr(
        "lpad(CAST(o_custkey AS STRING), 20, '0') AS client_id",
        "CASE WHEN l_partkey % 11 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS article_id",
        "CAST(o_orderdate AS DATE) AS trs_date", "CAST(l_shipdate AS DATE) AS ship_date",
        "CASE WHEN l_returnflag = 'R' THEN 'Repair' ELSE 'Sale' END AS trs_categ",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Web' WHEN o_orderpriority = '2-HIGH' THEN 'CC' "
        "ELSE 'Boutique' END AS channel",
        "CASE WHEN l_quantity = 7 THEN 0D ELSE l_extendedprice END AS wwprice",
        "CASE WHEN l_quantity = 13 THEN CAST(NULL AS DOUBLE) WHEN l_quantity = 29 AND l_discount > 0.095D "
        "THEN -0.01D * l_extendedprice ELSE l_extendedprice * (1D - l_discount) END AS spend",
        "CAST(l_quantity AS BIGINT) AS qty",
        "CASE WHEN l_suppkey % 10 = 3 THEN NULL "
        f"WHEN l_suppkey % 10 = 7 THEN '{SERIAL_PLACEHOLDER}' ELSE CAST(l_suppkey AS STRING) END AS serial_number",
        "concat('C', CAST(l_partkey % 4 AS STRING)) AS categ",
        "CAST(l_extendedprice > 90000 AS INT) AS flag_he")


def articles(t) -> DataFrame:
    """Article dimension (one row per article id)."""
    p = t["part"]
    return p.select(
        F.col("p_partkey").alias("article_id"),
        F.col("p_retailprice").alias("world_price"),
        F.concat(F.lit("C"), (F.col("p_partkey") % 6).cast("string")).alias("product_category"),
        (F.col("p_size") > 45).cast("int").alias("flag_he"),
        (F.col("p_brand") == "Brand#1").cast("int").alias("flag_bridal"),
        (F.col("p_size") < 5).cast("int").alias("flag_diamond"),
    )


def clients(t, trs_df: DataFrame | None = None) -> DataFrame:
    """Client dimension with first purchase / first shipment dates."""
    trs_df = trs_df if trs_df is not None else trs(t)
    firsts = trs_df.groupBy("client_id").agg(
        F.min("trs_date").alias("first_purchase_date"),
        F.min("ship_date").alias("first_transaction_date"))
    return client_dimension(t).join(firsts, "client_id", "left")


def client_dimension(t) -> DataFrame:
    """What is known of a client without a look at transactions."""
    c = t["customer"].select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = t["nation"].select("n_nationkey", "n_name", "n_regionkey")
    r = t["region"].select("r_regionkey", "r_name")
    key = F.col("c_custkey")
    base = (c.join(n, c.c_nationkey == n.n_nationkey, "left")
             .join(r, F.col("n_regionkey") == r.r_regionkey, "left"))
    seg = F.col("c_mktsegment")
    return base.select(
        client_key(key).alias("client_id"),
        F.when(key % 3 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit(_d("1880-01-01")), ((key * 7919) % 55000).cast("int")))
         .alias("birth_date"),
        F.when(seg.isin("BUILDING", "HOUSEHOLD"), "F")
         .when(seg.isin("AUTOMOBILE", "MACHINERY"), "M").otherwise("U").alias("gender"),
        F.col("n_name").alias("country_of_residency"),
        F.when(key % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("r_name"))
         .alias("residency_market"),
        (F.col("c_acctbal") > 0).alias("can_be_contacted"),
        F.when(key % 2 == 0, "Boutique").otherwise("Web").alias("creation_channel"),
    )


def crc(t) -> DataFrame:
    """Contacts / appointments."""
    e = t["events"]
    et = F.col("event_type")
    return e.select(
        # a few contacts lose their client key (null-key edge case)
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("string"))
         .otherwise(client_key(F.col("user_id"))).alias("client_id"),
        F.col("event_id").alias("appointment_id"),
        F.col("ts").alias("creation_date"),
        F.when(et == "error", F.lit(None).cast("string"))
         .when(et == "purchase", "Clienteling").otherwise(et).alias("origin"),
        F.when(et == "view", F.lit(None).cast("double"))
         .otherwise(F.col("value") * F.lit(2.0)).alias("appointment_duration"),
    )


def ccp(t) -> DataFrame:
    """Product registrations: first line of every order."""
    li = t["lineitem"].filter(F.col("l_linenumber") == 1).select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        client_key(F.col("o_custkey")).alias("client_id"),
        F.col("l_orderkey").cast("string").alias("serial_number"),
        F.when(F.col("l_partkey") % 50 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("l_partkey")).alias("article_id"),
        F.col("l_shipdate").cast("date").alias("creation_date"),
        F.when(F.col("l_quantity") < 30, F.lit(None).cast("date"))
         .otherwise(F.col("o_orderdate").cast("date")).alias("sale_date"),
        (F.col("l_returnflag") == "A").alias("flag_gift"),
    )


def panel_timeline(dates=SNAPSHOT_DATES):
    from panelscope.operators.features import timeline_of
    return timeline_of([_d(v) for v in dates], RECENT_YEARS, PRIOR_YEARS, TARGET_HORIZONS_MONTHS)


def panel_measures() -> list[Column]:
    """The panel's columns that a client history holds."""
    months = lambda since: (f"CAST((year(date_target) - year({since})) * 12 "  # noqa: E731
                            f"+ month(date_target) - month({since}) AS BIGINT)")
    tenure = "CAST(datediff(last, first) AS BIGINT)"
    return [F.expr(f"{e} AS {n}") for n, e in {
        **{n: CENTS.format(f"units_{n}") for n in TARGET_HORIZONS_MONTHS},
        "seniority": months("first"), "recency": months("last"),
        "to_full_hist": CENTS.format("units"), "to_past_1y": CENTS.format("units_recent"),
        "to_past_1y_2y": CENTS.format("units_prior"), "to_btq": CENTS.format("units_Boutique"),
        "to_web": CENTS.format("units_Web"), "to_crc": CENTS.format("units_CC"),
        "nb_trs_full_hist": "n", "nb_trs_btq": "n_Boutique", "nb_trs_web": "n_Web", "nb_trs_crc": "n_CC",
        "stddev_price": f"round({UNITS_STDDEV.format('units', 'units_sq', 'n_spend')}, 6)",
        "avg_timelapse_trs": f"CASE WHEN n_days > 1 THEN CAST({tenure} AS DOUBLE) / CAST(n_days - 1 AS DOUBLE) END",
        # of n_days - 1 gaps
        "stddev_timelapse_trs": f"CASE WHEN n_days > 2 THEN round(sqrt(CAST((n_days - 1) * gap_sq - {tenure} * {tenure} "
                                "AS DOUBLE) / CAST((n_days - 1) * (n_days - 2) AS DOUBLE)), 6) END",
        "max_price_per_pdt": "max_wwprice", "qty_pdt_full_hist": "CAST(qty AS BIGINT)"}.items()]


def with_client(df: DataFrame, clients_df: DataFrame) -> DataFrame:
    """Age and residency of the row's client."""
    cl = clients_df.select("client_id", "birth_date", F.col("country_of_residency").alias("residency_country"),
                           "gender", "residency_market")
    age = F.floor(F.datediff(F.col("date_target"), F.col("birth_date")) / F.lit(365.25)).cast("double")
    return df.join(cl, "client_id", "left").withColumn("age", age)


def panel(t, spark: SparkSession, trs_df: DataFrame | None = None,
          clients_df: DataFrame | None = None, dates=SNAPSHOT_DATES) -> DataFrame:
    """Client x snapshot panel: history measures as of ``date_target`` plus
    spend targets in (date_target, date_target + h]. A client appears in a
    snapshot once it has a transaction on or before the snapshot date.

    From the mergeable as-of state: transactions are never joined to snapshots.
    """
    from panelscope.operators.features import client_history, sets_at, sets_by_tag
    trs_df = trs_df if trs_df is not None else trs(t)
    clients_df = clients_df if clients_df is not None else client_dimension(t)
    h = client_history(trs_df, panel_timeline(dates), distinct_articles=False, gaps=True)
    # list columns: a client's sets by the first snapshot that sees the event,
    # joined by client, put together where the row's snapshot is known
    days = [_d(v) for v in dates]
    sets = sets_by_tag(trs_df, days, "client_id", {
        "_dates": F.col("ship_date"), "_repairs": F.when(F.col("trs_categ") == "Repair", F.col("categ"))})
    g = h.join(sets, "client_id", "left")
    g = g.withColumns({n: sets_at(n, days) for n in ("_dates", "_repairs")})
    cid = F.col("client_id").cast("bigint")
    dates_list = F.concat_ws(",", F.col("_dates").cast("array<string>"))
    # inject unparsable and blank list elements for some clients (edge cases)
    dates_list = (F.when(cid % 7 == 0, F.concat(dates_list, F.lit(",n/a")))
                   .when(cid % 11 == 0, F.concat(dates_list, F.lit(", ")))
                   .otherwise(dates_list))
    g = g.select(
        "client_id", "date_target", *panel_measures(), dates_list.alias("all_purchased_dates"),
        F.when(F.size("_repairs") > 0, F.concat_ws(",", F.col("_repairs"))).alias("all_repair_pdt_categ"))
    return with_client(g, clients_df).select(*PANEL_COLUMNS)


def panel_with_features(trs_df: DataFrame, clients_df: DataFrame, articles_df: DataFrame,
                        dates=SNAPSHOT_DATES, **steps) -> DataFrame:
    """The panel but for its list columns (``repairs_known`` says whether the
    repair list holds anything), with the client's event and article features,
    all from one state."""
    from panelscope.operators.features import articles_from, client_history, rfm_from
    h = client_history(trs_df, panel_timeline(dates), articles_df, gaps=True, **steps)
    g = h.select("client_id", "date_target", *panel_measures(), *rfm_from(), *articles_from(),
                 F.when(F.col("n_repair") > 0, F.lit(1)).alias("repairs_known"))
    return with_client(g, clients_df)


def scored(panel_df: DataFrame, snapshot: str = TEST_SNAPSHOT) -> DataFrame:
    """Test-snapshot rows with a deterministic stand-in score, the observed
    spend target and its 0/1 label; used to check metric operators without
    depending on model fitting."""
    p = panel_df.filter(F.col("date_target") == F.lit(_d(snapshot)))
    return p.select(
        "client_id", "date_target",
        F.try_divide(F.col("to_full_hist"), (F.col("recency") + 1).cast("double")).alias("score"),
        F.col("target_1m").alias("actual"),
        (F.col("target_1m") > 0).cast("int").alias("label"),
    )
