"""Cleaning rules, supplementary client features and cleaning validation:
F1-F17, F21, F22, F24, F28, A9-A12, X2, V4, V7.

Every rule is a column expression or a filter, so a table is cleaned in one
narrow ``select``/``filter`` chain (no shuffle); only the per-client
aggregates (A9-A12) group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope import constants as K
from panelscope.functions.exprs import (col, count_where, flag, money_mean, money_total, present)


# ---------------------------------------------------------------- filters
def filter_key_not_null(df: DataFrame, key: str = "client_id") -> DataFrame:
    """drop rows without a client key."""
    return df.filter(F.col(key).isNotNull())


def filter_non_negative_keep_null(df: DataFrame, c: str = "spend") -> DataFrame:
    """keep unknown or non-negative values (drops negatives only)."""
    return df.filter(F.col(c).isNull() | (F.col(c) >= 0))


def filter_cap_keep_null(df: DataFrame, c: str = "appointment_duration",
                         cap: float = K.MAX_APPOINTMENT_MINUTES) -> DataFrame:
    """keep unknown values or values <= cap."""
    return df.filter(F.col(c).isNull() | (F.col(c) <= cap))


def filter_drop_serious_gap(df: DataFrame, gap: str = "sale_creation_gap",
                            max_gap: int = K.MAX_SALE_CREATION_GAP_DAYS) -> DataFrame:
    """drop rows whose gap exceeds ``max_gap``; unknown gaps are kept."""
    return df.filter(~F.coalesce(F.col(gap) > max_gap, F.lit(False)))


def filter_drop_null_and_negative(df: DataFrame, c: str = "spend") -> DataFrame:
    """the early variant ``x >= 0``, which also loses unknown values."""
    return df.filter(F.col(c) >= 0)


def drop_null_subset(df: DataFrame, subset: list[str]) -> DataFrame:
    """drop rows with a null in any of ``subset``."""
    return df.dropna(subset=subset)


# ---------------------------------------------------------------- column rules
def impute_conditional(spend: Column, categ: Column, price: Column) -> Column:
    """F8: unknown spend -> catalog price for sales, 0 for repairs and the
    rest; a sale without a price falls through to 0."""
    return F.coalesce(spend, F.when(categ == K.SALE, price), F.lit(0.0))


def sentinel_to_null(c: Column, placeholder: str) -> Column:
    """known placeholder value -> null."""
    return F.when(c == F.lit(placeholder), F.lit(None).cast("string")).otherwise(c)


def age_years(ref_date, birth: Column) -> Column:
    """age in years at an explicit reference date (days / 365.25)."""
    return F.datediff(F.lit(ref_date), birth) / F.lit(K.DAYS_PER_YEAR)


def implausible_birth(birth: Column, ref_date, min_age: float = K.MIN_AGE_YEARS,
                      max_age: float = K.MAX_AGE_YEARS, min_year: int = K.MIN_BIRTH_YEAR) -> Column:
    """pre-``min_year`` or age outside [min_age, max_age] at ref date."""
    age = age_years(ref_date, birth)
    return F.coalesce((F.year(birth) < min_year) | (age < min_age) | (age > max_age),
                      F.lit(False))


def fill_defaults(df: DataFrame, numeric: list[str] = (), categorical: list[str] = (),
                  unknown: str = "Unknown") -> DataFrame:
    """F16: 0 for counts/flags, 'Unknown' for categories."""
    if numeric:
        df = df.fillna(0, subset=list(numeric))
    if categorical:
        df = df.fillna(unknown, subset=list(categorical))
    return df


def coerce_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """parse text to DATE; unparsable -> null instead of an ANSI error."""
    return F.try_to_date(c, fmt) if fmt else F.try_to_date(c)


def clip(c: Column, lo=None, hi=None) -> Column:
    """clip to bounds (either may be a column, e.g. a broadcast percentile)."""
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return out


# ---------------------------------------------------------------- table cleaners
def clean_panel(df: DataFrame, gap_deviation: str = "stddev_timelapse_trs",
                repairs: str = "all_repair_pdt_categ") -> DataFrame:
    """F1 + F10 on the panel: drop null keys, add presence flags. Multiple
    purchases are told by the deviation of the gaps between them (known from
    the third purchase day on)."""
    return filter_key_not_null(df).select(
        "*",
        present("age").cast("int").alias("age_known"),
        present(gap_deviation).alias("has_multiple_purchases"),
        present(repairs).alias("has_repair_history"),
    )


def clean_events(df: DataFrame, placeholder: str) -> DataFrame:
    """F2, F8, F9, F10, F11 on transactions."""
    kept = filter_non_negative_keep_null(df, "spend")
    spend = impute_conditional(F.col("spend"), F.col("trs_categ"), F.col("wwprice"))
    serial = sentinel_to_null(F.col("serial_number"), placeholder)
    others = [c for c in df.columns if c not in ("spend", "serial_number")]
    out = kept.select(
        *others,
        spend.alias("spend"),
        F.col("spend").isNull().cast("int").alias("spend_imputed"),
        serial.alias("serial_number"),
    )
    return out.select(
        "*",
        present("serial_number").alias("serial_number_known"),
        flag((F.col("wwprice") == 0) & (F.col("spend") > 0)).alias("wwprice_missing"),
    )


def clean_clients(df: DataFrame, ref_date) -> DataFrame:
    """F12, F14, F10 on clients."""
    bad = implausible_birth(F.col("birth_date"), ref_date)
    others = [c for c in df.columns if c != "birth_date"]
    gap = F.abs(F.datediff(F.col("first_purchase_date"), F.col("first_transaction_date")))
    out = df.select(*others, F.when(bad, F.lit(None).cast("date"))
                    .otherwise(F.col("birth_date")).alias("birth_date"),
                    gap.alias("purchase_transaction_gap"))
    return out.select("*", present("birth_date").alias("birth_date_valid"),
                      flag(F.col("purchase_transaction_gap") > K.PURCHASE_GAP_ANOMALY_DAYS).alias("purchase_date_anomaly"))


def clean_contacts(df: DataFrame, max_minutes: float = K.MAX_APPOINTMENT_MINUTES) -> DataFrame:
    """F3, F10 on contacts."""
    return filter_cap_keep_null(df, "appointment_duration", max_minutes).select(
        "*", present("appointment_duration").alias("has_appointment_duration"))


def clean_registrations(df: DataFrame, max_gap: int = K.MAX_SALE_CREATION_GAP_DAYS) -> DataFrame:
    """F15, F4, F10, F21 on registrations."""
    gap = F.datediff(F.col("sale_date"), F.col("creation_date"))
    out = df.select("*", gap.alias("sale_creation_gap"))
    out = filter_drop_serious_gap(out, "sale_creation_gap", max_gap)
    out = out.select("*", present("sale_date").alias("sale_date_valid"))
    return out.withColumnRenamed("flag_gift", "is_gift")


# ---------------------------------------------------------------- per-client aggregates
def contact_features(crc_clean: DataFrame) -> DataFrame:
    """Contacts per client, clienteling flag, mean known duration."""
    return filter_key_not_null(crc_clean).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_crc_interactions"),
        F.max(flag(F.col("origin") == K.CLIENTELING)).alias("has_clienteling"),
        money_mean("appointment_duration", fixed=True).alias("avg_appointment_duration"),
        F.lit(1).alias("has_crc_interaction"),
    )


def registration_features(ccp_clean: DataFrame, gift_col: str = "is_gift") -> DataFrame:
    """A10: registered products per client and any gift."""
    return filter_key_not_null(ccp_clean).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_ccp_products"),
        F.max(flag(F.col(gift_col))).alias("has_gift_registered"),
        F.lit(1).alias("has_ccp"),
    )


def union_distinct_ids(*dfs: DataFrame, key: str = "client_id") -> DataFrame:
    """Distinct non-null ids across tables (one shuffle)."""
    out = dfs[0].select(key)
    for d in dfs[1:]:
        out = out.unionByName(d.select(key))
    return out.filter(F.col(key).isNotNull()).distinct()


def client_flags(clients: DataFrame, crc_clean: DataFrame, ccp_clean: DataFrame) -> DataFrame:
    """Every known client id with contact and registration flags; clients
    absent from a table get 0 counts/flags."""
    ids = union_distinct_ids(crc_clean, ccp_clean, clients)
    out = (ids.join(contact_features(crc_clean), "client_id", "left")
              .join(registration_features(ccp_clean), "client_id", "left"))
    zero = ["has_crc_interaction", "has_clienteling", "n_crc_interactions",
            "has_ccp", "has_gift_registered", "n_ccp_products"]
    return out.fillna(0, subset=zero)


def supplementary_features(clients_clean: DataFrame, crc_clean: DataFrame,
                           ccp_clean: DataFrame) -> DataFrame:
    """``client_flags`` with the flags of the client's own row."""
    return client_flags(clients_clean, crc_clean, ccp_clean).join(
        clients_clean.select("client_id", "birth_date_valid", "purchase_date_anomaly"), "client_id", "left")


def client_totals_v1(events: DataFrame, crc_df: DataFrame, ccp_df: DataFrame) -> DataFrame:
    """A12 / J13 parts: per-client totals without an as-of cut (early variant)."""
    ev = events.groupBy("client_id").agg(
        money_total("spend", fixed=True).alias("spend_sum"),
        F.count(F.lit(1)).alias("n_trs"),
        money_mean("spend", fixed=True).alias("spend_mean"),
        F.coalesce(F.sum("qty"), F.lit(0)).cast("bigint").alias("qty_sum"))
    ct = crc_df.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_contacts"),
                                         F.max("creation_date").alias("last_contact"))
    pr = ccp_df.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_products"),
        F.sum(flag(F.col("flag_gift"))).cast("bigint").alias("n_gifts"),
        F.sum(present("sale_date")).cast("bigint").alias("n_known_sale"))
    return ev, ct, pr


# ---------------------------------------------------------------- validation
def validate_table(df: DataFrame, table: str, checks: list[tuple[str, str]],
                   raw: DataFrame | None = None, untouched: tuple[str, ...] = (),
                   key: str = "client_id") -> DataFrame:
    """V4 building block: evaluate every check of one table in one pass.

    A check is (name, SQL predicate that must hold on every row); a row
    whose predicate is false or null is a violation. With ``raw``, one pass over
    it more: rows beyond its number, and known values of ``untouched`` columns
    (of rows with a key) that cleaning lost or made, are violations. Output is
    long: (table_name, check_name, n_violations, status).
    """
    known = [F.count(x).alias(f"known_{x}") for x in untouched]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *known, *[
        count_where(~F.coalesce(F.expr(pred), F.lit(False))).alias(f"c{i}") for i, (_, pred) in enumerate(checks)])
    found = {name: f"c{i}" for i, (name, _) in enumerate(checks)}
    if raw is not None:
        before = raw.agg(F.struct(F.count(F.lit(1)).alias("rows"), *[
            F.count(F.when(col(key).isNotNull(), col(x))).alias(f"known_{x}") for x in untouched])).scalar()
        one = one.select("*", before.alias("before"))
        found["rows_not_increased"] = "greatest(rows - before.rows, 0)"
        found |= {f"{x}_untouched": f"abs(known_{x} - before.known_{x})" for x in untouched}
    pairs = ", ".join(f"'{name}', {x}" for name, x in found.items())
    long = one.selectExpr(f"stack({len(found)}, {pairs}) as (check_name, n_violations)")
    return long.select(F.lit(table).alias("table_name"), "check_name",
                       F.col("n_violations").cast("bigint").alias("n_violations"),
                       F.when(F.col("n_violations") == 0, "PASS").otherwise("FAIL").alias("status"))


def row_count_report(pairs: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """V7: rows in / out / removed per table (one count job per table pair,
    unioned into one plan)."""
    parts = []
    for name, raw, clean in pairs:
        n_clean = clean.agg(F.count(F.lit(1))).scalar()   # scalar subquery
        r = raw.agg(F.count(F.lit(1)).alias("n_raw")).select(
            F.lit(name).alias("table_name"), "n_raw", n_clean.alias("n_clean"))
        parts.append(r.select(
            "table_name", "n_raw", "n_clean",
            (F.col("n_raw") - F.col("n_clean")).alias("n_removed"),
            F.try_divide((F.col("n_raw") - F.col("n_clean")).cast("double") * F.lit(100.0),
                         F.col("n_raw").cast("double")).alias("pct_removed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def price_ratio(df: DataFrame, num: str = "spend", den: str = "wwprice") -> Column:
    """spend over catalog price, null when the price is 0."""
    return F.try_divide(col(num), col(den))
