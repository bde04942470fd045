"""Point-in-time (as-of) feature engineering: J8, A1-A8, W1, F18-F20, J1-J4,
J11, J12, V1, V5, V8.

Input columns follow the canonical transaction model: ``client_id``,
``trs_date`` (DATE), ``spend``, ``article_id``, ``trs_categ``, ``channel``,
``flag_he``; snapshots carry ``date_target``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelscope import constants as K
from panelscope.functions.exprs import CENTS, UNITS, UNITS_MEAN, count_where, money_mean, money_total, ratio
from panelscope.operators.asof import INTERVAL, Timeline, first_seen, merged, windows_of

KEYS = ("client_id", "date_target")


def asof_expand(events: DataFrame, snaps: DataFrame, date_col: str = "trs_date",
                snap_col: str = "date_target", upper_bound=None) -> DataFrame:
    """Every snapshot sees every event dated on or before it.

    ``snaps`` holds one row per snapshot (a handful), so it is broadcast and
    the range predicate runs as a map-side nested loop with no shuffle of the
    events. ``upper_bound`` (the last snapshot date, a driver literal) is
    pushed into the scan because the range join itself cannot be.
    """
    ev = events
    if upper_bound is not None:
        ev = ev.filter(F.col(date_col) <= F.lit(upper_bound))
    return ev.join(F.broadcast(snaps), F.col(date_col) <= F.col(snap_col))


def snapshot_tag(date_col: Column, dates) -> Column:
    """First snapshot date on or after the event date (null after the last
    snapshot): the snapshot at which an event first becomes visible."""
    ds = sorted(dates)
    tag = F.lit(None).cast("date")
    for d in reversed(ds):
        tag = F.when(date_col <= F.lit(d), F.lit(d)).otherwise(tag)
    return tag


def _expand_tags(df: DataFrame, dates, tag_col: str = "_tag") -> DataFrame:
    """Replicate a per-tag row to every snapshot at or after its tag (at most
    one row per snapshot; the input is already aggregated per key and tag)."""
    arr = F.array(*[F.lit(d) for d in sorted(dates)])
    return df.select("*", F.explode(F.filter(arr, lambda s: s >= F.col(tag_col))).alias("date_target"))


def asof_distinct_count(events: DataFrame, dates, key: str, item: str,
                        date_col: str = "trs_date", name: str = "n_distinct") -> DataFrame:
    """Distinct ``item`` per (key, snapshot) over events on/before the
    snapshot, without expanding events: each (key, item) pair counts from
    the first snapshot that sees it (incremental as-of form)."""
    tag = snapshot_tag(F.col(date_col), dates)
    # plain upper bound first, so the scan can skip data after the last snapshot
    events = events.filter(F.col(date_col) <= F.lit(max(dates)))
    first = (events.filter(F.col(item).isNotNull()).select(key, item, tag.alias("_tag"))
             .filter(F.col("_tag").isNotNull())
             .groupBy(key, item).agg(F.min("_tag").alias("_tag")))
    per_tag = first.groupBy(key, "_tag").agg(F.count(F.lit(1)).alias("_n"))
    return _expand_tags(per_tag, dates).groupBy(key, "date_target").agg(
        F.sum("_n").alias(name))


def asof_set_union(events: DataFrame, dates, key: str, sets: dict[str, Column],
                   date_col: str = "trs_date") -> DataFrame:
    """Sorted distinct sets per (key, snapshot) over events on/before the
    snapshot, from one row of sets a key."""
    per_key = sets_by_tag(events, dates, key, sets, date_col)
    out = _expand_tags(per_key, dates)
    return out.select(key, "date_target", *[sets_at(n, dates).alias(n) for n in sets])


def sets_by_tag(events: DataFrame, dates, key: str, sets: dict[str, Column], date_col: str = "trs_date") -> DataFrame:
    """One row a key: for each snapshot the sets of what it is the first to see
    (``<name>_<i>``), and the first snapshot that sees anything (``_tag``). Partial
    aggregation keeps hot keys bounded by the set sizes, and a set is shuffled
    once, whatever the number of snapshots that see it."""
    ds = sorted(dates)
    seen = events.filter(F.col(date_col) <= F.lit(ds[-1])).select(
        key, snapshot_tag(F.col(date_col), ds).alias("_tag"), *[e.alias(n) for n, e in sets.items()])
    return seen.groupBy(key).agg(F.min("_tag").alias("_tag"), *[
        F.collect_set(F.when(F.col("_tag") == F.lit(d), F.col(n))).alias(f"{n}_{i}")
        for n in sets for i, d in enumerate(ds)])


def sets_at(name: str, dates, snap_col: str = "date_target") -> Column:
    """The sorted set that the snapshot sees, from the sets of ``sets_by_tag``;
    null where it sees no event."""
    ds = sorted(dates)
    seen = F.array(*[F.when(F.lit(d) <= F.col(snap_col), F.col(f"{name}_{i}")) for i, d in enumerate(ds)])
    known = F.filter(seen, lambda x: x.isNotNull())
    return F.when(F.col("_tag") <= F.col(snap_col), F.array_sort(F.array_distinct(F.flatten(known))))


def timeline_of(dates, recent_years: int = K.RECENT_YEARS, prior_years: int = K.PRIOR_YEARS,
                horizons: dict[str, int] | None = None) -> Timeline:
    """Windows of the client history: all of it, recent, prior, and the
    horizons (months after the snapshot) of the targets."""
    r, p = -12 * recent_years, -12 * prior_years
    return Timeline(list(dates), {"hist": (None, 0), "recent": (r, 0), "prior": (p, r),
                                  **{n: (0, m) for n, m in (horizons or {}).items()}})


def event_measures(columns: list[str]) -> dict[str, str]:
    """Additive measures of a client's events (money in 1/10000 units)."""
    units = UNITS.format("spend")
    return {
        "n": "count(trs_date)", "n_spend": "count(spend)", "units": f"sum({units})",
        "units_sq": f"sum(CAST({units} AS DECIMAL(38,0)) * CAST({units} AS DECIMAL(38,0)))",
        **{f"units_{c}": f"sum(CASE WHEN channel = '{c}' THEN {units} END)" for c in K.CHANNELS},
        **{f"n_{c}": f"count_if(channel = '{c}')" for c in K.CHANNELS},
        "n_sale": f"count_if(trs_categ = '{K.SALE}')", "n_repair": f"count_if(trs_categ = '{K.REPAIR}')",
        "n_holiday": f"count_if(month(trs_date) IN {K.HOLIDAY_MONTHS})",
        "he": "sum(CAST(flag_he AS BIGINT))", "n_he": "count(flag_he)",
        "first": "min(trs_date)", "last": "max(trs_date)", "max_spend": "max(spend)",
        **({"qty": "sum(qty)"} if "qty" in columns else {}),
        **({"max_wwprice": "max(wwprice)"} if "wwprice" in columns else {})}


def article_measures() -> dict[str, str]:
    """Additive measures of the articles that a client bought."""
    return {
        "n_sales": f"count_if(trs_categ = '{K.SALE}')", "price_units": f"sum({UNITS.format('world_price')})",
        "n_price": "count(world_price)", "max_price": "max(world_price)",
        **{f"sum_{c}": f"sum(CAST(art_{c} AS BIGINT))" for c in K.ARTICLE_FLAGS},
        **{f"n_{c}": f"count(art_{c})" for c in K.ARTICLE_FLAGS}}


_HISTORY = ("n", "n_spend", "units", "units_sq", *[f"units_{c}" for c in K.CHANNELS], *[f"n_{c}" for c in K.CHANNELS],
            "n_sale", "n_repair", "n_holiday", "he", "n_he", "qty", "n_articles", "n_days", "gap_sq",
            "n_sales", "price_units", "n_price", "n_categories", *[f"{k}_{f}" for f in K.ARTICLE_FLAGS for k in ("sum", "n")])


def client_history(events: DataFrame, timeline: Timeline, articles: DataFrame | None = None,
                   distinct_articles: bool = True, gaps: bool = False, with_events: bool = True,
                   step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Everything that A1-A8, F18, W1 and the panel know of a client as of each
    snapshot, from one state per (client, interval): one pass for the additive
    measures and one for what is counted once; columns that nobody asks for
    are pruned from both. ``step`` may write what a further step reads (the events
    and both parts of the state), so that no two steps' shuffles lie on disk."""
    tagged = timeline.tagged(events if with_events else events.filter(F.col("trs_categ") == K.SALE), "trs_date")
    measures, items = {}, {}
    if with_events:
        measures |= event_measures(tagged.columns)
        if distinct_articles:
            items["article_id"] = "n_articles"
        if gaps:
            items["trs_date"] = "n_days"
    if articles is not None:
        tagged = with_dimension(tagged, articles)
        measures |= article_measures()
        items["product_category"] = "n_categories"
    read = " ".join(measures.values())
    tagged = step(tagged.select(*[c for c in tagged.columns if c in ("client_id", INTERVAL, *items)
                                  or re.search(rf"\b{re.escape(c)}\b", read)]))
    parts = [step(tagged.groupBy("client_id", INTERVAL).agg(*[F.expr(f"{e} AS `{n}`") for n, e in measures.items()]))]
    if items:
        parts.append(step(first_seen(tagged, "client_id", items, "trs_date" if gaps else None)))
    state = merged(parts)
    sums = {c: (c, "hist") for c in _HISTORY if c in state.columns}
    if with_events:
        sums |= {f"units_{w}": ("units", w) for w in timeline.windows if w != "hist"}
    return windows_of(state, "client_id", timeline, sums,
                      {"first": "first"} if with_events else {},
                      {c: c for c in ("last", "max_spend", "max_wwprice", "max_price") if c in state.columns})


def rfm_from() -> list[Column]:
    """A1-A7, F18 and W1 as columns of a client history. The average gap
    between consecutive events telescopes to tenure / (n - 1)."""
    recent, prior = CENTS.format("units_recent"), CENTS.format("units_prior")
    share = lambda x: f"CAST({x} AS DOUBLE) / CAST(n AS DOUBLE)"  # noqa: E731  a history has events
    return [F.expr(f"{e} AS {n}") for n, e in {
        "n_transactions": "n", "total_spend": CENTS.format("units"), "avg_spend_per_trs": UNITS_MEAN.format("units", "n_spend"),
        "max_single_spend": "max_spend", "n_distinct_articles": "n_articles",
        "recency_days": "datediff(date_target, last)", "tenure_days": "datediff(last, first)",
        "spend_recent": recent, "spend_prior": prior,
        "spend_trend": f"CASE WHEN {prior} > 0 THEN {recent} / {prior} "
                       f"WHEN {recent} > 0 THEN {K.TREND_NO_PRIOR_WITH_RECENT}D ELSE {K.TREND_NO_SPEND}D END",
        "n_sale_trs": "n_sale", "n_repair_trs": "n_repair", "repair_ratio": share("n_repair"),
        "boutique_ratio": share(f"n_{K.BOUTIQUE}"), "holiday_purchase_ratio": share("n_holiday"),
        "avg_days_between_trs": "CASE WHEN n > 1 THEN CAST(datediff(last, first) AS DOUBLE) / CAST(n - 1 AS DOUBLE) "
                                "ELSE 0D END",
        "flag_he_ratio_trs": "try_divide(CAST(he AS DOUBLE), CAST(n_he AS DOUBLE))"}.items()]


def rfm_features(events: DataFrame, snaps: DataFrame, recent_years: int = K.RECENT_YEARS,
                 prior_years: int = K.PRIOR_YEARS, upper_bound=None, dates=None) -> DataFrame:
    """A1-A7 + A2 + F18 + W1 per (client, snapshot).

    Windows are half-open on the left: recent = (DT - r, DT], prior =
    (DT - p, DT - r]. Sums of nothing are 0; mean/max of nothing are null.
    With the snapshot ``dates`` known they come from the mergeable as-of state;
    a table of snapshots that only Spark knows is joined to the events."""
    if dates is not None:
        h = client_history(events, timeline_of(dates, recent_years, prior_years))
        return h.select(*KEYS, *rfm_from())
    return rfm_expanded(events, snaps, recent_years, prior_years, upper_bound)


def rfm_expanded(events: DataFrame, snaps: DataFrame, recent_years: int, prior_years: int,
                 upper_bound=None) -> DataFrame:
    """``rfm_features`` by joining every event to every snapshot that sees it."""
    # window starts are computed once per snapshot on the broadcast side
    snaps = snaps.select("date_target",
                         F.add_months("date_target", -12 * recent_years).alias("_recent_start"),
                         F.add_months("date_target", -12 * prior_years).alias("_prior_start"))
    x = asof_expand(events, snaps, upper_bound=upper_bound)
    d, s = F.col("trs_date"), F.col("date_target")
    recent_start, prior_start = F.col("_recent_start"), F.col("_prior_start")
    spend = F.col("spend")
    g = x.groupBy(*KEYS).agg(
        F.count(d).alias("n_transactions"),
        money_total(spend, fixed=True).alias("total_spend"),
        money_mean(spend, fixed=True).alias("avg_spend_per_trs"),
        F.max(spend).alias("max_single_spend"),
        F.count_distinct("article_id").alias("n_distinct_articles"),
        F.max(d).alias("_last"),
        F.min(d).alias("_first"),
        money_total(F.when(d > recent_start, spend), fixed=True).alias("spend_recent"),
        money_total(F.when((d > prior_start) & (d <= recent_start), spend), fixed=True).alias("spend_prior"),
        count_where(F.col("trs_categ") == K.SALE).alias("n_sale_trs"),
        count_where(F.col("trs_categ") == K.REPAIR).alias("n_repair_trs"),
        count_where(F.col("channel") == K.BOUTIQUE).alias("_n_btq"),
        count_where(F.month(d).isin(*K.HOLIDAY_MONTHS)).alias("_n_holiday"),
        F.avg("flag_he").alias("flag_he_ratio_trs"),
    )
    n = F.col("n_transactions")
    tenure = F.datediff(F.col("_last"), F.col("_first"))
    return g.select(
        *KEYS, "n_transactions", "total_spend", "avg_spend_per_trs", "max_single_spend",
        "n_distinct_articles",
        F.datediff(s, F.col("_last")).alias("recency_days"),
        tenure.alias("tenure_days"),
        "spend_recent", "spend_prior",
        spend_trend(F.col("spend_recent"), F.col("spend_prior")).alias("spend_trend"),
        "n_sale_trs", "n_repair_trs",
        ratio("n_repair_trs", n).alias("repair_ratio"),
        ratio("_n_btq", n).alias("boutique_ratio"),
        ratio("_n_holiday", n).alias("holiday_purchase_ratio"),
        F.when(n > 1, tenure.cast("double") / (n - 1).cast("double"))
         .otherwise(F.lit(0.0)).alias("avg_days_between_trs"),
        "flag_he_ratio_trs",
    )


def spend_trend(recent: Column, prior: Column) -> Column:
    """recent/prior when prior > 0, else 2 if recent > 0, else 1."""
    return (F.when(prior > 0, recent / prior)
             .when(recent > 0, F.lit(K.TREND_NO_PRIOR_WITH_RECENT)).otherwise(F.lit(K.TREND_NO_SPEND)))


def avg_gap_lag_form(events: DataFrame, snaps: DataFrame, upper_bound=None) -> DataFrame:
    """W1 cross-check: mean day gap between consecutive events via ``lag``,
    equal to the closed form of ``rfm_features``.

    Events are first collapsed to one row per (client, snapshot, day) with a
    count, so each window partition holds at most the calendar days of one
    client's history (same-day events contribute gaps of 0), never the raw
    rows of a hot client."""
    x = asof_expand(events, snaps, upper_bound=upper_bound)
    days = x.groupBy(*KEYS, "trs_date").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*KEYS).orderBy("trs_date")
    gaps = days.select(*KEYS, "_c", F.datediff(F.col("trs_date"), F.lag("trs_date").over(w)).alias("_gap"))
    g = gaps.groupBy(*KEYS).agg(F.coalesce(F.sum("_gap"), F.lit(0)).alias("_g"),
                                F.sum("_c").alias("_n"))
    return g.select(*KEYS, F.when(F.col("_n") > 1, F.col("_g").cast("double")
                                  / (F.col("_n") - 1).cast("double"))
                    .otherwise(F.lit(0.0)).alias("avg_days_between_trs"))


def with_dimension(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Events with their article's columns; orphans, and events that are no
    sales, are kept with nulls. An article id that occurs twice would repeat
    sales: the job fails instead (J11).

    Spark broadcasts the dimension only when its measured size is under
    ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at runtime) and
    falls back to a sort-merge join otherwise."""
    art = one_row_per_key(articles.select(
        "article_id", "world_price", "product_category", *[F.col(c).alias(f"art_{c}") for c in K.ARTICLE_FLAGS]),
        ["article_id"]).withColumnRenamed("article_id", "_dim_id")
    return events.join(art, (F.col("article_id") == F.col("_dim_id")) & (F.col("trs_categ") == K.SALE),
                       "left").drop("_dim_id")


def articles_from() -> list[Column]:
    """A8 as columns of a client history."""
    share = lambda f: f"try_divide(CAST(sum_{f} AS DOUBLE), CAST(n_{f} AS DOUBLE))"
    return [F.expr(f"{e} AS {n}") for n, e in {
        "avg_article_world_price": UNITS_MEAN.format("price_units", "n_price"), "max_article_world_price": "max_price",
        "flag_he_ratio": share("flag_he"),
        "n_distinct_categories": "CASE WHEN n_sales > 0 THEN n_categories END",
        "flag_bridal_ratio": share("flag_bridal"), "flag_diamond_ratio": share("flag_diamond")}.items()]


def article_features(events: DataFrame, articles: DataFrame, snaps: DataFrame,
                     upper_bound=None, dates=None) -> DataFrame:
    """A8 (with J3): per (client, snapshot), sales only, joined to the article
    dimension with orphans kept; orphan rows count as null in the means. With
    the snapshot ``dates`` known, from the mergeable as-of state."""
    if dates is not None:
        h = client_history(events, Timeline(list(dates), {"hist": (None, 0)}), articles, with_events=False)
        return h.select(*KEYS, *articles_from())
    sales = events.filter(F.col("trs_categ") == K.SALE).select("client_id", "trs_date", "article_id", "trs_categ")
    x = asof_expand(with_dimension(sales, articles), snaps, upper_bound=upper_bound)
    return x.groupBy(*KEYS).agg(
        money_mean("world_price", fixed=True).alias("avg_article_world_price"),
        F.max("world_price").alias("max_article_world_price"),
        F.avg("art_flag_he").alias("flag_he_ratio"),
        F.count_distinct("product_category").alias("n_distinct_categories"),
        F.avg("art_flag_bridal").alias("flag_bridal_ratio"),
        F.avg("art_flag_diamond").alias("flag_diamond_ratio"))


def add_log_targets(df: DataFrame, targets) -> DataFrame:
    """``log1p`` and binary (> 0) versions of each target (log is null
    below -1, where it is undefined)."""
    return df.selectExpr("*", *[e for t in targets for e in (
        f"CASE WHEN `{t}` > -1 THEN round(log1p(`{t}`), 9) END AS `{t}_log`", f"CAST(`{t}` > 0 AS INT) AS `{t}_bin`")])


# Column roles (defaults follow the test panel; the reference's own lists are
# the same idea: targets, sparse age, structurally missing measures, lists).
TARGETS = ("target_1m", "target_3m", "target_1y")
LOG_TARGETS = ("target_1m", "target_3m")
PANEL_EXCLUDE = TARGETS + ("age", "stddev_price", "avg_timelapse_trs", "stddev_timelapse_trs")
LIST_PREFIXES = ("all_",)
RFM_COLS = ("n_transactions", "total_spend", "avg_spend_per_trs", "max_single_spend",
            "n_distinct_articles", "recency_days", "tenure_days", "spend_recent", "spend_prior",
            "spend_trend", "n_sale_trs", "n_repair_trs", "repair_ratio", "boutique_ratio",
            "holiday_purchase_ratio", "avg_days_between_trs", "flag_he_ratio_trs")
ART_COLS = ("avg_article_world_price", "max_article_world_price", "flag_he_ratio",
            "n_distinct_categories", "flag_bridal_ratio", "flag_diamond_ratio")
SUPP_SAFE = ("has_crc_interaction", "has_ccp", "has_gift_registered", "has_clienteling")


def panel_feature_columns(columns, exclude=PANEL_EXCLUDE, near_zero=(),
                          prefixes=LIST_PREFIXES) -> list[str]:
    """metadata-only choice of panel columns (no job)."""
    drop = set(exclude) | set(near_zero)
    return [c for c in columns if c not in drop and not any(c.startswith(p) for p in prefixes)]


def select_panel_features(df: DataFrame, **kw) -> DataFrame:
    """keep usable panel columns; Catalyst prunes the rest from the scan."""
    return df.select(*panel_feature_columns(df.columns, **kw))


def temporal_split(df: DataFrame, cutoff, date_col: str = "date_target") -> tuple[DataFrame, DataFrame]:
    """V1: train = snapshots before the cutoff, test = the cutoff snapshot.
    Later snapshots fall in neither (reported by ``split_remainder``)."""
    c = F.lit(cutoff)
    return df.filter(F.col(date_col) < c), df.filter(F.col(date_col) == c)


def split_sizes(df: DataFrame, cutoff, date_col: str = "date_target") -> DataFrame:
    """V1 summary: rows per side (train / test / later) in one pass."""
    d, c = F.col(date_col), F.lit(cutoff)
    side = F.when(d < c, "train").when(d == c, "test").otherwise("later")
    return df.groupBy(side.alias("split")).agg(F.count(F.lit(1)).alias("n_rows"))


def train_test_id_overlap(train: DataFrame, test: DataFrame, key: str = "client_id") -> DataFrame:
    """Train rows whose client also appears in test (semi join)."""
    ids = test.select(key).distinct()
    return train.join(ids, key, "left_semi").agg(F.count(F.lit(1)).alias("n_train_rows_in_test"))


def key_is_unique(df: DataFrame, keys) -> DataFrame:
    """J11 guard: duplicate key groups of a join's right side (empty = safe)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def one_row_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """J11 guard inside the plan: ``df`` with one row a key; a key that occurs
    again makes the job fail instead of multiplying the rows that join it."""
    rest = [c for c in df.columns if c not in keys]
    twice = F.raise_error(F.concat_ws(" ", F.lit("join key is not unique:"), *[F.col(k).cast("string") for k in keys]))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    return g.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(twice.cast("boolean"))).select(*df.columns)


def join_panel_features(panel: DataFrame, rfm: DataFrame, art: DataFrame) -> DataFrame:
    """Panel LEFT JOIN event and article features on (client, snapshot)."""
    return panel.join(rfm, list(KEYS), "left").join(art, list(KEYS), "left")


def join_supplementary(df: DataFrame, supp: DataFrame, cols=SUPP_SAFE) -> DataFrame:
    """LEFT JOIN per-client flags on client only (safe columns only)."""
    return df.join(supp.select("client_id", *cols), "client_id", "left")


def join_targets(features: DataFrame, targets: DataFrame, cols=TARGETS) -> DataFrame:
    """Re-attach targets on (client, snapshot)."""
    return features.join(targets.select(*KEYS, *cols), list(KEYS), "left")


def build_master(clean_panel: DataFrame, rfm: DataFrame, art: DataFrame,
                 supp: DataFrame) -> DataFrame:
    """V8: F20 panel columns + J1 + J2, targets kept on the panel rows (so no
    separate J4 join is needed) and F19 log targets.

    Every right side is grouped on its join key, so the master has exactly
    one row per panel row (J11 checks it)."""
    feats = select_panel_features(clean_panel)
    base = clean_panel.select(*feats.columns, *TARGETS)
    return finish_master(join_panel_features(base, rfm, art), feats.columns, supp)


def build_master_from(wide: DataFrame, panel_columns, supp: DataFrame) -> DataFrame:
    """V8 where panel rows already carry their event and article features."""
    return finish_master(wide, panel_feature_columns(panel_columns), supp)


def finish_master(wide: DataFrame, panel_columns: list[str], supp: DataFrame) -> DataFrame:
    """J2 and F19, columns in the order of the master. A client that occurs
    twice in ``supp`` makes the job fail (J11)."""
    out = join_supplementary(wide, one_row_per_key(supp.select("client_id", *SUPP_SAFE), ["client_id"]))
    return add_log_targets(out.select(*panel_columns, *RFM_COLS, *ART_COLS, *SUPP_SAFE, *TARGETS), LOG_TARGETS)


def validate_features(train: DataFrame, test: DataFrame, numeric_cols, all_cols,
                      target: str, key: str = "client_id") -> DataFrame:
    """V5: feature-set checks as long (check_name, n_violations, status).

    Train-side checks run as one aggregation (per-column std and null share
    are combined inside it); test-side counts are scalar subqueries."""
    from functools import reduce
    from operator import add

    from panelscope.functions.exprs import flag
    t, tl, tb = F.col(target), F.col(f"{target}_log"), F.col(f"{target}_bin")
    zero_var = reduce(add, [flag(F.stddev_samp(c) == 0) for c in numeric_cols])
    high_null = reduce(add, [flag(F.avg(F.col(c).isNull().cast("int")) > 0.5) for c in all_cols])
    row = train.agg(
        zero_var.cast("bigint").alias("no_zero_variance"),
        count_where(~tb.isin(0, 1)).alias("binary_target_01"),
        count_where(~(tl >= 0)).alias("log_target_non_negative"),
        count_where(~(t >= 0)).alias("target_non_negative"),
        high_null.cast("bigint").alias("no_column_over_50pct_null"),
        F.count_if(F.col(key).isNull()).alias("train_key_not_null"),
    )
    n_test = test.agg(F.count(F.lit(1))).scalar()
    test_null = test.agg(F.count_if(F.col(key).isNull())).scalar()
    row = row.select("*", F.when(n_test == 0, 1).otherwise(0).cast("bigint").alias("test_not_empty"),
                     test_null.alias("test_key_not_null"))
    names = ["test_not_empty", "no_zero_variance", "binary_target_01", "log_target_non_negative",
             "target_non_negative", "no_column_over_50pct_null", "train_key_not_null",
             "test_key_not_null"]
    pairs = ", ".join(f"'{n}', CAST({n} AS BIGINT)" for n in names)
    long = row.selectExpr(f"stack({len(names)}, {pairs}) as (check_name, n_violations)")
    return long.select("check_name", "n_violations",
                       F.when(F.col("n_violations") == 0, "PASS").otherwise("FAIL").alias("status"))
