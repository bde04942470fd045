"""Data-quality audits: missingness, coverage, referential integrity,
placeholders, value bands, rule registries (A13-A23, A29-A49, A57, A58,
J5-J7, J9, J10, J14, L1, L3, W2, W6, X3, X4).

Reports that the reference builds with one pass per column, per value or per
client are single aggregations here: all columns of a table are measured in
one ``agg`` and unpivoted with ``stack``; (dimension, value) loops become
GROUPING SETS; O(k^2) set intersections become one bitmask per id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelscope import constants as K
from panelscope.functions.exprs import count_where, flag, pct


def stack_one_row(one_row: DataFrame, names: list[str], name_col: str, value_col: str,
                  keep: list[str] = (), value_type: str | None = None) -> DataFrame:
    """Unpivot the ``names`` columns of a (one-row or grouped) frame into
    (name_col, value_col) pairs; ``keep`` columns are carried along."""
    v = (lambda n: f"CAST(`{n}` AS {value_type})") if value_type else (lambda n: f"`{n}`")
    pairs = ", ".join(f"'{n}', {v(n)}" for n in names)
    return one_row.selectExpr(*[f"`{k}`" for k in keep],
                              f"stack({len(names)}, {pairs}) as ({name_col}, {value_col})")


def rows_from(one_row: DataFrame, rows: list[list]) -> DataFrame:
    """Turn a one-row aggregate into several report rows in the same pass:
    each row is a list of aliased Columns over ``one_row``'s columns (all
    rows share names and types); ``inline`` of an array of structs."""
    return one_row.select(F.inline(F.array(*[F.struct(*r) for r in rows])))


# ------------------------------------------------------------------ missingness
def missing_report(df: DataFrame, dataset: str, threshold: float = K.MISSING_REPORT_THRESHOLD_PCT,
                   cols: list[str] | None = None) -> DataFrame:
    """Null count and % per column in ONE pass, kept when % >= threshold."""
    cols = cols or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = stack_one_row(row, cols, "column_name", "n_missing", keep=["_n"], value_type="BIGINT")
    out = long.select(F.lit(dataset).alias("dataset"), "column_name", "n_missing",
                      pct("n_missing", "_n").alias("pct_missing"))
    return out.filter(F.col("pct_missing") >= threshold)


def missing_by_snapshot(df: DataFrame, date_col: str, snapshot_labels: dict, cols: list[str] | None = None,
                        threshold: float = K.MISSING_REPORT_THRESHOLD_PCT) -> DataFrame:
    """% null per column x snapshot, one column per snapshot; of all columns
    (or ``cols``) those with at least ``threshold`` % nulls over all rows.
    One pass counts per snapshot, the rest works on a row a snapshot."""
    cols = cols or [c for c in df.columns if c != date_col]
    g = df.groupBy(date_col).agg(F.expr("count(1) AS n_"), *[F.expr(f"count_if(`{c}` IS NULL) AS `{c}`") for c in cols])
    long = stack_one_row(g, cols, "column_name", "n_null_", keep=[date_col, "n_"])
    label = F.date_format(F.col(date_col), "yyyy-MM-dd")
    shares = [F.max(F.when(label == day, pct("n_null_", "n_"))).alias(name) for day, name in snapshot_labels.items()]
    return (long.groupBy("column_name").agg(pct(F.sum("n_null_"), F.sum("n_")).alias("all_"), *shares)
            .filter(F.col("all_") >= threshold).drop("all_"))


def missing_by_group(df: DataFrame, col: str, group: str,
                     std_threshold: float = K.MAR_STD_THRESHOLD) -> DataFrame:
    """% null of ``col`` per non-null ``group``; the spread of those %
    across groups (sample std) > threshold suggests MAR, else MNAR. The
    spread is a scalar subquery over the (small) group rows - no join."""
    g = df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(col).isNull()).alias("n_missing"))
    g = g.select(group, "n", "n_missing", pct("n_missing", "n").alias("pct_missing"))
    spread = g.agg(F.round(F.stddev_samp("pct_missing"), 6)).scalar()
    return g.select("*", spread.alias("std_across_groups"),
                    F.when(spread > std_threshold, "MAR").otherwise("MNAR").alias("diagnosis"))


def null_share_by(df: DataFrame, col: str, by: str) -> DataFrame:
    """% null of ``col`` per value of ``by`` (null ``by`` kept as its own group)."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"),
                              F.count_if(F.col(col).isNull()).alias("n_missing")).select(
        by, "n", "n_missing", pct("n_missing", "n").alias("pct_missing"))


# ------------------------------------------------------------------ coverage / leakage
def temporal_coverage(events: DataFrame, snaps: DataFrame, date_col: str) -> DataFrame:
    """Per snapshot, events on/before it (safe) vs after it (leakage).

    Events are first collapsed to one row per date (bounded by the calendar),
    so the snapshot range join runs on a few thousand rows, not the events."""
    per_day = events.groupBy(F.col(date_col).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    total = per_day.agg(F.sum("_n")).scalar()
    j = per_day.join(F.broadcast(snaps), F.col("_d") <= F.col("date_target"), "right")
    g = j.groupBy("date_target").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_safe"))
    w = Window.orderBy("date_target")   # over the snapshots only (a handful of rows)
    return g.select(
        "date_target", "n_safe",
        (total - F.col("n_safe")).cast("bigint").alias("n_leakage"),
        total.cast("bigint").alias("n_total"),
        pct(total - F.col("n_safe"), total).alias("pct_leakage"),
        F.coalesce(F.col("n_safe") >= F.lag("n_safe").over(w), F.lit(True)).alias("monotone"))


def date_list_leakage(df: DataFrame, list_col: str, cutoff_col: str = "date_target") -> DataFrame:
    """L1: per snapshot, dates in a comma list on/before (ok) and after
    (violations) the cutoff; unparsable or blank elements are dropped.
    Full scan, no sampling."""
    el = df.filter(F.col(list_col).isNotNull()).select(
        cutoff_col, F.explode(F.split(F.col(list_col), ",")).alias("_e"))
    d = F.try_to_date(F.trim(F.col("_e")), "yyyy-MM-dd")
    el = el.select(cutoff_col, d.alias("_d"), F.col("_e"))
    return el.groupBy(cutoff_col).agg(
        F.count_if(F.col("_d") <= F.col(cutoff_col)).alias("n_ok"),
        F.count_if(F.col("_d") > F.col(cutoff_col)).alias("n_violations"),
        F.count_if(F.col("_d").isNull()).alias("n_unparsable"))


def list_column_probe(df: DataFrame, cols: list[str]) -> DataFrame:
    """L3: for each list column, share of multi-valued cells and element
    count stats, all columns in one pass."""
    aggs = []
    for c in cols:
        n_el = F.size(F.split(F.col(c), ","))
        aggs += [F.count(F.col(c)).alias(f"{c}__n"),
                 F.count_if(F.col(c).contains(",")).alias(f"{c}__multi"),
                 F.max(F.when(F.col(c).isNotNull(), n_el)).cast("bigint").alias(f"{c}__max"),
                 F.sum(F.when(F.col(c).isNotNull(), n_el)).alias(f"{c}__sum")]
    row = df.agg(*aggs)
    return rows_from(row, [[
        F.lit(c).alias("column_name"),
        F.col(f"{c}__n").alias("n_non_null"),
        F.col(f"{c}__multi").alias("n_multi_valued"),
        F.col(f"{c}__max").alias("max_elements"),
        F.try_divide(F.col(f"{c}__sum").cast("double"), F.col(f"{c}__n").cast("double"))
         .alias("avg_elements")] for c in cols])


# ------------------------------------------------------------------ values
def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """Frequency per value (null kept as a value when dropna=False)."""
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    return src.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """Most frequent non-null value, ties broken by the smallest value."""
    vc = value_counts(df, col)
    return vc.orderBy(F.col("n").desc(), F.col(col).asc()).limit(1)


def by_each_dimension(df: DataFrame, dims: list[str], aggs: list) -> DataFrame:
    """One GROUPING SETS pass computing ``aggs`` per value of every single
    dimension; rows are labelled (dimension, value)."""
    g = df.groupingSets([[d] for d in dims], *dims).agg(*aggs, F.grouping_id().alias("_gid"))
    dim_name = F.lit(None).cast("string")
    dim_val = F.lit(None).cast("string")
    k = len(dims)
    for i, d in enumerate(dims):
        gid = (1 << k) - 1 - (1 << (k - 1 - i))   # only dimension i is grouped
        dim_name = F.when(F.col("_gid") == gid, F.lit(d)).otherwise(dim_name)
        dim_val = F.when(F.col("_gid") == gid, F.col(d).cast("string")).otherwise(dim_val)
    names = [c for c in g.columns if c not in dims and c != "_gid"]
    return g.select(dim_name.alias("dimension"), dim_val.alias("value"), *names)


def placeholder_profile(df: DataFrame, col: str, dims: list[str], placeholder: str) -> DataFrame:
    """For every (dimension, value): rows, nulls and placeholder rows,
    as one GROUPING SETS aggregation instead of a mask scan per value."""
    g = by_each_dimension(df, dims, [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(col).isNull()).alias("n_null"),
        F.count_if(F.col(col) == placeholder).alias("n_placeholder")])
    return g.select("dimension", "value", "n", "n_null", pct("n_null", "n").alias("pct_null"),
                    "n_placeholder", pct("n_placeholder", "n").alias("pct_placeholder"))


# ------------------------------------------------------------------ referential integrity
def referential_matrix(named: dict[str, DataFrame], key: str) -> DataFrame:
    """For every pair (a, b) of named id sets: sizes, intersection,
    only-a, only-b and % each way.

    One tagged union and ONE ``groupBy(id)`` with ``bit_or`` replaces k(k-1)/2
    set intersections; every pair count is then a ``count_if`` on the mask."""
    names = list(named)
    tagged = reduce(DataFrame.unionByName, [
        df.select(F.col(key).alias("_id"), F.lit(1 << i).alias("_bit"))
          .filter(F.col("_id").isNotNull())
        for i, df in enumerate(named.values())])
    masks = tagged.groupBy("_id").agg(F.bit_or("_bit").alias("_m"))
    m = F.col("_m")
    aggs = [F.count_if((m.bitwiseAND(F.lit(1 << i))) != 0).alias(f"n{i}") for i in range(len(names))]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    both = lambda i, j: (m.bitwiseAND(F.lit((1 << i) | (1 << j)))) == F.lit((1 << i) | (1 << j))
    aggs += [F.count_if(both(i, j)).alias(f"x{i}_{j}") for i, j in pairs]
    row = masks.agg(*aggs)
    out = []
    for i, j in pairs:
        na, nb, nx = F.col(f"n{i}"), F.col(f"n{j}"), F.col(f"x{i}_{j}")
        out.append([F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"),
                    na.alias("n_a"), nb.alias("n_b"), nx.alias("n_intersection"),
                    (na - nx).alias("n_only_a"), (nb - nx).alias("n_only_b"),
                    pct(nx, na).alias("pct_a_in_b"), pct(nx, nb).alias("pct_b_in_a")])
    return rows_from(row, out)


# ------------------------------------------------------------------ rules
def rule_counts(df: DataFrame, dataset: str, rules: list[tuple], total_name: str = "n") -> DataFrame:
    """Every rule = (name, SQL predicate of the problem, *labels);
    all rules of a table are counted in one pass, then unpivoted, giving
    (dataset, rule, n, pct, labels...)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [count_where(F.expr(r[1])).alias(f"_r{i}") for i, r in enumerate(rules)]
    row = df.agg(*aggs)
    n_labels = max(len(r) for r in rules) - 2
    out = []
    for i, r in enumerate(rules):
        labels = [F.lit(x).cast("string") for x in r[2:]]
        labels += [F.lit(None).cast("string")] * (n_labels - len(labels))
        out.append([F.lit(dataset).alias("dataset"), F.lit(r[0]).alias("rule"),
                    F.col(f"_r{i}").alias(total_name), pct(f"_r{i}", "_n").alias("pct"),
                    *[lab.alias(f"label{k}") for k, lab in enumerate(labels)]])
    return rows_from(row, out)


# ------------------------------------------------------------------ per-client sequences
def monotonic_violations(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Per client ordered by snapshot, does any measure decrease?
    Windows are partitioned by client (bounded by the number of snapshots)."""
    w = Window.partitionBy(key).orderBy(order)
    dec = {c: flag(F.col(c) < F.lag(c).over(w)) for c in cols}
    x = df.select(key, *[v.alias(f"_dec_{c}") for c, v in dec.items()])
    per_client = x.groupBy(key).agg(*[F.max(f"_dec_{c}").alias(f"_v_{c}") for c in cols],
                                    F.count(F.lit(1)).alias("_rows"))
    anyv = reduce(lambda a, b: F.greatest(a, b), [F.col(f"_v_{c}") for c in cols])
    return per_client.agg(
        F.count(F.lit(1)).alias("n_clients"),
        *[F.sum(f"_v_{c}").cast("bigint").alias(f"n_violating_{c}") for c in cols],
        (F.avg((anyv == 0).cast("int")) * F.lit(100.0)).alias("pct_clean_clients"))


def row_deltas(df: DataFrame, key: str, order: str, col: str) -> DataFrame:
    """Step of ``col`` between consecutive snapshots per client,
    counted per step value."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.select((F.col(col) - F.lag(col).over(w)).alias("delta")).filter(F.col("delta").isNotNull())
    return d.groupBy("delta").agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """A38 helper: key groups holding more than one row, with their size."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def varying_columns(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Per column, how many keys (clients) carry more than one distinct
    value (least and largest differ) - one grouped pass for all columns, without
    distinct counts, then one pass over the keys."""
    per = df.groupBy(key).agg(*[F.expr(f"min(`{c}`) <> max(`{c}`) AS `{c}`") for c in cols])
    row = per.agg(F.expr("count(1) AS _n"), *[F.expr(f"count_if(`{c}`) AS `{c}`") for c in cols])
    return rows_from(row, [[F.lit(c).alias("column_name"), F.col("_n").alias("n_clients"),
                            F.col(c).alias("n_varying"), pct(c, "_n").alias("pct_varying")]
                           for c in cols])


def column_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """role, size of the role's class and % null of each column, one pass."""
    row = df.agg(F.expr("count(1) AS _n"), *[F.expr(f"count_if(`{c}` IS NULL) AS `{c}`") for c in roles])
    sizes = {r: sum(x == r for x in roles.values()) for r in roles.values()}
    return rows_from(row, [[F.lit(c).alias("column_name"), F.lit(r).alias("role"),
                            F.lit(sizes[r]).alias("n_columns_of_role"), pct(c, "_n").alias("pct_null")]
                           for c, r in roles.items()])


def schema_check(df: DataFrame, table: str, contract: dict[str, str], key: str | None = None) -> DataFrame:
    """Two-sided diff of the actual schema against a contract (driver
    metadata, no job) joined with one null-count pass over the data.
    Columns missing from the data report detected_type 'missing'; columns not
    in the contract report expected_type 'unexpected'. Notes: the least value of
    ``key``, and dates kept as text."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    present = [c for c in list(contract) + [c for c in actual if c not in contract] if c in actual]
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in present],
                 *([F.min(key).cast("string").alias("_least")] if key in actual else []))
    out = []
    for c in list(contract) + [c for c in actual if c not in contract]:
        exp = contract.get(c, "unexpected")
        det = actual.get(c, "missing")
        n_null = F.col(c) if c in actual else F.lit(None).cast("bigint")
        note = F.lit("dates as text" if "date" in c.lower() and det == "string" else "")
        if c == key and c in actual:
            note = F.concat(F.lit("least: "), F.coalesce("_least", F.lit("none")))
        out.append([F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                    F.lit(exp).alias("expected_type"), F.lit(det).alias("detected_type"),
                    F.lit(exp == det).alias("type_ok"), n_null.alias("n_null"),
                    pct(n_null, "_n").alias("pct_null"), note.alias("note")])
    return rows_from(row, out)
