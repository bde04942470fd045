"""Feature screening and selection: A50-A54, V2, V3, V6.

Per-column statistics for every feature are computed in ONE aggregation
and unpivoted; correlations come from a masked Gram matrix (``gram``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope import constants as K
from panelscope.operators.gram import correlations
from panelscope.session import stored


def nullable_columns(df: DataFrame, cols: list[str]) -> set:
    """Columns that actually hold nulls (one bounded metadata row)."""
    row = df.agg(*[F.expr(f"count_if(`{c}` IS NULL) AS `{c}`") for c in cols]).first()
    return {c for c in cols if row[c]}


def corr_with_target(df: DataFrame, features: list[str], target: str,
                     families: dict[str, str]) -> DataFrame:
    """|Pearson r| of every feature with the target (pairwise complete,
    null for constant columns), with the feature family."""
    found = correlations(df, features, [target]).select(F.col("left").alias("feature"), "r")
    # one row a feature: the list of features, not data
    named = df.sparkSession.createDataFrame([(f, families.get(f, "Other")) for f in features],
                                            "feature string, family string")
    return named.join(found, "feature", "left").select("feature", F.round(F.abs("r"), 9).alias("abs_corr"), "family")


def high_corr_pairs(df: DataFrame, features: list[str], threshold: float = K.HIGH_CORRELATION) -> DataFrame:
    """All feature pairs with |r| > threshold (compared unrounded), full
    data (no sample), any number of features in one pass."""
    return correlations(df, features).filter(F.abs("r") > threshold).select(
        F.col("left").alias("feature_1"), F.col("right").alias("feature_2"),
        F.round(F.abs("r"), 9).alias("abs_corr"))


def column_profile(df: DataFrame, features: list[str], numeric: list[str]) -> DataFrame:
    """Per column: share of zeros (null = non-zero, non-numeric = 0), share
    of nulls, sample std - one pass over the table."""
    number = set(numeric)
    measured = [(f"avg(CAST(coalesce(`{f}` = 0, false) AS INT))", f"round(stddev_samp(`{f}`), 6)") if f in number
                else ("0D", "CAST(NULL AS DOUBLE)") for f in features]
    row = df.agg(*[F.expr(e) for i, (f, (zero, std)) in enumerate(zip(features, measured)) for e in (
        f"{zero} AS z{i}", f"avg(CAST(`{f}` IS NULL AS INT)) AS m{i}", f"{std} AS s{i}")])
    rows = ", ".join(f"named_struct('feature', {f!r}, 'pct_zero', z{i}, 'pct_missing', m{i}, 'std', s{i})"
                     for i, f in enumerate(features))
    return row.selectExpr(f"inline(array({rows}))")


def selection_decisions(profile: DataFrame, rfm_duplicates, known_near_zero, keep,
                        near_zero_threshold: float = K.NEAR_ZERO_SHARE) -> DataFrame:
    """V2/V3: removal = RFM duplicates + known near-zero + detected near-zero,
    minus the keep list; one row per feature with status and reason."""
    f = F.col("feature")
    nz = F.col("pct_zero") > near_zero_threshold
    reason = (F.when(f.isin(*keep), "kept")
               .when(f.isin(*rfm_duplicates), "rfm_duplicate")
               .when(f.isin(*known_near_zero) | nz, "near_zero")
               .otherwise("kept"))
    return profile.select("feature",
                          F.when(reason == "kept", "kept").otherwise("removed").alias("status"),
                          reason.alias("reason"), "pct_zero", "pct_missing")


# ------------------------------------------------------------------ V2 applied, V6 on what was stored
def drop_list(decisions: DataFrame) -> list[str]:
    """The removed features (at most a row a column of the table)."""
    return sorted(r["feature"] for r in decisions.filter("status = 'removed'").select("feature").collect())


def store_selection(train: DataFrame, test: DataFrame, decisions: DataFrame,
                    folder: str) -> tuple[DataFrame, DataFrame]:
    """V2: the decisions and the train and test tables without the removed
    columns, written below ``folder``; the tables as read again."""
    spark = train.sparkSession
    decisions.write.parquet(f"{folder}/decisions")
    drop = drop_list(spark.read.parquet(f"{folder}/decisions"))
    return tuple(stored(df.drop(*drop), f"{folder}/{name}") for name, df in (("train", train), ("test", test)))


def stored_columns(train: DataFrame, test: DataFrame) -> DataFrame:
    """split, column_name, position, n_rows, n_known of the reduced tables, one pass each."""
    parts = []
    for split, df in (("train", train), ("test", test)):
        names = df.columns
        row = df.agg(F.expr("count(1) AS n"), *[F.expr(f"count(`{c}`) AS k{i}") for i, c in enumerate(names)])
        rows = ", ".join(f"named_struct('column_name', '{c}', 'position', {i + 1}, 'n_rows', n, 'n_known', k{i})"
                         for i, c in enumerate(names))
        parts.append(row.selectExpr(f"'{split}' AS split", f"inline(array({rows}))"))
    return parts[0].unionByName(parts[1])


def validate_selection(train: DataFrame, test: DataFrame, numeric: list[str], duplicates, required,
                       near_zero_threshold: float = K.NEAR_ZERO_SHARE) -> DataFrame:
    """V6: violations found in reduced tables, by their stored schemas and one
    pass over train: columns of too many zeros or that repeat others, columns
    on one side only, required columns that are missing on a side."""
    left = [c for c in numeric if c in train.columns]
    sides = (set(train.columns), set(test.columns))
    counted = {"no_rfm_duplicate_left": len(set(duplicates) & (sides[0] | sides[1])),
               "train_test_aligned": len(sides[0] ^ sides[1]),
               "targets_and_keys_present": sum(len(set(required) - side) for side in sides)}
    near = " + ".join(["0", *[f"CAST(coalesce(avg(CAST(coalesce(`{c}` = 0, false) AS INT)) > {near_zero_threshold}, "
                              "false) AS INT)" for c in left]])
    rows = ", ".join(f"named_struct('check_name', '{n}', 'n_violations', CAST({v} AS BIGINT))"
                     for n, v in {"no_near_zero_left": "near", **counted}.items())
    return train.agg(F.expr(f"{near} AS near")).selectExpr(f"inline(array({rows}))")
