"""Masked Gram matrix: every pairwise-complete correlation from one pass.

For columns with gaps, the correlation of a pair is taken over the rows where
both are known. All that it needs are sums over those rows - count, both
columns, their squares and their product - and these are entries of four
matrix products of the values (gaps as 0) and the mask of known values. Each
task multiplies its Arrow batches and emits one row a pair; sums merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.session import ensure_checkpoint_dir

#: A variance below this share of the second moment is rounding: the column is constant there.
_CONSTANT = 1e-13


def staged_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, written once to the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in columns]).checkpoint(eager=True)


def centres(numbers: DataFrame, columns: list[str]) -> dict[str, float]:
    """A value near each column's mean, the column's own where it is constant
    (one row). Sums are taken from there, so that large means cost no digits."""
    row = numbers.agg(*[F.expr(f"CASE WHEN min(`{c}`) = max(`{c}`) THEN min(`{c}`) ELSE avg(`{c}`) END AS `{c}`")
                        for c in columns]).first()
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in columns}


def gram(numbers: DataFrame, left: list[str], right: list[str], centre: dict[str, float]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of each left column i and right column j."""
    columns = list(dict.fromkeys([*left, *right]))
    at_l, at_r = [columns.index(c) for c in left], [columns.index(c) for c in right]
    shift = np.array([centre[c] for c in columns])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(at_l), len(at_r)))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            known = np.column_stack([np.asarray(batch.column(c).is_valid()) for c in columns])
            x = np.where(known, x - shift, 0.0)
            m = known.astype(np.float64)
            xl, xr, ml, mr = x[:, at_l], x[:, at_r], m[:, at_l], m[:, at_r]
            total += [ml.T @ mr, xl.T @ mr, ml.T @ xr, (xl * xl).T @ mr, ml.T @ (xr * xr), xl.T @ xr]
        i, j = np.indices(total.shape[1:])
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)),
             *[pa.array(t.ravel()) for t in total]], names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    out = numbers.select(*columns).mapInArrow(
        multiply, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return out.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlations(df: DataFrame, left: list[str], right: list[str] | None = None) -> DataFrame:
    """left, right, n, r: Pearson r of each pair (of ``left`` alone: each pair
    once) over the rows where both are known; null where either is constant
    there or fewer than two rows know both."""
    columns = list(dict.fromkeys([*left, *(right or [])]))
    numbers = staged_numbers(df, columns)
    sums = gram(numbers, left, right or left, centres(numbers, columns))
    if right is None:
        sums = sums.filter("i < j")
    name = lambda names, at: f"element_at(array({', '.join(repr(c) for c in names)}), {at} + 1)"
    var = lambda s, ss: f"CASE WHEN {ss} - {s} * {s} / n > {_CONSTANT} * {ss} THEN {ss} - {s} * {s} / n END"
    return sums.filter("n >= 2").selectExpr(
        "i", "j", "n", f"(sxy - sx * sy / n) / sqrt(({var('sx', 'sxx')}) * ({var('sy', 'syy')})) AS r").selectExpr(
        f"{name(left, 'i')} AS left", f"{name(right or left, 'j')} AS right", "CAST(n AS BIGINT) AS n",
        "CASE WHEN r > 1 THEN 1D WHEN r < -1 THEN -1D ELSE r END AS r")
