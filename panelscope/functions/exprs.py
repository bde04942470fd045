"""Null-safe column expressions shared by all operators.

The rules follow pandas semantics where the reference relies on them
(null compares as False, sum of nothing is 0, null group keys are dropped)
while staying inside Spark's built-in, codegen-friendly functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """Boolean condition as 0/1 int; a null condition counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def present(c: ColumnOrName) -> Column:
    """1 where the value is known, 0 where it is null."""
    return col(c).isNotNull().cast("int")


def count_where(cond: Column) -> Column:
    """Number of rows where ``cond`` is true (null counts as false)."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den as double, null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct(num: ColumnOrName, den: ColumnOrName) -> Column:
    """100 * num / den as double, null when den is 0."""
    return F.try_divide(col(num).cast("double") * F.lit(100.0), col(den).cast("double"))


# Money is summed exactly: in fixed point (1/10000 units in a long) for
# per-entity aggregates, where the total stays below 2^53 units (~9e11), and
# as DECIMAL for unbounded totals. Both give the value an exact DECIMAL(18,4)
# sum would give, rounded half-up to cents, independent of partitioning.
_FIXED = 10000.0


def fixed4(c: ColumnOrName) -> Column:
    """Money as a long count of 1/10000 units (exact for 4-decimal amounts)."""
    return F.round(col(c) * F.lit(_FIXED)).cast("bigint")


# The same as SQL text: a table of many columns is built far faster from text
# than from column objects. ``format`` takes the columns' names.
UNITS = "CAST(round({0} * 10000D) AS BIGINT)"
#: a total of units as money, rounded half-up to cents; nothing is 0
CENTS = "round(CAST(coalesce({0}, 0) AS DOUBLE) / 10000D, 2)"
#: mean of {1} amounts whose total is given in units; of none: null
UNITS_MEAN = "try_divide(CAST({0} AS DOUBLE) / 10000D, CAST({1} AS DOUBLE))"
#: sample deviation of {2} amounts from the totals of their units and of the units'
#: squares: exact up to the root while the products fit a decimal
UNITS_STDDEV = (
    "CASE WHEN {2} > 1 THEN sqrt(greatest(coalesce(CAST(try_subtract("
    "try_multiply(CAST({2} AS DECIMAL(38,0)), CAST({1} AS DECIMAL(38,0))), "
    "try_multiply(CAST({0} AS DECIMAL(38,0)), CAST({0} AS DECIMAL(38,0)))) AS DOUBLE), "
    "{2} * CAST({1} AS DOUBLE) - pow(CAST({0} AS DOUBLE), 2)), 0D) / ({2} * CAST({2} - 1 AS DOUBLE))) / 10000D END")


def money_sum(c: ColumnOrName, scale: int = 2, fixed: bool = True) -> Column:
    """Order-independent money total rounded to ``scale`` decimals (half-up),
    as double; null when every input is null. ``fixed`` for per-entity totals
    only, as a long overflows on unbounded groups."""
    if fixed:
        return F.round(F.sum(fixed4(c)).cast("double") / F.lit(_FIXED), scale)
    s = F.sum(col(c).cast("decimal(28,4)"))
    return F.round(s, scale).cast("double")


def money_total(c: ColumnOrName, scale: int = 2, fixed: bool = True) -> Column:
    """``money_sum`` with pandas' ``sum`` of nothing = 0."""
    return F.coalesce(money_sum(c, scale, fixed=fixed), F.lit(0.0))


def money_mean(c: ColumnOrName, fixed: bool) -> Column:
    """Mean of known values, bit-stable across partitionings: ``fixed`` for
    per-entity means only, as a long overflows on unbounded groups."""
    if fixed:
        s = F.sum(fixed4(c)).cast("double") / F.lit(_FIXED)
    else:
        s = F.sum(col(c).cast("decimal(28,4)")).cast("double")
    return F.try_divide(s, F.count(col(c)).cast("double"))


def fround(c: ColumnOrName, digits: int = 6) -> Column:
    """Round a floating result that is never an exact decimal tie (std,
    skew, correlation, logs) so engines that differ in the last bits agree."""
    return F.round(col(c), digits)




def months_between_int(end: ColumnOrName, start: ColumnOrName) -> Column:
    """Calendar months between two dates, ignoring the day of month."""
    return ((F.year(col(end)) - F.year(col(start))) * 12
            + (F.month(col(end)) - F.month(col(start)))).cast("bigint")


def guarded_corr(x: ColumnOrName, y: ColumnOrName, digits: int = 9) -> Column:
    """Pairwise-complete Pearson r; null (not an ANSI error) when either side
    is constant or fewer than two complete pairs exist."""
    xc, yc = col(x).cast("double"), col(y).cast("double")
    both = xc.isNotNull() & yc.isNotNull()
    xm, ym = F.when(both, xc), F.when(both, yc)
    den = F.stddev_pop(xm) * F.stddev_pop(ym)
    r = F.try_divide(F.covar_pop(xm, ym), F.when(den > 0, den))
    return F.round(r, digits)
