"""Mergeable as-of state: what each snapshot knows, without joining events to
snapshots.

All dates at which some window of some snapshot begins or ends cut time into
intervals. Events are aggregated once per (key, interval) - a state that
merges, of as many rows a key as there are intervals at most, whatever the
number of events. A window (start, end] of a snapshot is the sum of the
intervals inside, so that each row of the state is dealt to the snapshots that
see it. The work grows with events + keys x intervals x snapshots, not with
events x snapshots.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERVAL = "_interval"


def add_months(day: dt.date, months: int) -> dt.date:
    """Calendar months later; a day that the month doesn't have becomes its last."""
    n = day.year * 12 + day.month - 1 + months
    year, month = divmod(n, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


@dataclass
class Timeline:
    """Snapshots, and windows as offsets in months from them: name ->
    (after, up to), after None for all history."""
    dates: list[dt.date]
    windows: dict[str, tuple[int | None, int]]
    offsets: list[int] = field(init=False)
    cuts: list[dt.date] = field(init=False)

    def __post_init__(self) -> None:
        self.dates = sorted(set(self.dates))
        self.offsets = sorted({m for w in self.windows.values() for m in w if m is not None})
        self.cuts = sorted({add_months(d, m) for d in self.dates for m in self.offsets})

    def interval(self, day: str) -> Column:
        """Number of cuts before column ``day`` (null: after the last), by halving."""
        def between(lo: int, hi: int) -> str:
            if lo == hi:
                return str(lo) if lo < len(self.cuts) else "NULL"
            mid = (lo + hi) // 2
            return (f"CASE WHEN `{day}` <= DATE'{self.cuts[mid]}' THEN {between(lo, mid)} "
                    f"ELSE {between(mid + 1, hi)} END")
        return F.expr(f"CASE WHEN `{day}` IS NOT NULL THEN {between(0, len(self.cuts))} END")

    def tagged(self, events: DataFrame, date_col: str) -> DataFrame:
        """Events up to the last cut (a bound that reaches the scan) with their interval."""
        return events.filter(F.col(date_col) <= F.lit(self.cuts[-1])) \
            .withColumn(INTERVAL, self.interval(date_col))

    def seen_by(self) -> str:
        """For each interval the snapshots that see it in some window, with a flag
        a window, as an SQL array of arrays of (day, window flags in the order of ``windows``)."""
        place = {c: i for i, c in enumerate(self.cuts)}

        def inside(i: int, day: dt.date, window: tuple[int | None, int]) -> bool:
            after, to = window
            return i <= place[add_months(day, to)] and (after is None or i > place[add_months(day, after)])

        lines = []
        for i in range(len(self.cuts) + 1):
            found = {d: [inside(i, d, w) for w in self.windows.values()] for d in self.dates}
            flags = ["struct(" + ", ".join([f"DATE'{d}' AS _day", *[
                f"{'true' if f else 'false'} AS _in{k}" for k, f in enumerate(fs)]]) + ")"
                for d, fs in found.items() if any(fs)]
            lines.append(flags)
        last = next(x[0] for x in lines if x)
        return "array(" + ", ".join(f"array({', '.join(x)})" if x else f"slice(array({last}), 1, 0)" for x in lines) + ")"


def first_seen(tagged: DataFrame, key: str, items: dict[str, str], day: str | None = None,
               squares: str = "gap_sq") -> DataFrame:
    """State of distinct counts: each (key, item) counts in its first interval,
    as the column that ``items`` names for the item's column. All items come
    from one pass (grouping sets). For the item ``day``, the squared gaps
    between a key's consecutive days are summed as well, each in the interval of
    the later day; that window runs over distinct days, never over raw events."""
    sets = tagged.groupingSets([[key, c] for c in items], key, *items).agg(
        F.min(INTERVAL).alias(INTERVAL), *[F.grouping(c).alias(f"_g_{c}") for c in items])
    kind = "CASE " + " ".join(f"WHEN _g_{c} = 0 AND `{c}` IS NOT NULL THEN {i}" for i, c in enumerate(items)) + " END"
    first = sets.selectExpr(f"`{key}`", INTERVAL, f"{kind} AS _kind", *([f"`{day}` AS _day"] if day else [])) \
        .filter("_kind IS NOT NULL")
    counts = [f"count_if(_kind = {i}) AS `{n}`" for i, n in enumerate(items.values())]
    if day is None:
        return first.groupBy(key, INTERVAL).agg(*[F.expr(c) for c in counts])
    # a fixed number of partitions: beside a larger part of the state, adaptive
    # execution would put all days in one task, as they are small when compressed
    first = first.repartition(int(tagged.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    gap = f"CAST(datediff(_day, lag(_day) OVER (PARTITION BY `{key}` ORDER BY _kind, _day)) AS BIGINT)"
    which = list(items).index(day)
    # days alone have a day, so that a lag into another kind is null
    return first.selectExpr(f"`{key}`", INTERVAL, "_kind", f"CASE WHEN _kind = {which} THEN {gap} END AS _gap") \
        .groupBy(key, INTERVAL).agg(*[F.expr(c) for c in counts], F.expr(f"sum(_gap * _gap) AS `{squares}`"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Several states as one table; the running window adds up rows of the same interval."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def windows_of(state: DataFrame, key: str, timeline: Timeline, sums: dict[str, tuple[str, str]],
               lows: dict[str, str] | None = None, highs: dict[str, str] | None = None,
               history: str = "hist", snap_col: str = "date_target") -> DataFrame:
    """One row per key and snapshot that sees any of its events.

    ``sums``: output -> (additive state column, window); ``lows`` / ``highs``:
    output -> state column, smallest / largest value of all history. Each row of
    the state goes to the snapshots that see its interval, and one aggregation
    adds up each window's rows; nothing is sorted."""
    low, high = lows or {}, highs or {}
    number = {w: k for k, w in enumerate(timeline.windows)}
    columns = [f"`{c}`" for c in state.columns if c != INTERVAL]
    # one shuffle, of the state by key; what follows, and joins on the key, stay there
    at = state.repartition(key).selectExpr(*columns, f"inline(element_at({timeline.seen_by()}, {INTERVAL} + 1)) AS (`{snap_col}`, "
                          + ", ".join(f"_in{k}" for k in number.values()) + ")")
    inside = lambda c, w: f"CASE WHEN _in{number[w]} THEN `{c}` END"
    out = at.groupBy(key, snap_col).agg(
        F.expr(f"max(_in{number[history]}) AS _seen"),
        *[F.expr(f"coalesce(sum({inside(c, w)}), 0) AS `{n}`") for n, (c, w) in sums.items()],
        *[F.expr(f"min({inside(c, history)}) AS `{n}`") for n, c in low.items()],
        *[F.expr(f"max({inside(c, history)}) AS `{n}`") for n, c in high.items()])
    return out.filter("_seen").drop("_seen")
