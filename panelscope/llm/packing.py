"""Packing into length buckets of least padding, and token-budget batches.

Rows are counted by length, every length on its own; the driver gets one
count a length. Texts of d different lengths have at least d * (d - 1) / 2
words in all, so there are at most about sqrt(2 x words) counts: 6 million in
the worst case of 100 TB. Dynamic programming over that global histogram
chooses the bucket boundaries that minimise the total padding; a bucket is as
wide as its longest row. Then rows of a bucket form batches of at most
``budget`` padded tokens.

Rows are dealt to parts by a hash of all their columns and numbered inside a
bucket with the parts' offsets, so a bucket or an id with most of the rows is
no single task, and batches don't depend on how the rows lie.
A row longer than the budget is a batch of its own.

Defined results: a null or empty text has length 0, is padded to its bucket's
width like any other, and counts as one token where that width would be 0;
repeated rows are packed separately, and rows that share id and length are
copies; an empty table gives no rows; columns other than id and text are
ignored by ``pack_documents``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.layout import cut, numbered

N_BUCKETS = 16
BUDGET = 16_384
ROWS_PER_PART = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def best_boundaries(widths: np.ndarray, rows: np.ndarray, n_buckets: int) -> list[int]:
    """Upper widths of at most ``n_buckets`` buckets over an ascending
    histogram, with the least total of (bucket width x rows). The true
    lengths' sum is the same for any choice, so this minimises padding.

    The cost of an interval obeys the quadrangle inequality: the best split
    never moves left as the interval grows. So the middles of all open
    stretches are settled at once, each between its neighbours' splits, and
    every level of halving looks at each cell about once.
    """
    w, d = np.asarray(widths, dtype=np.int64), len(widths)
    if d == 0:
        return []
    c = np.concatenate([[0], np.cumsum(np.asarray(rows, dtype=np.int64))])
    best = w * c[1:]
    from_ = [np.zeros(d, dtype=np.int64)]
    for _ in range(1, min(n_buckets, d)):
        # the last bucket holds cells i .. mid; i = 0: all in one bucket
        ahead = np.concatenate([[0], best[:-1]])
        new, arg = np.empty(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        lo, hi, left, right = (np.array([x], dtype=np.int64) for x in (0, d - 1, 0, d - 1))
        while len(lo):
            mid = (lo + hi) // 2
            n = np.minimum(mid, right) - left + 1
            start = np.cumsum(n) - n
            i = np.arange(n.sum()) + np.repeat(left - start, n)
            at = np.repeat(mid, n)
            cost = ahead[i] + w[at] * (c[at + 1] - c[i])
            new[mid] = np.minimum.reduceat(cost, start)
            hits = np.flatnonzero(cost == np.repeat(new[mid], n))
            arg[mid] = i[hits[np.searchsorted(hits, start)]]
            split = arg[mid]
            lo, hi, left, right = (np.concatenate(x) for x in (
                (lo, mid + 1), (mid - 1, hi), (left, split), (split, right)))
            open_ = lo <= hi
            lo, hi, left, right = lo[open_], hi[open_], left[open_], right[open_]
        best = new
        from_.append(arg)
    ends, at = [], d - 1
    for arg in reversed(from_):
        ends.append(at)
        at = int(arg[at]) - 1
        if at < 0:
            break
    return [int(w[e]) for e in reversed(ends)]


def pack(rows: DataFrame, length: str, key: list[str], n_buckets: int = N_BUCKETS,
         budget: int = BUDGET, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Add to ``rows`` (small columns only): bucket, width (padded length),
    batch (number inside the bucket) and slot (place inside the batch).
    ``key`` orders the rows of a bucket, then all other columns."""
    rows = cut(rows.withColumn("padded_", F.greatest(F.col(length), F.lit(1)).cast("long")))
    cells = rows.groupBy("padded_").agg(F.count(F.lit(1)).alias("n")).orderBy("padded_").toArrow()
    counts = cells.column("n").to_numpy()
    widths = best_boundaries(cells.column("padded_").to_numpy(), counts, n_buckets)
    bounds = F.array(*[F.lit(w).cast("long") for w in widths]) if widths else \
        F.array().cast("array<bigint>")
    out = rows.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("padded_")))) \
        .withColumn("width", F.element_at(bounds, F.col("bucket") + 1)).drop("padded_")
    out = numbered(out, ["bucket"], key, max(1, math.ceil(int(counts.sum()) / rows_per_part)), "at_")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("width"))).cast("long")
    return (out.withColumn("batch", F.floor(F.col("at_") / per_batch).cast("long"))
            .withColumn("slot", (F.col("at_") % per_batch).cast("int")).drop("at_"))


def pack_documents(documents: DataFrame, n_buckets: int = N_BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens (words), bucket, width, batch, slot of every document."""
    rows = documents.select("doc_id", word_count(F.col("text")).alias("n_tokens"))
    return pack(rows, "n_tokens", ["doc_id"], n_buckets, budget)
