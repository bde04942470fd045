"""Packing and sharding where ids repeat, rows repeat and lengths are large:
results follow from the rows alone, and padding is the least there is."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.llm import layout, packing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    sizes = [0, 0, 1, 2, 511, 513, 683, 1319, 2172, 2173, 5000, *rng.integers(0, 3000, 30)]
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 99, n)) for n in sizes]
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(3, t) for t in texts[20:]] + [(None, t) for t in texts[:25]] + [(None, None)] * 3
    return out + [(7, "one row in full, often")] * 40


def table(spark, rows, order, parts):
    data = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in (rows[k] for k in order)]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def test_results_do_not_depend_on_how_rows_lie(spark, rows, monkeypatch):
    monkeypatch.setattr(layout, "COPIES", 8)
    orders = [(range(len(rows)), 1), (np.random.default_rng(1).permutation(len(rows)), 5), (range(len(rows))[::-1], 3)]
    for name, run in {
            "packing": lambda d: packing.pack(
                d.select("doc_id", packing.word_count(F.col("text")).alias("n")), "n", ["doc_id"], 4, 4000, 9),
            "sharding": lambda d: sharding.shard_rows(
                d.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h")),
                ["doc_id"], 4, rows_per_part=9)}.items():
        first, *others = [rows_of(run(table(spark, rows, *o))) for o in orders]
        assert len(first) == len(rows) and all(first == other for other in others), name


def test_numbers_have_no_gaps_whatever_the_blocks(spark, rows, monkeypatch):
    d = table(spark, rows, range(len(rows)), 3).select("doc_id", F.length("text").alias("n"))
    for copies, parts in ((1, 1), (7, 4), (4096, 3)):
        monkeypatch.setattr(layout, "COPIES", copies)
        got = layout.numbered(d, ["doc_id"], ["n"], parts, "at").collect()
        assert sorted((repr(r["doc_id"]), repr(r["n"])) for r in got) == sorted(
            (repr(i), repr(None if t is None else len(t))) for i, t in rows)
        for id_ in {r["doc_id"] for r in got}:
            at = sorted(r["at"] for r in got if r["doc_id"] == id_)
            assert at == list(range(len(at)))


def test_buckets_are_as_wide_as_their_longest_row_and_pad_least(spark, rows):
    lengths = sorted(max(1, len((t or "").split())) for _, t in rows)
    got = packing.pack_documents(table(spark, rows, range(len(rows)), 3), n_buckets=3, budget=9000).collect()
    for bucket in {r["bucket"] for r in got}:
        here = [r for r in got if r["bucket"] == bucket]
        assert {r["width"] for r in here} == {max(1, max(r["n_tokens"] for r in here))}

    def total(ends):
        return sum(min(e for e in ends if e >= n) for n in lengths)

    distinct = sorted(set(lengths))
    least = min(total((*some, distinct[-1])) for some in itertools.combinations(distinct[:-1], 2))
    assert sum(r["width"] for r in got) == least


def test_boundaries_of_many_lengths_equal_a_plain_table():
    rng = np.random.default_rng(3)
    for _ in range(5):
        widths = np.unique(rng.integers(1, 10**6, 120))
        counts = rng.integers(1, 10**5, len(widths))
        sums = np.concatenate([[0], np.cumsum(counts)])
        best = [int(w) * int(sums[k + 1]) for k, w in enumerate(widths)]
        for _ in range(6):
            best = [min([int(w) * int(sums[k + 1])] +
                        [best[i - 1] + int(w) * int(sums[k + 1] - sums[i]) for i in range(1, k + 1)])
                    for k, w in enumerate(widths)]
        ends = packing.best_boundaries(widths, counts, 7)
        assert sum(int(c) * min(e for e in ends if e >= w) for w, c in zip(widths, counts)) == best[-1]
