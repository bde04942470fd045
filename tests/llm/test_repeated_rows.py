"""Repeated and null ids in exact and near-duplicate removal."""

import collections
import hashlib

import numpy as np

from panelscope.llm import exact_dedup, near_dedup, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n=300):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def near_brute(rows, pct):
    """component_id and kept of each row, and how many components there are."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[top(k)].append(i)
    least = {r: min((i for i in got if i is not None), default=None) for r, got in ids.items()}
    return [(i, len(sets[k]), i if not sets[k] else least[top(k)]) for k, (i, _) in enumerate(rows)], len(ids)


ROWS = [(1, words(1)), (1, words(2)), (2, words(1) + " tail one"), (3, words(2) + " tail two"),
        (None, words(3)), (None, words(3) + " x y"), (None, words(4)), (9, words(4) + " z"), (5, words(5)),
        (5, words(5)), (5, words(5) + " end"), (7, None), (None, ""), (8, " \n"), (4, "one two"), (6, "ONE two")]


def test_no_link_is_lost_where_ids_repeat_or_are_null(spark):
    for pct in (80, 85):
        got = near_dedup.near_groups(table(spark, ROWS), pct).collect()
        want, n = near_brute(ROWS, pct)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == \
            sorted(want, key=repr)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
        # near copies with null ids: the rows of one text are kept
        assert sum(r["kept"] for r in got if r["doc_id"] is None and r["n_shingles"] > 290 and
                   r["component_id"] is None) == 1


def test_stage_keeps_one_text_of_each_group(spark):
    kept = stages.near_dedup(spark, table(spark, ROWS), "").collect()
    assert len({(r["doc_id"], r["text"]) for r in kept}) == near_brute(ROWS, 80)[1]
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_collisions_among_null_and_repeated_ids_are_seen(spark):
    rows = [(None, "aaa"), (None, "bbb"), (None, "AAA"), (1, "ccc"), (1, "ddd"), (1, "ccc"), (2, "eee"), (None, None),
            (3, "")]
    got = exact_dedup.exact_groups(table(spark, rows), 2, (2, 2, 2, 2)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").lower().encode()).hexdigest()].append(i)
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    out = exact_dedup.without_copies(table(spark, rows)).collect()
    assert sorted((r["text"] or "").lower() for r in out) == ["", "aaa", "bbb", "ccc", "ddd", "eee"]
