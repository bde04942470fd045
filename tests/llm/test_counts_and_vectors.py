"""Token counts, hard negatives and centroid clustering against plain Python."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelscope.llm import centroid_clustering as CC
from panelscope.llm import hard_negatives as HN
from panelscope.llm import token_counts as TC
from panelscope.llm.batches import text_slices
from panelscope.llm.bpe import load

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string"
VECTORS = "vec_id long, embedding array<float>, label int"
TAKEN = ("n_bytes", "n_tokens", "over_limit", "row", "id", "vec", "block", "cluster", "distance", "node", "upper",
         "anchor", "score", "scanned")


def clashing(df):
    for name in TAKEN:
        df = df.withColumn(name, F.lit("taken"))
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- token counts -----------------------------------------------------------

def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(3)
    parts = [*"aab'  \n\tstrevlmd1 9.!é漢 \x85\x1c٣Ⅷ😀", "<|endoftext|>", "'s", "'ll", "'re", "n't", " the", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return texts + [None, "", " ", "  ", "'", "'s", " 's", "\n's", "a  'll", "don't've", "a <|endoftext|> b",
                    "<|endoftext|><|endoftext|>", "<|endof", "text|>", "x" * 5000, "ab " * 40_000, "漢字" * 3000]


def test_counts_equal_the_library():
    texts, table = odd_texts(), TC.Lengths(load(PATH)).ready()
    want = [len(e.ids) for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = np.concatenate([TC.counts_of(t, table) for t in text_slices(pa.array(texts), 4096)])
    assert got.tolist() == want


def test_long_texts_are_cut_where_no_match_goes_over(monkeypatch):
    table = TC.Lengths(load(PATH)).ready()
    for text in ("word, other  's " * 300 + "\n end", "no blanks at all" .replace(" ", "") * 200, "é " * 500):
        t = next(text_slices(pa.array([text])))
        assert sum(len(p.buf) for p in TC.pieces(t, 100)) == len(t.buf)
        whole = TC.counts_of(t, table)[0]
        monkeypatch.setattr(TC.pieces, "__defaults__", (100,))
        assert TC.counts_of(t, table)[0] == whole
        monkeypatch.undo()


def test_query_with_and_without_a_table(spark):
    texts = odd_texts()[::7] + ["same text " * 200] * 3
    docs = spark.createDataFrame([(i if i % 50 else None, t, "en") for i, t in enumerate(texts)], SCHEMA)
    want = [len(e.ids) for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = sorted(((i if i % 50 else None, len((t or "").encode()), n, n > 512)
                   for i, (t, n) in enumerate(zip(texts, want))), key=repr)
    for kw in ({}, {"sample_rows": 0}, {"entries": 5}):
        assert rows_of(TC.token_counts(clashing(docs).repartition(3), PATH, **kw)) == rows


def test_the_table_holds_what_is_frequent(spark):
    docs = spark.createDataFrame([(i, "often often often rare%d" % i, "en") for i in range(60)], SCHEMA)
    table = TC.frequent(docs, TC.Lengths(load(PATH)), entries=3)
    p = TC.pre_tokens_as_given([b" often"], TC.Lengths(load(PATH)).ready())
    assert len(table.key) == 3 and p.first[0] in table.key
    small = TC.Lengths(load(PATH), cache_entries=2).ready()
    assert [small.tokens_of(w) for w in ("a", "bb", "ccc", "a")] == [1, 1, 2, 1] and len(small.cache) <= 2


def test_counts_of_an_empty_table(spark):
    assert TC.token_counts(spark.createDataFrame([], SCHEMA), PATH).collect() == []


# --- vectors ----------------------------------------------------------------

def vectors(n=420, dims=6, seed=1):
    """Clusters, one very common vector, ties, repeated rows, repeated and
    null ids, vectors that take no part, and shorter ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centres[i % 12] + 0.05 * rng.normal(size=dims) if i % 3 else centres[0]
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 10)) if i % 3 else 1))
    rows += [rows[50], rows[51], (100, rows[7][1], 3), (None, rows[8][1], 4), (None, rows[3][1], 1)]
    rows += [(350, None, 1), (700, rows[1][1], None), (701, [None] + rows[1][1][1:], 2),
             (702, [math.nan] + rows[1][1][1:], 2), (750, [math.inf] * dims, 2), (703, [0.0] * dims, 5),
             (800, [0.0] * dims, 5)]
    return rows


def usable(rows, dims=None):
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and dims in (None, len(v)):
            yield i, [math.floor(256 * x) for x in v], label


def mined_brute(rows):
    kept = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label)
            for i, v, label in usable(rows) if label is not None]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, q, label) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), i, other == label)
                  for b, (i, v, other) in enumerate(kept) if a != b]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, positive, _ in [s for s in scored if s[2]][:5]:
            found = [s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(anchor, positive, k, i, p, s) for k, (s, i, _) in enumerate(found, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows,group_anchors", [(8192, 8192), (40, 3)])
def test_mined_equals_brute_force(spark, monkeypatch, block_rows, group_anchors):
    monkeypatch.setattr(HN, "BATCH_ANCHORS", 64 if block_rows > 40 else 2)
    rows = vectors() + [(850, [0.5, -0.25], 2), (851, [], 2)]
    df = clashing(spark.createDataFrame(rows, VECTORS)).repartition(3)
    got = rows_of(HN.mined(df, block_rows=block_rows, group_anchors=group_anchors))
    assert got == mined_brute(rows) and len(got) > 50


def test_mined_of_nothing(spark):
    assert HN.mined(spark.createDataFrame([], VECTORS)).collect() == []
    assert HN.mined(spark.createDataFrame([(50, [1.0], 1), (None, [1.0], 1), (1, [], None)], VECTORS)).collect() == []


def test_cover_tree_covers_and_bounds(monkeypatch):
    rng = np.random.default_rng(4)
    for x in (rng.integers(-300, 300, (500, 8)).astype(float), np.zeros((90, 3)), np.full((200, 4), 7.0),
              np.repeat(rng.integers(-9, 9, (5, 4)).astype(float), 60, axis=0)):
        size = max(float(HN.norms(x).max()), 1.0)
        points = HN.augmented(x, size)
        tree = HN.cover_tree(points, leaf_rows=8, max_children=5)
        for i, leaf in enumerate(tree.leaf):
            node = leaf
            while node >= 0:  # a point lies within the radius of all nodes above it
                assert np.linalg.norm(points[i] - points[tree.centre[node]]) <= tree.radius[node] + 1e-6
                node = tree.parent[node]
        order = np.argsort(tree.leaf, kind="stable")
        leaves, edge = np.unique(tree.leaf[order], return_index=True)
        label = np.zeros(len(x), np.int64)
        block = HN.Block(order, order, label, x[order], size, x[tree.centre], tree.parent, tree.radius, leaves,
                         np.append(edge, len(x)))
        q = rng.integers(-300, 300, (20, x.shape[1])).astype(float)
        low, high = block.leaf_bounds(q)
        for k in range(len(leaves)):
            s = HN.scores(block.x[block.edge[k]:block.edge[k + 1]], q)
            assert (s >= low[:, [k]]).all() and (s <= high[:, [k]]).all()


def test_descent_skips_nodes():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.integers(-300, 300, (40, 8)), 30, axis=0) + rng.integers(-3, 3, (1200, 8))
    x = x.astype(float)
    size = float(HN.norms(x).max())
    tree = HN.cover_tree(HN.augmented(x, size))
    order = np.argsort(tree.leaf, kind="stable")
    leaves, edge = np.unique(tree.leaf[order], return_index=True)
    block = HN.Block(order, order, np.zeros(len(x), np.int64), x[order], size, x[tree.centre], tree.parent,
                     tree.radius, leaves, np.append(edge, len(x)))
    seen, exact = [], HN.scores
    HN.scores = lambda a, b: seen.append(len(a)) or exact(a, b)
    try:
        asked = HN._for_positives(np.array([-1]), np.array([0]), x[:1], np.array([np.nan]))
        _, score, _ = HN.descended(block, asked, 5)
    finally:
        HN.scores = exact
    assert score.tolist() == sorted(exact(x, x[:1])[0], reverse=True)[:5] and sum(seen) < len(x) / 2


def test_large_components_stay_exact():
    a = np.array([[2.0 ** 40, 3.0], [-1.0, 2.0 ** 20]])
    assert HN.scores(a, np.array([[2.0 ** 20, 1.0]])).tolist() == [[2 ** 60 + 3, 0]]
    with pytest.raises(OverflowError):
        HN.scores(a, np.array([[2.0 ** 40, 1.0]]))


# --- centroid clustering ------------------------------------------------------

def clusters_brute(rows, k, rounds, dims):
    kept = [(i, v) for i, v, _ in usable(rows, dims)]
    name = lambda i: hashlib.sha256(("2:" + ("" if i is None else str(i))).encode()).hexdigest()
    centroids = [v for _, v in sorted((name(i), v) for i, v in kept)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = [nearest(v) for _, v in kept]
    d = [far(v, centroids[o]) for (_, v), o in zip(kept, own)]
    return sorted(((i, o, x, sum(y for y, p in zip(d, own) if p == o), sum(d),
                    hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest())
                   for (i, _), o, x in zip(kept, own, d)), key=repr)


@pytest.mark.parametrize("k,rounds", [(40, 5), (7, 9), (1, 2), (1000, 1)])
def test_clusters_equal_lloyd(spark, k, rounds):
    rows = vectors(240) + [(900, [1.0], 1), (901, [], 1)]
    df = clashing(spark.createDataFrame(rows, VECTORS)).repartition(3)
    assert rows_of(CC.clustered(df, k, rounds, 6)) == clusters_brute(rows, k, rounds, 6)


def test_clusters_of_nothing(spark):
    out = CC.clustered(spark.createDataFrame([(1, [1.0], 1), (2, None, 1)], VECTORS))
    assert out.collect() == [] and out.columns[-1] == "centroid_sha256"


def test_bounds_save_scans(spark):
    df = spark.createDataFrame(vectors(600), VECTORS)
    shares = [s.agg(F.avg("scanned")).first()[0] for s, _ in CC.cluster_states(df, 12, 6, 6)]
    assert shares[0] == 1.0 and shares[-1] < 0.5


def test_drift_bound_holds_and_is_tight():
    rng = np.random.default_rng(6)
    for dims in (2, 3, 64):
        centre, old = rng.normal(size=(8, dims)) * 3, rng.normal(size=(8, dims)) * 3
        new = old + rng.normal(size=(8, dims)) * rng.choice([0.1, 1.0, 4.0], (8, 1))
        radius = rng.uniform(0, 2, 8)
        bound = CC.nearer_by(centre, radius, old, new)
        full = np.linalg.norm(new - old, axis=1)
        way = rng.normal(size=(4000, dims))
        way /= np.linalg.norm(way, axis=1)[:, None]
        for i in range(8):
            x = centre[i] + radius[i] * way * rng.uniform(0, 1, (4000, 1)) ** (1 / dims)
            x = np.concatenate([x, centre[i] + radius[i] * way])
            for j in range(8):
                got = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert got.max() <= bound[i, j] <= full[j] + 1e-5
        assert bound.mean() < full.mean()


def test_distances_stay_exact():
    a, b = np.array([[2 ** 30, -5]]), np.array([[-2 ** 30 + 1, 7]])
    want = (2 ** 31 - 1) ** 2 + 144
    assert CC.squared_distances(a, b).tolist() == [[want]] and CC.own_distances(a, b).tolist() == [want]
