"""Operators of panelscope.llm against plain Python on small tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelscope.llm import (bpe, context_mixing, exact_dedup, grouped_suffixes, near_dedup, packing,
                            quality_model, quality_rules, sharding, stages, suffix_dedup, toxicity)
from panelscope.llm.batches import Powers, text_slices, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fold(text):
    return (text or "").encode().translate(LOWER)


def prose(rng, n, vocabulary=400):
    words = [f"w{int(x)}" for x in rng.integers(0, vocabulary, n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def corpus():
    """Nulls, empty and very long texts, exact and near copies, shared
    passages, ties and repeated rows."""
    rng = np.random.default_rng(5)
    base, passage = prose(rng, 120, 10**6), prose(rng, 60, 10**6)
    near = base.split(" ")
    texts = [None, "", " \t\n", "one", "two words", "a b c d", base, base.upper(), base, "é" * 300,
             "x" * 1000, prose(rng, 30_000), passage, "Zażółć gęślą jaźń <|endoftext|> 漢字 😀\r\n\x0b a  b"]
    for k in range(6):
        words = list(near)
        words[10 * k + 3] = f"edit{k}"
        texts.append(" ".join(words))
    for k in range(6):
        texts.append(prose(rng, 40 + k, 10**6) + "\n" + passage + "\n" + prose(rng, 30, 10**6))
    texts += [prose(rng, int(n)) for n in rng.integers(1, 200, 40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[20], (None, "no id at all")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """The same table with columns that have the operators' own names."""
    out = docs
    for name in ("shard", "slot", "kept", "score", "bucket", "k", "n", "spans", "fp_a", "raw_key", "cls",
                 "dealt_", "row_key", "ids", "comp", "band", "size"):
        out = out.withColumn(name, F.lit("taken"))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- sharding ---------------------------------------------------------------

def test_sharding_places_every_row_once(docs):
    for shards, part in ((8, 50_000), (3, 7)):
        rows = docs.select("doc_id", F.lit(1).alias("size"))
        out = sharding.shard_rows(rows, ["doc_id"], shards, rows_per_part=part).collect()
        by = collections.defaultdict(list)
        for r in out:
            by[r["shard"]].append(r["slot"])
        assert len(out) == len(corpus()) and set(by) == set(range(shards))
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_columns_and_reproducibility(docs):
    a, b = rows_of(sharding.shard_documents(docs)), rows_of(sharding.shard_documents(clashing(docs).repartition(5)))
    assert a == b
    text = dict((i, t) for i, t in corpus())
    for doc_id, size, crc, law, *_ in a:
        raw = (text[doc_id] or "").encode()
        assert (size, crc, law) == (len(raw) + 1, zlib.crc32(raw), "rows")
    assert a != rows_of(sharding.shard_documents(docs, seed=2))


def test_feistel_walk_is_a_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7)).collect()]
        assert sorted(got) == list(range(n))


# --- exact dedup ------------------------------------------------------------

@pytest.mark.parametrize("primes,chunk", [(exact_dedup.PRIMES, 1 << 16), (exact_dedup.PRIMES, 16),
                                          ((2, 2, 2, 2), 16)])  # the last: fingerprints collide all the time
def test_exact_groups(docs, primes, chunk):
    got = exact_dedup.exact_groups(docs, chunk, primes).collect()
    groups = collections.defaultdict(list)
    for i, t in corpus():
        groups[fold(t)].append(i)
    sha = {hashlib.sha256(t).hexdigest(): t for t in groups}
    assert len(got) == len(corpus())
    for r in got:
        ids = groups[sha[r["text_sha256"]]]
        known = [i for i in ids if i is not None]
        assert r["doc_id"] in ids and r["group_size"] == len(ids)
        assert r["keep_id"] == (max(known) if known else None)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_chunk_hashes_combine(spark):
    raw = bytes(range(256)) * 3
    for chunk in (1, 7, 100, 10_000):
        powers = exact_dedup.chunk_powers(chunk, exact_dedup.PRIMES)
        doc, start, end = exact_dedup.chunk_bounds(np.array([0, len(raw)]), chunk)
        h = exact_dedup.hash_chunks(np.frombuffer(raw, np.uint8), start, end, powers, exact_dedup.PRIMES)
        got = exact_dedup.combine(doc, end - start, h, 1, powers, exact_dedup.PRIMES)
        for g, p, r in zip(got, exact_dedup.PRIMES, exact_dedup.BASES):
            want = 0
            for b in raw:
                want = (want * r + b + 1) % p
            assert int(g[0]) == want


def test_copies_go_and_columns_stay(docs, empty):
    out = exact_dedup.without_copies(clashing(docs))
    assert out.columns == clashing(docs).columns
    assert out.count() == len({fold(t) for _, t in corpus()})
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.without_copies(empty).count() == 0


# --- packing ----------------------------------------------------------------

def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        widths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        rows = [rng.randint(1, 20) for _ in widths]
        k = rng.randint(1, 5)

        def cost(ends):
            return sum(c * min(e for e in ends if e >= w) for w, c in zip(widths, rows))

        import itertools
        best = min(cost((*some, widths[-1])) for j in range(k) for some in itertools.combinations(widths[:-1], j))
        got = packing.best_boundaries(widths, rows, k)
        assert got == sorted(got) and len(got) <= k and cost(got) == best


def test_packing(docs, empty):
    rows = docs.select("doc_id", packing.word_count(F.col("text")).alias("n"))
    got = packing.pack(rows, "n", ["doc_id"], n_buckets=4, budget=300, rows_per_part=5).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n"]) for r in got if r["doc_id"] is not None) == sorted(
        (False, i, len(fold(t).split())) for i, t in corpus() if i is not None)
    batches = collections.defaultdict(list)
    for r in got:
        assert r["n"] <= r["width"]
        batches[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), members in batches.items():
        width = members[0]["width"]
        assert len(members) * width <= 300 or len(members) == 1
        assert sorted(m["slot"] for m in members) == list(range(len(members)))
        if (bucket, batch + 1) in batches:
            assert len(members) == max(1, 300 // width)
    assert packing.pack_documents(empty).count() == 0
    assert packing.pack_documents(clashing(docs)).count() == len(corpus())


# --- near dedup -------------------------------------------------------------

def near_brute(rows):
    sets = {}
    for i, t in rows:
        w = fold(t).split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else \
            frozenset([tuple(w)] if w else [])
    ids = sorted(i for i in sets if i is not None)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and comp[b] < comp[a]:
                    comp[a] = comp[b]
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in ids}


def test_near_groups(docs, empty):
    want = near_brute(corpus())
    for table in (docs, clashing(docs)):
        got = near_dedup.near_groups(table).collect()
        assert len(got) == len(corpus())
        for r in got:
            if r["doc_id"] is not None:
                assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
                assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_groups(empty).count() == 0


def test_near_chain_of_edits(spark):
    """Each text links only with its neighbours: pivots alone can't find all."""
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words = list(words)
        words[int(rng.integers(0, 200))] = f"edit{i}"
        words[int(rng.integers(0, 200))] = f"other{i}"
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = near_brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < 5


def test_near_stage_links_from_eighty_percent(spark, tmp_path):
    """500-word texts and copies with 8 to 16 scattered words changed: similarities
    from about 0.73 to 0.86. The stage keeps what a brute force at 80 % keeps."""
    rng = np.random.default_rng(12)
    rows, similar = [], {}
    for k in range(36):
        words = [f"t{k}w{i}" for i in range(500)]
        copy = list(words)
        places = np.arange(8 + k % 9) * 30 + 6 + rng.integers(0, 20)
        for p in places:
            copy[p] = f"edit{k}at{p}"
        a, b = ({tuple(w[i:i + 5]) for i in range(496)} for w in (words, copy))
        similar[k] = 100 * len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in stages.near_dedup(spark, table, str(tmp_path)).collect()}
    assert kept == {2 * k for k in similar} | {2 * k + 1 for k, j in similar.items() if j < 80}
    thin = {r["doc_id"] for r in near_dedup.near_groups(table).filter("kept").collect()}
    assert thin == {2 * k for k in similar} | {2 * k + 1 for k, j in similar.items() if j < 85}
    assert sum(80 <= j < 85 for j in similar.values()) >= 8 and min(similar.values()) < 80


def test_corrected_estimate():
    rng = np.random.default_rng(2)
    errors = []
    for n, shared in ((5000, 0), (5000, 2500), (3000, 2700), (400, 380)):
        both = rng.integers(0, 2**64, shared, dtype=np.uint64)
        sides = []
        for _ in range(2):
            h = np.sort(np.concatenate([both, rng.integers(0, 2**64, n - shared, dtype=np.uint64)]))
            sides.append(near_dedup.registers(h, np.array([0, n]))[0])
        j, error = near_dedup.estimated(*sides, np.array([n]), np.array([n]), near_dedup.collision_rates())
        errors.append(abs(j[0] - shared / (2 * n - shared)) / max(error[0], 0.04))
    assert max(errors) < 4


# --- suffixes ---------------------------------------------------------------

def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(500):
        x = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)), 0)
        t = x.tolist()
        assert grouped_suffixes.suffix_array(x).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def passages_brute(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(r[i:i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for (i, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - 199):
            if seen[r[k:k + 200]] > 1:
                gone[k:k + 200] = True
        runs = int((gone[1:] > gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((i, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bin_contexts", [512, 2])
def test_repeated_passages(docs, bin_contexts):
    assert rows_of(suffix_dedup.without_repeats(docs, bin_contexts)) == passages_brute(corpus())


def test_passages_in_large_bins(spark):
    """A passage just under and just over the length, in texts that differ around it."""
    rng = np.random.default_rng(9)
    letters = np.frombuffer(b"abcdefgh ", np.uint8)
    some = lambda n: rng.choice(letters, n).tobytes().decode()
    core, wide = some(190), some(230)
    rows = [(i, some(150) + (core if i % 2 else wide) + some(140)) for i in range(24)]
    rows += [(100 + i, some(30) + core[:180] + "ab"[i % 2] * 20 + some(30)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (512, 3):
        assert rows_of(suffix_dedup.without_repeats(df, limit)) == passages_brute(rows)


def test_rewritten_texts(docs, empty):
    out = suffix_dedup.rewritten(clashing(docs))
    assert out.columns == clashing(docs).columns and out.count() == len(corpus())
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert suffix_dedup.without_repeats(empty).count() == 0 and suffix_dedup.rewritten(empty).count() == 0


# --- quality rules ----------------------------------------------------------

def rules_brute(t):
    t = t or ""
    words = t.encode().split()
    seen, dup, lost = set(), 0, 0
    for line in t.split("\n"):
        lw = [w.decode() for w in line.encode().split()]
        if not lw:
            continue
        dup += line in seen
        seen.add(line)
        n, low = len(lw), fold(line).decode()
        sep = sum(w in quality_rules.SEPARATORS for w in lw)
        bad = not any(w.endswith(quality_rules.TERMINAL) for w in lw) or (sep >= 3 and 10 * sep >= n) \
            or 100 * sum(any(c in quality_rules.SYMBOLS for c in w) for w in lw) > 30 * n \
            or 100 * sum(w.endswith("!!") for w in lw) > 30 * n or any(b in low for b in quality_rules.BOILERPLATE)
        lost += n * bad
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(len(w.decode()) for w in words), sum(c in quality_rules.SYMBOLS for c in t), dup, len(hit),
            lost, failed, not failed and 100 * lost <= 50 * len(words))


def test_quality_rules_on_random_lines():
    rng = random.Random(1)
    bits = ["a", "b", "!!", ".", "\n", "\n", " ", "|", " | ", "Read More", "é", "…", "\t", "\r", "#", ""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + [None, "", "\n"]
    keys = (*quality_rules.COLUMNS, "n_lost_words", "base_failed", "kept")
    got, powers = [], Powers()
    for t in text_slices(pa.array(texts), 4000):
        found = quality_rules.judge(t, powers)
        got += zip(*[found[k].tolist() for k in keys])
    assert got == [rules_brute(t) for t in texts]


def test_quality_rules(docs, empty):
    rng = np.random.default_rng(1)
    good = "\n".join(prose(rng, 20, 10**6) + "." for _ in range(5))
    junk = good + "\n" + " | ".join(f"menu{i}" for i in range(300))
    extra = docs.sparkSession.createDataFrame([(900, good), (901, junk)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality_rules.cleaned(docs.select("doc_id", "text").unionByName(extra)).collect()}
    assert out[900]["kept"] and out[900]["clean_text"] == good
    assert not out[901]["kept"] and out[901]["clean_text"] == good + "\n"
    want = {i: rules_brute(t) for i, t in corpus()}
    for i, w in want.items():
        assert tuple(out[i][k] for k in (*quality_rules.COLUMNS, "n_lost_words", "base_failed", "kept")) == w
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.quality_rules(clashing(docs)).count() == len(corpus())


# --- classifiers ------------------------------------------------------------

def labelled(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        toxic, bad = int(rng.random() < 0.3), int(rng.random() < 0.3)
        words = [f"w{int(x)}" for x in rng.integers(0, 300, 60)]
        if toxic:
            words[int(rng.integers(0, 60))] = str(rng.choice(["vileword", "meanword", "stemabc", "stemxyz"]))
        if bad:
            words = [w + "%%%" if rng.random() < 0.6 else w for w in words]
        rows.append((i, " ".join(w + ("." if k % 8 == 7 else "") for k, w in enumerate(words))))
        labels.append((i, 1 - bad, toxic))
    labels += [labels[0], (5000, 1, 1), (None, 1, 1), (7, None, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, (q, t)) for a, q, t in labels if q is not None))


def test_toxicity_on_held_out_rows(spark, docs, empty):
    table, labels, truth = labelled(spark)
    got = toxicity.toxicity(table, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held]) > 0.9
    text = {r["doc_id"]: r["text"] for r in table.collect()}
    spans = [(text[r["doc_id"]].encode()[s["start"]:s["end"]], r) for r in held if r["predicted"] for s in r["offending"]]
    assert spans and np.mean([any(w in s for w in (b"vile", b"mean", b"stem")) for s, _ in spans]) > 0.8
    odd = toxicity.toxicity(clashing(docs), labels).collect()
    assert len(odd) == len(corpus()) and all(0 <= r["score"] <= 1 for r in odd)
    assert [r["score"] for r in odd if r["doc_id"] in (0, 1, 2)] == [0.0] * 3
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(table, labels.limit(0)).filter("predicted = 1").count() == 0
    kept = toxicity.clean_rows(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns


def test_noisy_or():
    p = toxicity.noisy_or(np.log([0.25, 1.0, 1 / 3]), np.array([0, 0, 2]), 3)
    assert np.allclose(p, [1 - 0.8 * 0.5, 0.0, 0.25])


def test_quality_on_held_out_rows(spark, docs, empty):
    table, labels, truth = labelled(spark)
    got = quality_model.quality(table, labels).collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in got if r["held_out"]]) > 0.95
    odd = quality_model.quality(clashing(docs), labels).collect()
    assert len(odd) == len(corpus()) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_model.quality(empty, labels).count() == 0
    assert quality_model.quality(table, labels.limit(0)).count() == 600


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    rows = next(iter(text_slices(pa.array(["a b c a", "", "d"]))))
    rows = quality_model.rows_of(rows, Powers())
    m = quality_model.Model(0.3, rng.normal(size=quality_model.SIZE), rng.normal(size=(quality_model.SIZE, quality_model.RANK)))
    z, _, _ = quality_model.logits(rows, m)
    for k in range(3):
        i = rows.index[rows.off[k]:rows.off[k + 1]]
        x = rows.weight[rows.off[k]:rows.off[k + 1]]
        want = 0.3 + (m.linear[i] * x).sum() + sum(
            m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert math.isclose(z[k], want, rel_tol=1e-9)


# --- language model ---------------------------------------------------------

def test_lm_base_and_score(docs, empty):
    rows = corpus()
    counts, tokens = collections.Counter(), []
    for i, t in rows:
        w = [*fold(t).split(), None]
        tokens.append((i, w))
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted([(i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(
        math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens], key=repr)
    for table in (docs, clashing(docs)):
        got = context_mixing.scored(table).collect()
        assert sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                       for r in got], key=repr) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    same = collections.defaultdict(set)
    for r in got:
        same[r["doc_id"]].add(r["score"])
    assert len(same[6]) == 1 and same[6] == same[8]
    assert context_mixing.scored(empty).count() == 0


def test_lm_reaches_over_a_whole_word(spark):
    """Each first word, of an ending common to all, fixes the second: without
    the word before, the 1,000 pairs cost 20 bits or more each, 1.1 a byte."""
    rng = np.random.default_rng(21)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    word = lambda: rng.choice(letters, 6).tobytes().decode()
    pairs = [f"{word()}tion {word()}" for _ in range(1000)]
    rows = [(i, " ".join(pairs[int(k)] for k in rng.integers(0, 1000, 40))) for i in range(600)]
    got = context_mixing.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and np.mean([r["bits_per_byte"] for r in held]) < 1.0


def test_lm_probabilities_sum_to_one(monkeypatch):
    """The mixed model is a distribution: over all next bytes it sums to 1."""
    texts = pa.array(["the cat sat on the mat", "the dog sat", "a cat"] * 5)
    powers, counts = Powers(), [np.zeros((1 << b, 256)) for b in context_mixing.CONTEXT_BITS]
    for t in text_slices(texts):
        s = context_mixing.stream_of(t, powers)
        for c, slot in zip(counts, s.slots):
            np.add.at(c, (slot, s.data), 1)
    tree = context_mixing.huffman(counts[0].sum(axis=0))
    model = context_mixing.Model(tree, [context_mixing.node_odds(c, tree).reshape(-1) for c in counts])
    s = context_mixing.stream_of(next(iter(text_slices(pa.array(["the cat s"])))), powers)
    total = 0.0
    for byte in range(256):
        last = len(s.data) - 1
        other = context_mixing.Stream(np.append(s.data[:last], np.uint8(byte)), s.doc, s.off, s.slots, s.word_doc, s.word_hash)
        total += math.exp(-context_mixing.coding_nats(other, model)[0])
    prefix = context_mixing.Stream(s.data[:-1], s.doc[:-1], s.off - [0, 1], [x[:-1] for x in s.slots], s.word_doc, s.word_hash)
    assert math.isclose(total, math.exp(-context_mixing.coding_nats(prefix, model)[0]), rel_tol=1e-4)


def test_lm_odds_reach_each_bucket_once(monkeypatch):
    """Entries of two buckets: a context's bytes are counted over both, one answer an
    entry, without keys; the left-out bucket's counts are missing in its second answer."""
    monkeypatch.setattr(context_mixing, "SLICE", 40)
    texts = [["the cat sat on the mat", "", "thermos thermal a b"], ["the cat ran", "\x01 a\x01b\x1cc", "the mat"]]
    buckets = [context_mixing.bucket_of(pa.table({"text": t, "trained": [True] * len(t)})) for t in texts]
    tree = context_mixing.huffman(np.bincount(np.frombuffer("".join(map("".join, texts)).encode(), np.uint8), minlength=256))
    n_ranges, left_out = 3, np.array([False, True])
    sent = [dict(context_mixing.entries_in(b.entries, n_ranges)) for b in buckets]
    answers = {}
    for r in range(n_ranges):
        mine = [k for k in range(2) if r in sent[k]]
        odds, left, *_ = context_mixing.answered([context_mixing.entries_of(sent[k][r]) for k in mine], left_out[mine], tree)
        answers |= {(k, r): (o, x) for k, o, x in zip(mine, odds, left)}

    def words(of, at):  # context, byte: the word so far, and that with the word before
        out, counts = [], collections.Counter()
        for k, group in enumerate(of):
            for t in group:
                tokens = [w + b" " for w in t.encode().split()] + [b"\n"]
                for i, w in enumerate(tokens):
                    for d in range(len(w)):
                        cell = ((tokens[i - 1] if i else b"") * at, w[:d]), w[d]
                        out.append((k, cell))
                        counts[k, cell] += 1
        return out, counts

    for at, path in ((0, 1), (1, 2)):
        cells, counts = words(texts, at)
        for without in (False, True):
            for k, b in enumerate(buckets):
                if without and not left_out[k]:
                    continue
                ranges = [r for r in range(n_ranges) if (k, r) in answers]
                _, flat = context_mixing.flat_odds([answers[k, r][without] for r in ranges], b, tree, n_ranges, ranges, not without)
                got = []
                for s in context_mixing.with_paths(b, flat, tree):
                    pos, odds = s.paths[path]
                    got += [odds[p:p + tree.length[c]].tolist() for p, c in zip(pos, s.data)]
                total = collections.Counter()
                for (j, cell), n in counts.items():
                    if not (without and left_out[j]):
                        total[cell] += n
                want = []
                for context, byte in (cell for j, cell in cells if j == k):
                    row = []
                    for d in range(tree.length[byte]):
                        side = [0.0, 0.0]
                        for (c, other), n in total.items():
                            at_node = [e for e in range(tree.length[other]) if tree.nodes[other, e] == tree.nodes[byte, d]]
                            if c == context and at_node:
                                side[int(tree.bits[other, at_node[0]] == tree.bits[byte, d])] += n
                        row.append(int(np.clip(np.rint(12 * np.log((side[1] + 0.1) / (side[0] + 0.1))), -127, 127)))
                    want.append(row)
                assert got == want


def test_lm_sends_few_bytes_a_token():
    """Entries of a bucket, all kinds together: under 15 bytes for each word."""
    rng = np.random.default_rng(5)
    base, passage = prose(rng, 120, 10**6), prose(rng, 60, 10**6)
    near = base.split(" ")
    texts = [None, "", " \t\n", "one", "two words", "a b c d", base, base.upper(), base, "é" * 300,
             "x" * 1000, prose(rng, 30_000), passage, "Zażółć gęślą jaźń <|endoftext|> 漢字 😀\r\n\x0b a  b"]
    for k in range(6):
        words = list(near)
        words[10 * k + 3] = f"edit{k}"
        texts.append(" ".join(words))
    for k in range(6):
        texts.append(prose(rng, 40 + k, 10**6) + "\n" + passage + "\n" + prose(rng, 30, 10**6))
    texts += [prose(rng, int(n)) for n in rng.integers(1, 200, 40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[20], (None, "no id at all")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """The same table with columns that have the operators' own names."""
    out = docs
    for name in ("shard", "slot", "kept", "score", "bucket", "k", "n", "spans", "fp_a", "raw_key", "cls",
                 "dealt_", "row_key", "ids", "comp", "band", "size"):
        out = out.withColumn(name, F.lit("taken"))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- sharding ---------------------------------------------------------------

def test_sharding_places_every_row_once(docs):
    for shards, part in ((8, 50_000), (3, 7)):
        rows = docs.select("doc_id", F.lit(1).alias("size"))
        out = sharding.shard_rows(rows, ["doc_id"], shards, rows_per_part=part).collect()
        by = collections.defaultdict(list)
        for r in out:
            by[r["shard"]].append(r["slot"])
        assert len(out) == len(corpus()) and set(by) == set(range(shards))
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_columns_and_reproducibility(docs):
    a, b = rows_of(sharding.shard_documents(docs)), rows_of(sharding.shard_documents(clashing(docs).repartition(5)))
    assert a == b
    text = dict((i, t) for i, t in corpus())
    for doc_id, size, crc, law, *_ in a:
        raw = (text[doc_id] or "").encode()
        assert (size, crc, law) == (len(raw) + 1, zlib.crc32(raw), "rows")
    assert a != rows_of(sharding.shard_documents(docs, seed=2))


def test_feistel_walk_is_a_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7)).collect()]
        assert sorted(got) == list(range(n))


# --- exact dedup ------------------------------------------------------------

@pytest.mark.parametrize("primes,chunk", [(exact_dedup.PRIMES, 1 << 16), (exact_dedup.PRIMES, 16),
                                          ((2, 2, 2, 2), 16)])  # the last: fingerprints collide all the time
def test_exact_groups(docs, primes, chunk):
    got = exact_dedup.exact_groups(docs, chunk, primes).collect()
    groups = collections.defaultdict(list)
    for i, t in corpus():
        groups[fold(t)].append(i)
    sha = {hashlib.sha256(t).hexdigest(): t for t in groups}
    assert len(got) == len(corpus())
    for r in got:
        ids = groups[sha[r["text_sha256"]]]
        known = [i for i in ids if i is not None]
        assert r["doc_id"] in ids and r["group_size"] == len(ids)
        assert r["keep_id"] == (max(known) if known else None)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_chunk_hashes_combine(spark):
    raw = bytes(range(256)) * 3
    for chunk in (1, 7, 100, 10_000):
        powers = exact_dedup.chunk_powers(chunk, exact_dedup.PRIMES)
        doc, start, end = exact_dedup.chunk_bounds(np.array([0, len(raw)]), chunk)
        h = exact_dedup.hash_chunks(np.frombuffer(raw, np.uint8), start, end, powers, exact_dedup.PRIMES)
        got = exact_dedup.combine(doc, end - start, h, 1, powers, exact_dedup.PRIMES)
        for g, p, r in zip(got, exact_dedup.PRIMES, exact_dedup.BASES):
            want = 0
            for b in raw:
                want = (want * r + b + 1) % p
            assert int(g[0]) == want


def test_copies_go_and_columns_stay(docs, empty):
    out = exact_dedup.without_copies(clashing(docs))
    assert out.columns == clashing(docs).columns
    assert out.count() == len({fold(t) for _, t in corpus()})
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.without_copies(empty).count() == 0


# --- packing ----------------------------------------------------------------

def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        widths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        rows = [rng.randint(1, 20) for _ in widths]
        k = rng.randint(1, 5)

        def cost(ends):
            return sum(c * min(e for e in ends if e >= w) for w, c in zip(widths, rows))

        import itertools
        best = min(cost((*some, widths[-1])) for j in range(k) for some in itertools.combinations(widths[:-1], j))
        got = packing.best_boundaries(widths, rows, k)
        assert got == sorted(got) and len(got) <= k and cost(got) == best


def test_packing(docs, empty):
    rows = docs.select("doc_id", packing.word_count(F.col("text")).alias("n"))
    got = packing.pack(rows, "n", ["doc_id"], n_buckets=4, budget=300, rows_per_part=5).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n"]) for r in got if r["doc_id"] is not None) == sorted(
        (False, i, len(fold(t).split())) for i, t in corpus() if i is not None)
    batches = collections.defaultdict(list)
    for r in got:
        assert r["n"] <= r["width"]
        batches[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), members in batches.items():
        width = members[0]["width"]
        assert len(members) * width <= 300 or len(members) == 1
        assert sorted(m["slot"] for m in members) == list(range(len(members)))
        if (bucket, batch + 1) in batches:
            assert len(members) == max(1, 300 // width)
    assert packing.pack_documents(empty).count() == 0
    assert packing.pack_documents(clashing(docs)).count() == len(corpus())


# --- near dedup -------------------------------------------------------------

def near_brute(rows):
    sets = {}
    for i, t in rows:
        w = fold(t).split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else \
            frozenset([tuple(w)] if w else [])
    ids = sorted(i for i in sets if i is not None)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and comp[b] < comp[a]:
                    comp[a] = comp[b]
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in ids}


def test_near_groups(docs, empty):
    want = near_brute(corpus())
    for table in (docs, clashing(docs)):
        got = near_dedup.near_groups(table).collect()
        assert len(got) == len(corpus())
        for r in got:
            if r["doc_id"] is not None:
                assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
                assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_groups(empty).count() == 0


def test_near_chain_of_edits(spark):
    """Each text links only with its neighbours: pivots alone can't find all."""
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words = list(words)
        words[int(rng.integers(0, 200))] = f"edit{i}"
        words[int(rng.integers(0, 200))] = f"other{i}"
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = near_brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < 5


def test_near_stage_links_from_eighty_percent(spark, tmp_path):
    """500-word texts and copies with 8 to 16 scattered words changed: similarities
    from about 0.73 to 0.86. The stage keeps what a brute force at 80 % keeps."""
    rng = np.random.default_rng(12)
    rows, similar = [], {}
    for k in range(36):
        words = [f"t{k}w{i}" for i in range(500)]
        copy = list(words)
        places = np.arange(8 + k % 9) * 30 + 6 + rng.integers(0, 20)
        for p in places:
            copy[p] = f"edit{k}at{p}"
        a, b = ({tuple(w[i:i + 5]) for i in range(496)} for w in (words, copy))
        similar[k] = 100 * len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in stages.near_dedup(spark, table, str(tmp_path)).collect()}
    assert kept == {2 * k for k in similar} | {2 * k + 1 for k, j in similar.items() if j < 80}
    thin = {r["doc_id"] for r in near_dedup.near_groups(table).filter("kept").collect()}
    assert thin == {2 * k for k in similar} | {2 * k + 1 for k, j in similar.items() if j < 85}
    assert sum(80 <= j < 85 for j in similar.values()) >= 8 and min(similar.values()) < 80


def test_corrected_estimate():
    rng = np.random.default_rng(2)
    errors = []
    for n, shared in ((5000, 0), (5000, 2500), (3000, 2700), (400, 380)):
        both = rng.integers(0, 2**64, shared, dtype=np.uint64)
        sides = []
        for _ in range(2):
            h = np.sort(np.concatenate([both, rng.integers(0, 2**64, n - shared, dtype=np.uint64)]))
            sides.append(near_dedup.registers(h, np.array([0, n]))[0])
        j, error = near_dedup.estimated(*sides, np.array([n]), np.array([n]), near_dedup.collision_rates())
        errors.append(abs(j[0] - shared / (2 * n - shared)) / max(error[0], 0.04))
    assert max(errors) < 4


# --- suffixes ---------------------------------------------------------------

def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(500):
        x = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)), 0)
        t = x.tolist()
        assert grouped_suffixes.suffix_array(x).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def passages_brute(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(r[i:i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for (i, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - 199):
            if seen[r[k:k + 200]] > 1:
                gone[k:k + 200] = True
        runs = int((gone[1:] > gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((i, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bin_contexts", [512, 2])
def test_repeated_passages(docs, bin_contexts):
    assert rows_of(suffix_dedup.without_repeats(docs, bin_contexts)) == passages_brute(corpus())


def test_passages_in_large_bins(spark):
    """A passage just under and just over the length, in texts that differ around it."""
    rng = np.random.default_rng(9)
    letters = np.frombuffer(b"abcdefgh ", np.uint8)
    some = lambda n: rng.choice(letters, n).tobytes().decode()
    core, wide = some(190), some(230)
    rows = [(i, some(150) + (core if i % 2 else wide) + some(140)) for i in range(24)]
    rows += [(100 + i, some(30) + core[:180] + "ab"[i % 2] * 20 + some(30)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (512, 3):
        assert rows_of(suffix_dedup.without_repeats(df, limit)) == passages_brute(rows)


def test_rewritten_texts(docs, empty):
    out = suffix_dedup.rewritten(clashing(docs))
    assert out.columns == clashing(docs).columns and out.count() == len(corpus())
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert suffix_dedup.without_repeats(empty).count() == 0 and suffix_dedup.rewritten(empty).count() == 0


# --- quality rules ----------------------------------------------------------

def rules_brute(t):
    t = t or ""
    words = t.encode().split()
    seen, dup, lost = set(), 0, 0
    for line in t.split("\n"):
        lw = [w.decode() for w in line.encode().split()]
        if not lw:
            continue
        dup += line in seen
        seen.add(line)
        n, low = len(lw), fold(line).decode()
        sep = sum(w in quality_rules.SEPARATORS for w in lw)
        bad = not any(w.endswith(quality_rules.TERMINAL) for w in lw) or (sep >= 3 and 10 * sep >= n) \
            or 100 * sum(any(c in quality_rules.SYMBOLS for c in w) for w in lw) > 30 * n \
            or 100 * sum(w.endswith("!!") for w in lw) > 30 * n or any(b in low for b in quality_rules.BOILERPLATE)
        lost += n * bad
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(len(w.decode()) for w in words), sum(c in quality_rules.SYMBOLS for c in t), dup, len(hit),
            lost, failed, not failed and 100 * lost <= 50 * len(words))


def test_quality_rules_on_random_lines():
    rng = random.Random(1)
    bits = ["a", "b", "!!", ".", "\n", "\n", " ", "|", " | ", "Read More", "é", "…", "\t", "\r", "#", ""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + [None, "", "\n"]
    keys = (*quality_rules.COLUMNS, "n_lost_words", "base_failed", "kept")
    got, powers = [], Powers()
    for t in text_slices(pa.array(texts), 4000):
        found = quality_rules.judge(t, powers)
        got += zip(*[found[k].tolist() for k in keys])
    assert got == [rules_brute(t) for t in texts]


def test_quality_rules(docs, empty):
    rng = np.random.default_rng(1)
    good = "\n".join(prose(rng, 20, 10**6) + "." for _ in range(5))
    junk = good + "\n" + " | ".join(f"menu{i}" for i in range(300))
    extra = docs.sparkSession.createDataFrame([(900, good), (901, junk)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality_rules.cleaned(docs.select("doc_id", "text").unionByName(extra)).collect()}
    assert out[900]["kept"] and out[900]["clean_text"] == good
    assert not out[901]["kept"] and out[901]["clean_text"] == good + "\n"
    want = {i: rules_brute(t) for i, t in corpus()}
    for i, w in want.items():
        assert tuple(out[i][k] for k in (*quality_rules.COLUMNS, "n_lost_words", "base_failed", "kept")) == w
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.quality_rules(clashing(docs)).count() == len(corpus())


# --- classifiers ------------------------------------------------------------

def labelled(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        toxic, bad = int(rng.random() < 0.3), int(rng.random() < 0.3)
        words = [f"w{int(x)}" for x in rng.integers(0, 300, 60)]
        if toxic:
            words[int(rng.integers(0, 60))] = str(rng.choice(["vileword", "meanword", "stemabc", "stemxyz"]))
        if bad:
            words = [w + "%%%" if rng.random() < 0.6 else w for w in words]
        rows.append((i, " ".join(w + ("." if k % 8 == 7 else "") for k, w in enumerate(words))))
        labels.append((i, 1 - bad, toxic))
    labels += [labels[0], (5000, 1, 1), (None, 1, 1), (7, None, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, (q, t)) for a, q, t in labels if q is not None))


def test_toxicity_on_held_out_rows(spark, docs, empty):
    table, labels, truth = labelled(spark)
    got = toxicity.toxicity(table, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held]) > 0.9
    text = {r["doc_id"]: r["text"] for r in table.collect()}
    spans = [(text[r["doc_id"]].encode()[s["start"]:s["end"]], r) for r in held if r["predicted"] for s in r["offending"]]
    assert spans and np.mean([any(w in s for w in (b"vile", b"mean", b"stem")) for s, _ in spans]) > 0.8
    odd = toxicity.toxicity(clashing(docs), labels).collect()
    assert len(odd) == len(corpus()) and all(0 <= r["score"] <= 1 for r in odd)
    assert [r["score"] for r in odd if r["doc_id"] in (0, 1, 2)] == [0.0] * 3
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(table, labels.limit(0)).filter("predicted = 1").count() == 0
    kept = toxicity.clean_rows(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns


def test_noisy_or():
    p = toxicity.noisy_or(np.log([0.25, 1.0, 1 / 3]), np.array([0, 0, 2]), 3)
    assert np.allclose(p, [1 - 0.8 * 0.5, 0.0, 0.25])


def test_quality_on_held_out_rows(spark, docs, empty):
    table, labels, truth = labelled(spark)
    got = quality_model.quality(table, labels).collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in got if r["held_out"]]) > 0.95
    odd = quality_model.quality(clashing(docs), labels).collect()
    assert len(odd) == len(corpus()) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_model.quality(empty, labels).count() == 0
    assert quality_model.quality(table, labels.limit(0)).count() == 600


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    rows = next(iter(text_slices(pa.array(["a b c a", "", "d"]))))
    rows = quality_model.rows_of(rows, Powers())
    m = quality_model.Model(0.3, rng.normal(size=quality_model.SIZE), rng.normal(size=(quality_model.SIZE, quality_model.RANK)))
    z, _, _ = quality_model.logits(rows, m)
    for k in range(3):
        i = rows.index[rows.off[k]:rows.off[k + 1]]
        x = rows.weight[rows.off[k]:rows.off[k + 1]]
        want = 0.3 + (m.linear[i] * x).sum() + sum(
            m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert math.isclose(z[k], want, rel_tol=1e-9)


# --- language model ---------------------------------------------------------

def test_lm_base_and_score(docs, empty):
    rows = corpus()
    counts, tokens = collections.Counter(), []
    for i, t in rows:
        w = [*fold(t).split(), None]
        tokens.append((i, w))
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted([(i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(
        math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens], key=repr)
    for table in (docs, clashing(docs)):
        got = context_mixing.scored(table).collect()
        assert sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                       for r in got], key=repr) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    same = collections.defaultdict(set)
    for r in got:
        same[r["doc_id"]].add(r["score"])
    assert len(same[6]) == 1 and same[6] == same[8]
    assert context_mixing.scored(empty).count() == 0


def test_lm_reaches_over_a_whole_word(spark):
    """Each first word, of an ending common to all, fixes the second: without
    the word before, the 1,000 pairs cost 20 bits or more each, 1.1 a byte."""
    rng = np.random.default_rng(21)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    word = lambda: rng.choice(letters, 6).tobytes().decode()
    pairs = [f"{word()}tion {word()}" for _ in range(1000)]
    rows = [(i, " ".join(pairs[int(k)] for k in rng.integers(0, 1000, 40))) for i in range(600)]
    got = context_mixing.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and np.mean([r["bits_per_byte"] for r in held]) < 1.0


def test_lm_probabilities_sum_to_one(monkeypatch):
    """The mixed model is a distribution: over all next bytes it sums to 1."""
    texts = pa.array(["the cat sat on the mat", "the dog sat", "a cat"] * 5)
    powers, counts = Powers(), [np.zeros((1 << b, 256)) for b in context_mixing.CONTEXT_BITS]
    for t in text_slices(texts):
        s = context_mixing.stream_of(t, powers)
        for c, slot in zip(counts, s.slots):
            np.add.at(c, (slot, s.data), 1)
    tree = context_mixing.huffman(counts[0].sum(axis=0))
    model = context_mixing.Model(tree, [context_mixing.node_odds(c, tree).reshape(-1) for c in counts])
    s = context_mixing.stream_of(next(iter(text_slices(pa.array(["the cat s"])))), powers)
    total = 0.0
    for byte in range(256):
        last = len(s.data) - 1
        other = context_mixing.Stream(np.append(s.data[:last], np.uint8(byte)), s.doc, s.off, s.slots, s.word_doc, s.word_hash)
        total += math.exp(-context_mixing.coding_nats(other, model)[0])
    prefix = context_mixing.Stream(s.data[:-1], s.doc[:-1], s.off - [0, 1], [x[:-1] for x in s.slots], s.word_doc, s.word_hash)
    assert math.isclose(total, math.exp(-context_mixing.coding_nats(prefix, model)[0]), rel_tol=1e-4)


def test_lm_odds_reach_each_bucket_once(monkeypatch):
    """Entries of two buckets: a context's bytes are counted over both, one answer an
    entry, without keys; the left-out bucket's counts are missing in its second answer."""
    monkeypatch.setattr(context_mixing, "SLICE", 40)
    texts = [["the cat sat on the mat", "", "thermos thermal a b"], ["the cat ran", "\x01 a\x01b\x1cc", "the mat"]]
    buckets = [context_mixing.bucket_of(pa.table({"text": t, "trained": [True] * len(t)})) for t in texts]
    tree = context_mixing.huffman(np.bincount(np.frombuffer("".join(map("".join, texts)).encode(), np.uint8), minlength=256))
    n_ranges, left_out = 3, np.array([False, True])
    sent = [dict(context_mixing.entries_in(b.entries, n_ranges)) for b in buckets]
    answers = {}
    for r in range(n_ranges):
        mine = [k for k in range(2) if r in sent[k]]
        odds, left, *_ = context_mixing.answered([context_mixing.entries_of(sent[k][r]) for k in mine], left_out[mine], tree)
        answers |= {(k, r): (o, x) for k, o, x in zip(mine, odds, left)}

    def words(of, at):  # context, byte: the word so far, and that with the word before
        out, counts = [], collections.Counter()
        for k, group in enumerate(of):
            for t in group:
                tokens = [w + b" " for w in t.encode().split()] + [b"\n"]
                for i, w in enumerate(tokens):
                    for d in range(len(w)):
                        cell = ((tokens[i - 1] if i else b"") * at, w[:d]), w[d]
                        out.append((k, cell))
                        counts[k, cell] += 1
        return out, counts

    for at, path in ((0, 1), (1, 2)):
        cells, counts = words(texts, at)
        for without in (False, True):
            for k, b in enumerate(buckets):
                if without and not left_out[k]:
                    continue
                ranges = [r for r in range(n_ranges) if (k, r) in answers]
                _, flat = context_mixing.flat_odds([answers[k, r][without] for r in ranges], b, tree, n_ranges, ranges, not without)
                got = []
                for s in context_mixing.with_paths(b, flat, tree):
                    pos, odds = s.paths[path]
                    got += [odds[p:p + tree.length[c]].tolist() for p, c in zip(pos, s.data)]
                total = collections.Counter()
                for (j, cell), n in counts.items():
                    if not (without and left_out[j]):
                        total[cell] += n
                want = []
                for context, byte in (cell for j, cell in cells if j == k):
                    row = []
                    for d in range(tree.length[byte]):
                        side = [0.0, 0.0]
                        for (c, other), n in total.items():
                            at_node = [e for e in range(tree.length[other]) if tree.nodes[other, e] == tree.nodes[byte, d]]
                            if c == context and at_node:
                                side[int(tree.bits[other, at_node[0]] == tree.bits[byte, d])] += n
                        row.append(int(np.clip(np.rint(12 * np.log((side[1] + 0.1) / (side[0] + 0.1))), -127, 127)))
                    want.append(row)
                assert got == want


def test_lm_sends_few_bytes_a_token():
    """Entries of a bucket: under 15 bytes for each word (a cell of
    each of their bytes in Spark's rows took over 100)."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(500)]
    b = context_mixing.bucket_of(pa.table({"text": texts, "trained": [True] * 500}))
    sent = sum(len(x) for _, x in context_mixing.entries_in(b.entries, 4))
    assert sent < 15 * 400 * 500


def test_lm_words_of_control_characters(spark):
    """Bytes below a space are parts of words (a word of these alone failed the job)."""
    rows = [(i, "a\x01b \x02 \x1cc d") for i in range(30)]
    got = context_mixing.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 30 and all(r["n_tokens"] == 5 and r["n_known"] == 5 for r in got)


# --- BPE --------------------------------------------------------------------

def test_bpe_round_trip(docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = []
    for i, text in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(bpe.round_trip(clashing(docs), path)) == sorted(want, key=repr)
    assert bpe.round_trip(empty, path).count() == 0


def test_bpe_on_odd_texts():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), bpe.Encoder(bpe.load(path), memo_units=500)
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "à", "a", "the", "s",
            "'", "'s", "'ll", "1", "23", "!", "<|endoftext|>", "<|endo", "é", "漢", "😀", "́", "²", "\x00", "it's"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["a" * 3000, "ab" * 500]
    for x in texts:
        assert np.frombuffer(e.encode(x), np.int32).tolist() == t.encode(x, add_special_tokens=False).ids


# --- helpers and pipeline ---------------------------------------------------

def test_words_of_slices():
    texts = [t for _, t in corpus()]
    for size in (1, 500, 1 << 21):
        powers, hashes, got = Powers(), {}, []
        for t in text_slices(pa.array(texts), size):
            w = words_of(t, powers)
            for d, a, b, h in zip(w.doc, w.start, w.end, w.hash):
                word = t.buf[a:b].tobytes().translate(LOWER)
                assert hashes.setdefault(word, h) == h
                got.append(word)
        assert got == [w for t in texts for w in fold(t).split()]
        assert len(set(hashes.values())) == len(hashes)


def test_pipeline_stages(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    table, labels, _ = labelled(spark)
    both = docs.unionByName(table.selectExpr("doc_id + 1000 as doc_id", "text", "'en' as lang", "'s' as source",
                                             "0L as n_chars"))
    labels = labels.withColumn("doc_id", F.col("doc_id") + 1000)
    both.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # brute force of the stages behind the model
    rows = [(r["doc_id"], r["text"]) for r in stages.toxicity(
        spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()]
    last = {}
    for i, t in rows:
        if fold(t) not in last or (i if i is not None else -1) >= (last[fold(t)][0] if last[fold(t)][0] is not None else -1):
            last[fold(t)] = (i, t)
    rows = list(last.values())
    comp = near_brute(rows)
    rows = [(i, t) for i, t in rows if i is None or comp[i][1] == i]
    lost = {i: n for i, _, n, _, _ in passages_brute(rows)}
    assert sorted([r["doc_id"] for r in out], key=repr) == sorted([i for i, _ in rows], key=repr)
    for r in out:
        text = dict(rows)[r["doc_id"]]
        if not lost[r["doc_id"]]:
            assert r["n_tokens"] == len(fold(text).split())
        else:
            assert r["n_tokens"] < len(fold(text).split())
    for name, stage in corpus_pipeline.STAGES:
        none = both.limit(0)
        assert stage(spark, none, str(tmp_path)).count() == 0, name
