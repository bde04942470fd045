"""Near-duplicate groups by HyperMinHash sketches.

A text's set holds the hashes of its distinct 5-word shingles. One hash a
shingle picks a bucket and a remainder; a bucket's register keeps of its
smallest remainder the count of leading zeros and a 10-bit mantissa. Empty
registers borrow from filled ones by a fixed random order. Bands of registers
make candidate buckets; candidates pass bounds on set sizes and a Jaccard
estimate corrected for accidental register collisions, and links are confirmed
on the full sets.

Work inside a candidate bucket is not quadratic. Texts with equal sets form
one class, of which one goes on. A shingle that no other candidate has
cannot be shared, so ``n - unique`` bounds any intersection: classes with too
many such shingles leave, and each bucket compares its members with a pivot,
the member with the smallest unique share. Where members are left outside their
bucket's main component, an exact prefix join completes the links: with shingles
ordered by frequency, two sets over the threshold share a shingle among the
first ``100 - threshold_pct`` % of each, at positions that leave enough behind them.
Only links that join components matter to the result.

With 32 bands of 4 registers a pair at the threshold is missed with
probability of about 6e-11 at 85 % and 5e-8 at 80 %; the estimate rejects only beyond 6 standard errors.

Classes go by their sets' identity, numbered by their first row, whatever the
ids of their rows; a component's smallest id is found last.

Defined results: a text without words has an empty set, no links and itself as
component; with 1-4 words the whole sequence is its one shingle; null texts
count as empty; repeated rows share a class; an id with several texts is a row
each, linked by its own text; a null id is larger than any other, and in a
component of null ids alone the rows of one text are kept; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelscope.llm.batches import Powers, mix, text_slices, window_hashes, words_of
from panelscope.llm.layout import cut, join_dealt, raw_key

SHINGLE_WORDS = 5
REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
MANTISSA_BITS = 10
BAND_ROWS = 4
#: Least Jaccard similarity of a link, unless the caller gives another.
THRESHOLD_PCT = 85
STANDARD_ERRORS = 6.0

_REST_BITS = 64 - REGISTER_BITS


# --- sets and sketches (inside tasks) ---------------------------------------

def shingle_sets(texts, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice, ascending inside each text, and
    the offsets of the texts."""
    words = words_of(texts, powers)
    at, h = window_hashes(words, SHINGLE_WORDS)
    doc = words.doc[at]
    per_doc = words.per_doc(len(texts))
    short = np.flatnonzero((per_doc > 0) & (per_doc < SHINGLE_WORDS))
    if len(short):
        first = np.searchsorted(words.doc, short)
        one = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE_WORDS - 1):
            has = per_doc[short] > k
            one[has] = one[has] * np.uint64(0x2545F4914F6CDD1D) + words.hash[first[has] + k]
        h = np.concatenate([h, mix(one + per_doc[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def registers(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """HyperMinHash registers of each set (one row a set, 0: empty before
    borrowing) and which of them are filled. ``h`` ascends inside a set, so
    the first hash of each bucket is its smallest remainder."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    bucket = (h >> np.uint64(_REST_BITS)).astype(np.int64)
    cell = doc * REGISTERS + bucket
    first = np.ones(len(h), bool)
    first[1:] = cell[1:] != cell[:-1]
    rest = h[first] & np.uint64((1 << _REST_BITS) - 1)
    # position of the leading one: exact, as the upper half and the lower are taken apart
    high = (rest >> np.uint64(32)).astype(np.float64)
    low = (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.int64)
    zeros = np.minimum(_REST_BITS - bits + 1, 63)
    shift = bits - 1 - MANTISSA_BITS
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64),
                        rest << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1)
    regs = np.zeros(n * REGISTERS, np.uint16)
    regs[cell[first]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    regs = regs.reshape(n, REGISTERS)
    return regs, regs > 0


def lenders() -> np.ndarray:
    """For each register, the order in which it asks others for a value."""
    rng = np.random.default_rng(8)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


def filled_up(regs: np.ndarray, filled: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Registers after borrowing; sets without any stay 0."""
    out = regs.copy()
    open_ = ~filled & filled.any(axis=1)[:, None]
    row, col = np.nonzero(open_)
    for k in range(REGISTERS):
        if not len(row):
            break
        source = order[col, k]
        found = filled[row, source]
        out[row[found], col[found]] = regs[row[found], source[found]]
        row, col = row[~found], col[~found]
    return out


def band_keys(full: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    bands = full.reshape(len(full), -1, BAND_ROWS).astype(np.uint64)
    key = np.arange(bands.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return key


def collision_rates() -> np.ndarray:
    """Share of registers that agree by accident for two disjoint sets of
    2**0, 2**1, .. 2**40 members: the sum, over the cells of a register, of
    the squared probability that it holds that cell."""
    zeros = np.arange(_REST_BITS)
    cell = 1.0 + np.arange(1 << MANTISSA_BITS) / (1 << MANTISSA_BITS)
    low = (2.0 ** -(zeros + 1.0))[:, None] * cell[None, :] / REGISTERS
    high = low + (2.0 ** -(zeros + 1.0))[:, None] / (1 << MANTISSA_BITS) / REGISTERS
    out = []
    for n in 2.0 ** np.arange(41):
        p = np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-high))
        out.append(float((p * p).sum()))
    return np.array(out)


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray,
              rates: np.ndarray, threshold_pct: int = THRESHOLD_PCT) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate from unborrowed registers, and its
    standard error at the threshold."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    c = np.interp(np.log2(np.sqrt(n_a.astype(float) * n_b)), np.arange(len(rates)), rates)
    j = (equal / np.maximum(used, 1) - c) / (1 - c)
    t = threshold_pct / 100
    return j, np.sqrt(t * (1 - t) / np.maximum(used, 1))


# --- Spark steps ------------------------------------------------------------

def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, raw_key, n, set_a, set_b (identity of the set), regs, bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, order = Powers(), lenders()
        for batch in batches:
            for t in text_slices(batch.column("text")):
                h, off = shingle_sets(t, powers)
                n = np.diff(off)
                total = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(h, out=total[0, 1:])
                np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1, 1:])
                regs, filled = registers(h, off)
                keys = band_keys(filled_up(regs, filled, order))
                width = keys.shape[1]
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(t.lo, len(t)) for c in ("doc_id", "raw_key")], pa.array(n),
                    *[pa.array((x[off[1:]] - x[off[:-1]]).view(np.int64)) for x in total],
                    _rows_as_binary(regs.tobytes(), len(t)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(t) + 1, dtype=np.int32) * width),
                        pa.array(keys.reshape(-1).view(np.int64)))],
                    names=["doc_id", "raw_key", "n", "set_a", "set_b", "regs", "bands"])

    return documents.select("doc_id", "text", raw_key().alias("raw_key")).mapInArrow(
        run, f"doc_id {_id_type(documents)}, raw_key long, n long, set_a long, set_b long, regs binary, "
             "bands array<long>")


def _rows_as_binary(data: bytes, n: int) -> pa.Array:
    width = len(data) // max(n, 1)
    off = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, off, pa.py_buffer(data)])


def full_sets(texts: DataFrame) -> DataFrame:
    """cls, set (ascending 64-bit hashes as bytes) of cls, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for t in text_slices(batch.column("text")):
                h, off = shingle_sets(t, powers)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cls").slice(t.lo, len(t)),
                     pa.array([h[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())],
                    names=["cls", "set"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, set binary")


def members_of(sets: DataFrame) -> DataFrame:
    """(cls, shingle) rows of the sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                found = [np.frombuffer(x.as_py(), np.int64) for x in part.column("set")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("cls").take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))),
                     pa.array(np.concatenate(found))], names=["cls", "shingle"])

    return sets.select("cls", "set").mapInArrow(run, f"cls {_id_type(sets, 'cls')}, shingle long")


def unique_counts(sets: DataFrame) -> DataFrame:
    """cls, u: how many of a class's shingles no other class here has."""
    alone = members_of(sets).groupBy("shingle").agg(
        F.count(F.lit(1)).alias("c"), F.min("cls").alias("cls")).filter("c = 1")
    return alone.groupBy("cls").agg(F.count(F.lit(1)).alias("u"))


def _id_type(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()


def can_link(n_a: Column, n_b: Column, most: Column, threshold_pct: int) -> Column:
    """Whether an intersection of at most ``most`` can reach the threshold."""
    return F.lit(100) * most >= F.lit(threshold_pct) * (n_a + n_b - most)


def links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, among those that
    the estimate leaves possible."""
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates = collision_rates()
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                    for c in ("regs_a", "regs_b"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            j, error = estimated(a, b, n_a, n_b, rates, threshold_pct)
            likely = pa.array(j + STANDARD_ERRORS * error >= threshold_pct / 100)
            yield batch.select(["a", "b"]).filter(likely)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= threshold_pct * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    kind = _id_type(pairs, "a")
    side = lambda df, x, *cols: df.select(F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    likely = pairs.join(side(nodes, "a", "regs", "n"), "a").join(side(nodes, "b", "regs", "n"), "b") \
        .mapInArrow(estimate, f"a {kind}, b {kind}")
    return likely.join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b") \
        .mapInArrow(verify, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for the nodes of (a, b) edges, by
    alternating large-star and small-star steps. Hot centres are aggregated
    before they are joined, and Spark splits their joins."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        back = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        hood = both.unionByName(back)
        if not large:
            hood = hood.filter("v < u")
        least = hood.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = join_dealt(hood, least, ["u"]).filter("v > u" if large else "v != m") \
            .select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            out = out.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.filter("a != b")

    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .filter("a != b").distinct())
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
        e = cut(star(star(e, True), False).distinct())
    return e.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def near_groups(documents: DataFrame, threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; texts are linked from
    a Jaccard similarity of ``threshold_pct`` % on. ``raw_key`` (of the text) and
    ``stays`` single out one id and text of each component."""
    rows = cut(sketches(documents).withColumn("row", F.monotonically_increasing_id()))
    key = ["set_a", "set_b", "n"]
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw_key")
    classes = cut(rows.groupBy(*key).agg(F.min("row").alias("cls"), F.min(name).alias("first")))
    members = cut(join_dealt(rows.select("doc_id", "raw_key", *key), classes, key)
                  .select("doc_id", "raw_key", "n", "cls", "first"))

    heads = rows.filter("n > 0").withColumnRenamed("row", "cls").join(classes.select("cls"), "cls", "left_semi")
    spread = heads.select("cls", F.explode(F.array_distinct("bands")).alias("band"))
    shared = spread.groupBy("band").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")) \
        .filter("lo != hi").select("band")
    in_band = cut(join_dealt(spread, shared, ["band"]))
    candidates = in_band.select("cls").distinct()
    wanted = heads.join(candidates, "cls", "left_semi").select(
        "cls", F.col("doc_id").alias("head_id"), F.col("raw_key").alias("head_key"))
    keyed = documents.select("doc_id", "text", raw_key().alias("raw_key"))
    # rows that repeat id and text give the same set more than once
    sets = cut(full_sets(keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["head_id"])
                                    & (keyed["raw_key"] == wanted["head_key"]))).dropDuplicates(["cls"]))
    nodes = cut(heads.select("cls", "n", "regs").join(candidates, "cls", "left_semi")
                .join(unique_counts(sets), "cls", "left").fillna(0, ["u"])
                .filter(F.lit(100) * (F.col("n") - F.col("u")) >= F.lit(threshold_pct) * F.col("n"))
                .withColumn("most", F.col("n") - F.col("u")))
    live = cut(in_band.join(nodes.select("cls", "n", "u", "most"), "cls"))

    stars = roots(links(_stars(live, threshold_pct), nodes, sets, threshold_pct))
    pairs = _leftovers(_mixed(live, stars), sets, threshold_pct)
    comps = components(links(pairs, nodes, sets, threshold_pct).unionByName(
        stars.select(F.col("node").alias("a"), F.col("comp").alias("b"))))

    least = comps.join(classes.select(F.col("cls").alias("node"), "first"), "node") \
        .groupBy("comp").agg(F.min("first").alias("comp_first"))
    named = join_dealt(comps, least, ["comp"]).select(F.col("node").alias("cls"), "comp_first")
    found = members.join(named, "cls", "left").withColumn("first", F.coalesce("comp_first", "first"))
    empty = F.col("n") == 0
    at_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    same_text = F.col("raw_key") == F.col("first.raw_key")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (empty | (at_first & (F.col("doc_id").isNotNull() | same_text))).alias("kept"),
        "raw_key", (empty | (at_first & same_text)).alias("stays"))


def roots(links: DataFrame) -> DataFrame:
    """node, comp for links (a, b) that lead from each a to one b which comes
    earlier in a fixed order: the end of the chain, by pointer jumping."""
    now = cut(links.select(F.col("a").alias("node"), F.col("b").alias("comp")))
    while True:
        ahead = now.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        jumped = cut(now.join(ahead, "comp", "left").select("node", "comp", "further"))
        if jumped.filter("further is not null").isEmpty():
            return now
        now = jumped.select("node", F.coalesce("further", "comp").alias("comp"))


def _mixed(live: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with ``comp``."""
    here = live.join(comps, live["cls"] == comps["node"], "left") \
        .withColumn("comp", F.coalesce("comp", "cls")).drop("node")
    mixed = here.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
        .filter("lo != hi").select("band")
    return cut(join_dealt(here, mixed, ["band"], "left_semi"))


def _stars(live: DataFrame, threshold_pct: int) -> DataFrame:
    """(a, b): each class a with the pivot b that it shares most buckets with.
    A bucket's pivot is its first member by (unique share, id), so that chains
    of pairs end."""
    pivots = live.groupBy("band").agg(F.min(F.struct(
        (F.col("u") / F.col("n")).alias("share"), "cls", "n", "most")).alias("p"))
    offers = join_dealt(live, pivots, ["band"]).filter(F.col("cls") != F.col("p.cls")) \
        .filter(can_link(F.col("n"), F.col("p.n"), F.least("most", F.col("p.most")), threshold_pct))
    counted = offers.groupBy("cls", F.col("p.share").alias("share"), F.col("p.cls").alias("pivot")) \
        .agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("cls").agg(F.min(F.struct((-F.col("c")).alias("c"), "share", "pivot")).alias("best")) \
        .select(F.col("cls").alias("a"), F.col("best.pivot").alias("b"))


def _leftovers(here: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs of a class outside the largest component of one of its buckets
    and a class of another component, by a prefix join over frequency-ordered
    shingles. Where ``rank`` counts a shingle's position (those that nobody
    shares come first), a first common shingle at ranks r and s leaves an
    intersection of at most ``1 + min(n - r, m - s)``."""
    sized = here.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sized.groupBy("band").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
    nodes = cut(join_dealt(here, main, ["band"]).groupBy("cls").agg(
        F.first("n").alias("n"), F.first("comp").alias("comp"),
        F.max(F.col("comp") != F.col("main")).alias("outside")))
    rows = cut(members_of(sets.join(nodes.select("cls"), "cls", "left_semi")))
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rows = rows.join(shared, "shingle")
    by_df = Window.partitionBy("cls").orderBy("df", "shingle")
    whole = Window.partitionBy("cls")
    prefix = rows.withColumn("at", F.row_number().over(by_df)) \
        .withColumn("common", F.count(F.lit(1)).over(whole)).join(nodes, "cls") \
        .withColumn("rank", F.col("n") - F.col("common") + F.col("at")) \
        .filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold_pct) / F.lit(100)) + 1)
    prefix = cut(prefix.select("shingle", "cls", "n", "comp", "outside", "rank"))
    x = prefix.filter("outside").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("cls", "n", "comp", "rank")])
    y = prefix.select("shingle", *[F.col(c).alias(f"y_{c}") for c in ("cls", "n", "comp", "rank", "outside")])
    left = F.lit(1) + F.least(F.col("x_n") - F.col("x_rank"), F.col("y_n") - F.col("y_rank"))
    return x.join(y, "shingle").filter("x_comp != y_comp and (not y_outside or x_cls < y_cls)") \
        .filter(can_link(F.col("x_n"), F.col("y_n"), F.least(left, "x_n", "y_n"), threshold_pct)) \
        .select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct()
