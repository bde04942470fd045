"""Removal of repeated passages of 200 bytes or more, by suffix sorting.

Every 200-byte window has an anchor, the window's 128-byte string of smallest
hash (the leftmost of equals). Equal windows have equal anchors at equal places,
so windows need comparing only where their anchors are equal. Neighbouring
windows with one anchor form a context: the bytes that they cover together.

1. Anchors that occur once in the corpus are dropped.
2. Contexts that occur more than once are repeated as a whole.
3. The other contexts of an anchor match in part. Their bytes are gathered by
   anchor, the anchor itself is replaced by one symbol (a window of 200 bytes
   is then one of ``WINDOW - ANCHOR + 1`` symbols), and the suffixes of each
   bin are sorted in linear time by grouping (``grouped_suffixes``); windows
   that agree with a neighbour in that order are repeated.
4. The windows' bytes are united per text and removed.

A bin never holds more than ``BIN_CONTEXTS`` contexts: where an anchor has
more, its windows are dealt by their place around the anchor and the bytes that
all windows of such places cover, at last by the whole window, where an equal
key says it all. Membership of anchors is sifted by a bitmap of bounded size
before rows are shuffled; what it lets through wrongly falls out in the joins.

Defined results: null texts count as empty; a text under 200 bytes loses
nothing; windows never cross texts; bytes are judged on the input, so that all
copies of a repeated string go; repeated rows lose all their windows, being
copies of each other; where a cut splits a UTF-8 character, kept bytes are not
valid UTF-8 by themselves and decode with replacement characters; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.batches import SLICE_BYTES, Powers, Texts, mix, range_hash, text_slices
from panelscope.llm.grouped_suffixes import suffix_array
from panelscope.llm.layout import cut, join_dealt, unused

WINDOW = 200
ANCHOR = 128
SPREAD = WINDOW - ANCHOR + 1  # places of an anchor in a window; symbols of a reduced window
BIN_CONTEXTS = 512
#: Widths of the ranges of places by which the windows of large bins are dealt.
RANGES = (16, 4, 1)
#: Symbols sorted together (whole bins).
SORT_SYMBOLS = 30_000
#: Contexts a sorting task gets on average, and the most such tasks of a stage.
TASK_CONTEXTS = 4096
MAX_TASKS = 20_000
MAX_BITMAP_BITS = 30

_U = np.uint64
_SPAN = 1024  # spans are packed as start * _SPAN + (last window start - start)


# --- inside tasks -----------------------------------------------------------

def pieces(t: Texts) -> Iterator[tuple[Texts, int]]:
    """The slice, or for a very long text overlapping parts of it (with their
    offsets), so that every window lies in exactly one part."""
    if len(t) > 1 or len(t.buf) <= 2 * SLICE_BYTES:
        yield t, 0
        return
    for a in range(0, max(1, len(t.buf) - WINDOW + 1), SLICE_BYTES):
        buf = t.buf[a:a + SLICE_BYTES + WINDOW - 1]
        yield Texts(t.lo, t.hi, buf, np.array([0, len(buf)])), a


def contexts_of(t: Texts, powers: Powers) -> dict[str, np.ndarray]:
    """Anchor hash, context hash, text index, first and last window start and
    anchor position of every context of a slice."""
    n = len(t.buf)
    m = n - ANCHOR + 1
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return dict.fromkeys(("anchor", "ctx", "doc", "lo", "hi", "at"), none)
    up, down = powers.upto(n + 1)
    prefix = np.zeros(n + 1, _U)
    np.cumsum((t.buf.astype(_U) + _U(1)) * up[:n], out=prefix[1:])
    h = mix((prefix[ANCHOR:] - prefix[:m]) * down[:m])
    # smallest (upper half of the hash, position) of every SPREAD places, by doubling
    least = (h >> _U(32) << _U(32)) | np.arange(m, dtype=_U)
    width = 1
    while 2 * width <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    count = n - WINDOW + 1
    least = np.minimum(least[:count], least[SPREAD - width:SPREAD - width + count])
    at = (least & _U(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(t)), t.sizes)[:count]
    start = np.flatnonzero(np.arange(count) + WINDOW <= t.off[1:][doc])
    at, doc = at[start], doc[start]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))) \
        if len(start) else start
    lo, at, doc = start[new], at[new], doc[new]
    hi = start[np.append(new[1:], len(start)) - 1] if len(start) else start
    ctx = range_hash(prefix, lo, hi + WINDOW, powers) ^ mix((at - lo).astype(_U))
    return {"anchor": h[at].astype(np.int64), "ctx": ctx.astype(np.int64),
            "doc": doc, "lo": lo - t.off[doc], "hi": hi - t.off[doc], "at": at - t.off[doc]}


def _batch_contexts(batch: pa.RecordBatch, powers: Powers):
    for t in text_slices(batch.column("text")):
        for part, skipped in pieces(t):
            c = contexts_of(part, powers)
            yield part, skipped, c


def repeated_windows(rows: list[tuple[int, bytes, bytes]]) -> list[np.ndarray]:
    """For contexts given as (anchor, bytes before it, bytes after it), the
    places (bytes before the anchor) at which a window starts that agrees with
    another window of these contexts."""
    anchors = {a: k for k, a in enumerate(sorted({r[0] for r in rows}))}
    low = len(rows) + 1 + len(anchors)  # 0 ends the text, then separators, anchors, bytes
    parts, starts, at = [], [], 0
    for k, (a, left, right) in enumerate(rows):
        x = np.empty(len(left) + len(right) + 2, np.int64)
        x[:len(left)] = np.frombuffer(left, np.uint8)
        x[len(left) + 1:-1] = np.frombuffer(right, np.uint8)
        x += low
        x[len(left)] = len(rows) + 1 + anchors[a]
        x[-1] = k + 1
        parts.append(x)
        starts.append(at)
        at += len(x)
    text = np.concatenate([*parts, [0]])
    order = suffix_array(text)
    a, b = order[:-1], order[1:]
    fits = np.maximum(a, b) + SPREAD <= len(text)
    a, b = a[fits], b[fits]
    for k in (0, SPREAD - 1, SPREAD // 2):
        same = text[a + k] == text[b + k]
        a, b = a[same], b[same]
    hit = np.zeros(len(text), bool)
    for k in range(0, len(a), 4096):
        x, y = a[k:k + 4096], b[k:k + 4096]
        span = np.arange(SPREAD)
        same = (text[x[:, None] + span] == text[y[:, None] + span]).all(axis=1)
        hit[x[same]] = hit[y[same]] = True
    return [len(rows[k][1]) - np.flatnonzero(hit[s:s + len(rows[k][1]) + 1]) for k, s in enumerate(starts)]


def united(spans: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges covered by packed spans, joined where they touch."""
    out: list[tuple[int, int]] = []
    for x in np.sort(spans).tolist():
        a, b = x // _SPAN, x // _SPAN + x % _SPAN + WINDOW
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# --- Spark steps ------------------------------------------------------------

def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and the text's identity (k, n): equal texts share their spans."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k"),
                            F.octet_length(text).cast("long").alias("n"))


def _anchors(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for _, _, c in _batch_contexts(batch, powers):
                yield pa.RecordBatch.from_arrays([pa.array(c["anchor"])], names=["anchor"])

    return keyed.select("text").mapInArrow(run, "anchor long")


def _bitmap(anchors: DataFrame):
    """A broadcast bitmap of the anchors' low bits, at least 16 bits an anchor
    up to ``2**MAX_BITMAP_BITS`` bits (128 MB)."""
    n = anchors.count()
    bits = min(MAX_BITMAP_BITS, max(16, (16 * max(n, 1)).bit_length()))
    slot = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1)
    rows = anchors.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        a = (r["bucket"] - 1) * 4096
        out[a:a + 4096] = part[:len(out) - a]
    return anchors.sparkSession.sparkContext.broadcast((bits, out))


def _in_bitmap(anchor: np.ndarray, bitmap: tuple[int, np.ndarray]) -> np.ndarray:
    bits, data = bitmap
    slot = anchor & ((1 << bits) - 1)
    return (data[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _rows(keyed: DataFrame, bitmap) -> DataFrame:
    """anchor, ctx, k, n, span of the contexts whose anchor is in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for t, skipped, c in _batch_contexts(batch, powers):
                ok = _in_bitmap(c["anchor"], bitmap.value)
                doc = pa.array(t.lo + c["doc"][ok])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c["anchor"][ok]), pa.array(c["ctx"][ok]), batch.column("k").take(doc),
                     batch.column("n").take(doc),
                     pa.array((c["lo"][ok] + skipped) * _SPAN + (c["hi"] - c["lo"])[ok])],
                    names=["anchor", "ctx", "k", "n", "span"])

    return keyed.select("text", "k", "n").mapInArrow(
        run, "anchor long, ctx long, k long, n long, span long")


def _bytes(keyed: DataFrame, bitmap) -> DataFrame:
    """The same contexts with the bytes before and after their anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for t, skipped, c in _batch_contexts(batch, powers):
                ok = _in_bitmap(c["anchor"], bitmap.value)
                doc = c["doc"][ok]
                lo, hi, at = (c[x][ok] + t.off[doc] for x in ("lo", "hi", "at"))
                raw = t.buf.tobytes()
                doc = pa.array(t.lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c["anchor"][ok]), pa.array(c["ctx"][ok]), batch.column("k").take(doc),
                     batch.column("n").take(doc), pa.array(c["at"][ok] + skipped),
                     pa.array([raw[a:b] for a, b in zip(lo.tolist(), at.tolist())], pa.binary()),
                     pa.array([raw[a + ANCHOR:b + WINDOW] for a, b in zip(at.tolist(), hi.tolist())], pa.binary())],
                    names=["anchor", "ctx", "k", "n", "at", "before", "after"])

    return keyed.select("text", "k", "n").mapInArrow(
        run, "anchor long, ctx long, k long, n long, at long, before binary, after binary")


def _sorted_bins(rows: DataFrame, n_tasks: int) -> DataFrame:
    """k, n, span of the repeated windows inside each ``bin``. The number of tasks
    is given, as sorting costs far more than the bins' bytes let Spark expect."""
    def matched(part: list[tuple]) -> pa.RecordBatch:
        ks, ns, spans = [], [], []
        found = repeated_windows([(r[1], r[5], r[6]) for r in part])
        for (_, _, k, n, at, _, _), places in zip(part, found):
            if not len(places):
                continue
            start = at - places  # ascending
            first = np.flatnonzero(np.append(True, start[1:] != start[:-1] + 1))
            last = np.append(first[1:], len(start)) - 1
            spans.append(start[first] * _SPAN + start[last] - start[first])
            ks += [k] * len(first)
            ns += [n] * len(first)
        return pa.RecordBatch.from_arrays(
            [pa.array(ks, pa.int64()), pa.array(ns, pa.int64()),
             pa.array(np.concatenate(spans) if spans else np.zeros(0, np.int64))], names=["k", "n", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, symbols = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if part and row[0] != part[-1][0] and symbols >= SORT_SYMBOLS:
                    yield matched(part)
                    part, symbols = [], 0
                part.append(row)
                symbols += len(row[5]) + len(row[6]) + 2
        if part:
            yield matched(part)

    return rows.select("bin", "anchor", "k", "n", "at", "before", "after").repartition(n_tasks, "bin") \
        .sortWithinPartitions("bin").mapInArrow(run, "k long, n long, span long")


def _dealt(rows: DataFrame, width: int) -> DataFrame:
    """Each context once for every range of ``width`` places that it has
    windows at, with the bytes that these windows can cover; ``bin`` is the
    hash of what they all cover."""
    places = F.transform(F.sequence(F.lit(0), F.lit((SPREAD - 1) // width)), lambda x: x * F.lit(width))
    out = rows.withColumn("place", F.explode(places)) \
        .filter((F.length("before") >= F.col("place"))
                & (F.lit(SPREAD - 1) - F.length("after") <= F.col("place") + F.lit(width - 1)))
    core_before = F.when(F.col("place") > 0, F.expr("substring(before, -place, place)")).otherwise(F.lit(b""))
    core_after = F.expr(f"substring(after, 1, greatest(0, {SPREAD - width} - place))")
    far = F.expr(f"substring(before, -(place + {width - 1}), place + {width - 1})")
    return out.withColumn("bin", F.xxhash64("anchor", "place", core_before, core_after)) \
        .withColumn("near_before", F.when(F.length("before") <= F.col("place") + F.lit(width - 1), F.col("before"))
                    .otherwise(far)) \
        .withColumn("near_after", F.expr(f"substring(after, 1, {SPREAD - 1} - place)"))


def _windows_in_part(contexts: DataFrame, bin_contexts: int) -> DataFrame:
    """k, n, span of repeated windows of contexts that differ as a whole."""
    todo, out = contexts.withColumn("bin", F.col("anchor")), None
    for width in (*RANGES, None):
        counts = todo.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        sized = join_dealt(todo, counts, ["bin"])
        n_tasks = min(MAX_TASKS, 1 + todo.count() // TASK_CONTEXTS)  # todo is a written table
        part = _sorted_bins(sized.filter(F.col("c") <= bin_contexts), n_tasks)
        if out is not None and width is None:
            # places of width 1: an equal key is an equal window
            part = sized.select("k", "n", ((F.col("at") - F.col("place")) * F.lit(_SPAN)).alias("span"))
        out = part if out is None else out.unionByName(part)
        if width is None:
            return out
        large = cut(sized.filter(F.col("c") > bin_contexts).select(*contexts.columns))
        if large.isEmpty():
            return out
        dealt = _dealt(large.distinct(), width)
        todo = cut(dealt.select("anchor", "ctx", "k", "n", "at", "place",
                                F.col("near_before").alias("before"), F.col("near_after").alias("after"), "bin"))
        contexts = todo.drop("bin", "place")
    return out


def repeated_spans(keyed: DataFrame, bin_contexts: int = BIN_CONTEXTS) -> DataFrame:
    """k, n, spans (packed) of every text that loses something."""
    twice = cut(_anchors(keyed).groupBy("anchor").agg(F.count(F.lit(1)).alias("c"))
                .filter("c > 1").select("anchor"))
    rows = _rows(keyed, _bitmap(twice))
    groups = cut(rows.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("c")))
    whole = join_dealt(rows, groups.filter("c > 1").select("anchor", "ctx"), ["anchor", "ctx"]) \
        .select("k", "n", "span")
    mixed = cut(groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"))
    # equal contexts meet before the rows of an anchor do: a hot anchor's many copies are one row
    detail = _bytes(keyed, _bitmap(mixed)).groupBy("anchor", "ctx").agg(
        F.min(F.struct("k", "n", "at", "before", "after")).alias("r")).select("anchor", "ctx", "r.*")
    contexts = cut(join_dealt(detail, mixed, ["anchor"], "left_semi"))
    found = whole.unionByName(_windows_in_part(contexts, bin_contexts))
    return found.groupBy("k", "n").agg(F.collect_set("span").alias("spans"))


def _kept(raw: bytes, found: pa.ListScalar) -> tuple[bytes, int]:
    """The bytes that no span covers, and the number of removed runs."""
    ranges = united(np.array(found.values, np.int64)) if found.is_valid else []
    starts, ends = [0, *[r[1] for r in ranges]], [*[r[0] for r in ranges], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(starts, ends)), len(ranges)


def without_repeats(documents: DataFrame, bin_contexts: int = BIN_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    keyed = _keyed(documents)
    spans = cut(repeated_spans(keyed, bin_contexts))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_slices(batch.column("text")):
                kept = [_kept(t.raw(i), batch.column("spans")[t.lo + i]) for i in range(len(t))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(t.lo, len(t)), pa.array(t.sizes),
                     pa.array(t.sizes - np.array([len(k) for k, _ in kept])),
                     pa.array([n for _, n in kept], pa.int64()),
                     pa.array([hashlib.sha256(k).hexdigest() for k, _ in kept])],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return join_dealt(keyed, spans, ["k", "n"], "left").select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def rewritten(documents: DataFrame, bin_contexts: int = BIN_CONTEXTS) -> DataFrame:
    """The rows of ``documents`` with their kept texts; n_chars, where there is
    such a column, counts anew."""
    k, n, found = (unused(documents, c) for c in ("k", "n", "spans"))
    spans = cut(repeated_spans(_keyed(documents), bin_contexts)).toDF(k, n, found)
    text = F.coalesce("text", F.lit(""))
    keyed = documents.withColumn(k, F.xxhash64(text)).withColumn(n, F.octet_length(text).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_slices(batch.column("text")):
                kept = [_kept(t.raw(i), batch.column(found)[t.lo + i])[0].decode(errors="replace")
                        for i in range(len(t))]
                part = batch.slice(t.lo, len(t)).drop_columns([found])
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(kept, pa.string()))

    out = join_dealt(keyed, spans, [k, n], "left").select(*documents.columns, found) \
        .mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) \
        if "n_chars" in documents.columns else out
