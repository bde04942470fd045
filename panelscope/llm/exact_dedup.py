"""Exact deduplication by composable polynomial fingerprints.

A text (A-Z lower-cased, UTF-8) is cut into chunks; each chunk is hashed on
its own as a polynomial over several primes, and chunk hashes combine by
length-shifted arithmetic, ``h(xy) = h(x) * r**len(y) + h(y)``. Rows with
equal fingerprint and length form a group, and each member is then compared
chunk by chunk with the group's head; a member that differs anywhere (a
fingerprint collision) leaves the group and is grouped by its digest.

Groups are never gathered: sizes and survivors are aggregates, chunks of
groups of one are left out by the join that fetches the others, and the
comparison is an equi-join on (fingerprint, chunk number). Both joins are dealt
by a key more than their aggregates (``join_dealt``), so that Spark can split
a large group over tasks.

Defined results: a null text equals an empty one; of rows that repeat both
id and text one is kept; a null doc_id is smaller than any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelscope.llm.batches import lower_table, text_slices
from panelscope.llm.layout import cut, join_dealt, raw_key, unused

#: Primes below 2**31 (products of residues fit 64 bits) and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1220703125, 630360016, 742938285)
CHUNK_BYTES = 1 << 16

_FP = ["fp_a", "fp_b", "n_bytes"]


def chunk_powers(chunk_bytes: int, primes: tuple[int, ...]) -> list[np.ndarray]:
    """``base**0 .. base**chunk_bytes`` modulo each prime."""
    rows = []
    for p, r in zip(primes, BASES):
        row = np.ones(1, np.uint64)
        while len(row) <= chunk_bytes:
            step = np.uint64(pow(r % p, len(row), p))
            row = np.concatenate([row, row * step % np.uint64(p)])
        rows.append(row[:chunk_bytes + 1])
    return rows


def chunk_bounds(off: np.ndarray, chunk_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, start and end of every chunk; an empty text has one empty chunk."""
    sizes = np.diff(off)
    counts = np.maximum(1, -(-sizes // chunk_bytes))
    doc = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = off[:-1][doc] + number * chunk_bytes
    return doc, start, np.minimum(start + chunk_bytes, off[1:][doc])


def hash_chunks(buf: np.ndarray, start: np.ndarray, end: np.ndarray,
                powers: list[np.ndarray], primes: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hash of each (adjacent) chunk modulo each prime. A chunk's
    sum stays far below 2**64: bytes are at most 256 and residues below 2**31."""
    length = end - start
    full = length > 0
    back = np.repeat(end, length) - 1 - np.arange(len(buf))  # bytes after this one in its chunk
    value = buf.astype(np.uint64) + np.uint64(1)
    out = []
    for row, p in zip(powers, primes):
        h = np.zeros(len(start), np.uint64)
        if len(buf):
            h[full] = np.add.reduceat(value * row[back], start[full]) % np.uint64(p)
        out.append(h)
    return out


def combine(doc: np.ndarray, length: np.ndarray, hashes: list[np.ndarray], n_docs: int,
            powers: list[np.ndarray], primes: tuple[int, ...]) -> list[np.ndarray]:
    """Fold the chunk hashes of each text, left to right, all texts in step."""
    first = np.searchsorted(doc, np.arange(n_docs))
    counts = np.bincount(doc, minlength=n_docs)
    out = [h[first] for h in hashes]
    for k in range(1, int(counts.max(initial=1))):
        more = np.flatnonzero(counts > k)
        at = first[more] + k
        for i, p in enumerate(primes):
            shift = powers[i][length[at]]
            out[i][more] = (out[i][more] * shift + hashes[i][at]) % np.uint64(p)
    return out


def _batches(batch: pa.RecordBatch, chunk_bytes: int, primes: tuple[int, ...], powers: list[np.ndarray]):
    """(texts, lower-cased bytes, chunk text index, start, end, fingerprint columns) of each slice."""
    for t in text_slices(batch.column("text")):
        low = lower_table()[t.buf]
        doc, start, end = chunk_bounds(t.off, chunk_bytes)
        h = hash_chunks(low, start, end, powers, primes)
        a, b, c, d = combine(doc, end - start, h, len(t), powers, primes)
        fp_a = (a << np.uint64(31) | b).astype(np.int64)
        fp_b = (c << np.uint64(31) | d).astype(np.int64)
        yield t, low, doc, start, end, fp_a, fp_b


def fingerprints(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES,
                 primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """doc_id, fp_a, fp_b, n_bytes, text_sha256 of every row, and raw_key, a
    hash of the text as it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = chunk_powers(chunk_bytes, primes)
        for batch in batches:
            for t, low, _, _, _, fp_a, fp_b in _batches(batch, chunk_bytes, primes, powers):
                raw = low.tobytes()
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(t.off[:-1], t.off[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(t.lo, len(t)), pa.array(fp_a), pa.array(fp_b),
                     pa.array(t.sizes), pa.array(sha), batch.column("raw_key").slice(t.lo, len(t))],
                    names=["doc_id", *_FP, "text_sha256", "raw_key"])

    return documents.select("doc_id", "text", raw_key().alias("raw_key")).mapInArrow(
        run, f"doc_id {_id_type(documents)}, fp_a long, fp_b long, n_bytes long, "
             "text_sha256 string, raw_key long")


def chunks(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES,
           primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """doc_id, raw_key, fp_a, fp_b, n_bytes, chunk_no, chunk of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = chunk_powers(chunk_bytes, primes)
        for batch in batches:
            for t, low, doc, start, end, fp_a, fp_b in _batches(batch, chunk_bytes, primes, powers):
                raw = low.tobytes()
                first, row = np.searchsorted(doc, np.arange(len(t))), pa.array(t.lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("raw_key").take(row), pa.array(fp_a[doc]),
                     pa.array(fp_b[doc]), pa.array(t.sizes[doc]),
                     pa.array((np.arange(len(doc)) - first[doc]).astype(np.int32)),
                     pa.array([raw[a:b] for a, b in zip(start, end)], pa.binary())],
                    names=["doc_id", "raw_key", *_FP, "chunk_no", "chunk"])

    return documents.select("doc_id", "text", raw_key().alias("raw_key")).mapInArrow(
        run, f"doc_id {_id_type(documents)}, raw_key long, fp_a long, fp_b long, n_bytes long, "
             "chunk_no int, chunk binary")


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def _group(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"),
                                  F.count(F.lit(1)).alias("group_size"))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & a[n].eqNullSafe(b[n])
    return cond


def colliding(documents: DataFrame, rows: DataFrame, chunk_bytes: int,
              primes: tuple[int, ...]) -> DataFrame:
    """Ids, text keys and fingerprints of members that differ from their
    group's head, its row with the largest id (and text key)."""
    heads = rows.groupBy(*_FP).agg(F.max(F.struct("doc_id", "raw_key")).alias("head"), F.count(F.lit(1)).alias("c")) \
        .filter("c > 1").select(*_FP, F.col("head.doc_id").alias("head_id"), F.col("head.raw_key").alias("head_key"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("raw_key") == F.col("head_key"))
    members = cut(join_dealt(chunks(documents, chunk_bytes, primes), heads, _FP)
                  .withColumn("is_head", is_head).drop("head_id", "head_key"))
    kept = members.filter("is_head").groupBy(*_FP, "chunk_no").agg(F.max("chunk").alias("kept_chunk"))
    compared = join_dealt(members.filter("NOT is_head"), kept, [*_FP, "chunk_no"])
    return compared.filter(F.col("chunk") != F.col("kept_chunk")).select("doc_id", "raw_key", *_FP).distinct()


def exact_groups(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES,
                 primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, raw_key of every row."""
    rows = cut(fingerprints(documents, chunk_bytes, primes))
    out = colliding(documents, rows, chunk_bytes, primes).withColumn("apart", F.lit(True))
    marked = rows.join(out, _same(rows, out, ["doc_id", "raw_key", *_FP]), "left").select(
        *[rows[c] for c in rows.columns],
        F.when(out["apart"], rows["text_sha256"]).otherwise(F.lit("")).alias("apart_key"))
    key = [*_FP, "apart_key"]
    joined = join_dealt(marked, _group(marked, key), key)
    same_row = Window.partitionBy("doc_id", "text_sha256").orderBy("raw_key")
    return joined.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))
         & (F.row_number().over(same_row) == 1)).alias("kept"),
        "text_sha256", "raw_key")


def without_copies(documents: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns. Texts are
    shuffled once; only rows that repeat id and text are once more, to drop
    the repetitions."""
    groups = cut(exact_groups(documents).select("doc_id", "raw_key", "kept"))
    key, id_, flag = (unused(documents, n) for n in ("row_key", "kept_id", "again"))
    rows = groups.groupBy("doc_id", "raw_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")) \
        .filter("kept").select(F.col("doc_id").alias(id_), F.col("raw_key").alias(key), (F.col("n") > 1).alias(flag))
    keyed = documents.withColumn(key, raw_key())
    found = keyed.join(rows, keyed["doc_id"].eqNullSafe(rows[id_]) & (keyed[key] == rows[key])).select(
        *[keyed[c] for c in keyed.columns], flag)
    once = found.filter(~F.col(flag))
    return once.unionByName(found.filter(F.col(flag)).dropDuplicates(["doc_id", key])).drop(key, flag)
