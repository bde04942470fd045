"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score of its
hashed words and word beginnings; the document's score is their noisy-or,
``1 - prod(1 - p)``. Only document labels train it: the gradient reaches every
sentence in proportion to its share in the document's score, so the sentences
that explain a label take the blame. The same sentence scores then locate the
offending sentences.

Sentences end at a word ending in ``.``, ``!`` or ``?`` and at line feeds.
Punctuation around a word is not part of it; A-Z are lower-cased.

Defined results: a text without words has no sentences and score 0; null texts
count as empty; repeated rows score alike; without labelled rows every score is
that of the untrained model; an empty table gives no rows; other columns are
ignored, and a label, language, source or id is never an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.batches import Powers, range_hash, text_slices, words_of
from panelscope.llm.labelled import MAX_FIT_ROWS, fit_sample, is_held_out

BUCKET_BITS = 22
#: A word gives a feature for itself and one for each of these beginnings.
PREFIX_BYTES = (4, 5, 6)
FEATURES = 1 + len(PREFIX_BYTES)
FIRST_BIAS = -6.0
EPOCHS = 8
RATE = 1.0
#: Steps of a feature start small: rare words must not memorise single documents.
FIRST_SQUARE = 1.0
#: Features of fewer training documents than this stay at 0.
MIN_DOCS = 4
LASSO = 0.05
THRESHOLD = 0.7
#: Sentences scored at least this are reported as offending.
SENTENCE_THRESHOLD = 0.5


@dataclass
class Bags:
    """Features of words, sentences of words, documents and byte ranges of sentences."""
    features: np.ndarray
    first_word: np.ndarray  # of each sentence
    doc: np.ndarray         # of each sentence
    start: np.ndarray
    end: np.ndarray


def _trim_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(b".,;:!?\"'()[]*_-")] = True
    return t


def bags_of(texts, powers: Powers) -> Bags:
    words = words_of(texts, powers)
    buf, trim = texts.buf, _trim_table()
    n = len(words.doc)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Bags(np.zeros((0, FEATURES), np.int32), none, none, none, none)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        end -= trim[buf[end - 1]] & (end - start > 1)
        start += trim[buf[start]] & (end - start > 1)
    columns = []
    for k, cap in enumerate((None, *PREFIX_BYTES)):
        stop = end if cap is None else np.minimum(end, start + cap)
        h = range_hash(words.prefix, start, stop, powers) ^ np.uint64(k * 0x1E3779B97F4A7C15)
        columns.append(((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    last = np.isin(buf[words.end - 1], np.frombuffer(b".!?", np.uint8))
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    new = np.ones(n, bool)
    new[1:] = (words.doc[1:] != words.doc[:-1]) | last[:-1] | (lines[words.start[1:]] != lines[words.end[:-1]])
    first = np.flatnonzero(new)
    until = np.append(first[1:], n) - 1
    return Bags(np.stack(columns, axis=1), first, words.doc[first], words.start[first], words.end[until])


def sentence_logits(bags: Bags, weights: np.ndarray, bias: float) -> np.ndarray:
    if not len(bags.first_word):
        return np.zeros(0)
    return bias + np.add.reduceat(weights[bags.features].sum(axis=1, dtype=np.float64), bags.first_word)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50.0, 50.0)))


def noisy_or(logits: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """1 - prod(1 - p) of each document's sentences."""
    return -np.expm1(-np.bincount(doc, weights=softplus(logits), minlength=n_docs))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _document_features(b: Bags) -> np.ndarray:
    """Each feature once for every document that it occurs in."""
    doc = np.repeat(b.doc, np.diff(np.append(b.first_word, len(b.features))))
    pairs = np.unique((doc[:, None].astype(np.int64) << BUCKET_BITS | b.features).ravel())
    return pairs & ((1 << BUCKET_BITS) - 1)


def fit(texts: pa.Array, y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adagrad on the documents' log loss, in a fixed order: ``epochs`` with a
    lasso penalty, then as many with the features of positive weight alone.
    Memory is four 32-bit features a word of the (bounded) sample."""
    powers, parts = Powers(), []
    counts = np.zeros(1 << BUCKET_BITS, np.int32)
    for t in text_slices(texts, 1 << 18):
        bags = bags_of(t, powers)
        if len(bags.first_word):
            np.add.at(counts, _document_features(bags), 1)
            parts.append((bags, y[t.lo:t.hi]))
    common = np.flatnonzero(counts >= MIN_DOCS)
    number = np.full(1 << BUCKET_BITS, len(common), np.int32)  # the last one: a weight that stays 0
    number[common] = np.arange(len(common), dtype=np.int32)
    for bags, _ in parts:
        bags.features = number[bags.features]
    del counts, number
    weights, square = np.zeros(len(common) + 1), np.full(len(common) + 1, FIRST_SQUARE)
    bias, bias_square = FIRST_BIAS, FIRST_SQUARE
    for epoch in range(2 * epochs):
        penalty = LASSO if epoch < epochs else 0.0
        if epoch == epochs:  # go on with the chosen features alone, without the penalty's bias
            chosen = weights > 0
            weights[~chosen] = 0.0
        for k in np.random.default_rng(epoch).permutation(len(parts)):
            bags, label = parts[k]
            z = sentence_logits(bags, weights, bias)
            p = np.clip(noisy_or(z, bags.doc, len(label)), 1e-9, 1 - 1e-9)
            # d loss / d logit: sigma(z) * (1 for a clean document, -(1 - p) / p for a toxic one)
            blame = np.where(label == 1, -(1 - p) / p, 1.0)[bags.doc] * sigmoid(z)
            per_word = np.repeat(blame, np.diff(np.append(bags.first_word, len(bags.features))))
            g = np.bincount(bags.features.ravel(), weights=np.repeat(per_word, FEATURES),
                            minlength=len(weights))
            g[-1] = 0.0
            if epoch >= epochs:
                g[~chosen] = 0.0
            at = np.flatnonzero(g)
            square[at] += g[at] * g[at]
            step = RATE / np.sqrt(square[at])
            moved = weights[at] - step * g[at]
            weights[at] = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0.0)
            g = blame.sum()
            bias_square += g * g
            bias -= RATE * g / np.sqrt(bias_square)
    full = np.zeros(1 << BUCKET_BITS, np.float32)
    full[common] = weights[:-1]
    return Model(full, float(bias))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, offending (byte ranges and scores of sentences)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 16 MB, fixed by BUCKET_BITS
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, m = Powers(), shared.value
        for batch in batches:
            for t in text_slices(batch.column("text")):
                bags = bags_of(t, powers)
                z = sentence_logits(bags, m.weights, m.bias)
                score = noisy_or(z, bags.doc, len(t))
                p = sigmoid(z)
                bad = np.flatnonzero(p >= SENTENCE_THRESHOLD)
                spans = pa.StructArray.from_arrays(
                    [pa.array(bags.start[bad] - t.off[bags.doc[bad]]),
                     pa.array(bags.end[bad] - t.off[bags.doc[bad]]), pa.array(p[bad])],
                    names=["start", "end", "p"])
                off = np.searchsorted(bags.doc[bad], np.arange(len(t) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(t.lo, len(t)), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(off), spans)],
                    names=["doc_id", "score", "offending"])

    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, "
             "offending array<struct<start: long, end: long, p: double>>")


def toxicity(documents: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, offending of every row. The model
    is fitted on at most ``max_fit_rows`` labelled rows that are not held out."""
    model = fit(*fit_sample(documents, labels, "toxic", max_fit_rows))
    return scored(documents, model).select(
        "doc_id", is_held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


def clean_rows(documents: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score below
    the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(
        fit(*fit_sample(documents, labels, "toxic", max_fit_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, m = Powers(), shared.value
        for batch in batches:
            for t in text_slices(batch.column("text")):
                bags = bags_of(t, powers)
                score = noisy_or(sentence_logits(bags, m.weights, m.bias), bags.doc, len(t))
                yield batch.slice(t.lo, len(t)).filter(pa.array(score < THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
