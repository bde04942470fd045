"""Quality classifier: a factorisation machine.

Inputs are hashed words (weight: count over the text's length, so the row has
length 1 at most), structure statistics of the text and its length (each cut
into bins, a bin being an input of weight 1). Every pair of inputs interacts
through low-rank vectors, and the sum over all pairs is computed in linear time
from the identity ``sum_{i<j} <v_i, v_j> x_i x_j = (|sum x_i v_i|^2 - sum
|x_i v_i|^2) / 2``.

Defined results: a text without words has only its structure bins as inputs;
null texts count as empty; repeated rows score alike; without labelled rows
every score is about 0.5; an empty table gives no rows; other columns are
ignored, and a label, language, source or id is never an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.batches import Powers, text_slices, words_of
from panelscope.llm.labelled import MAX_FIT_ROWS, fit_sample, is_held_out

WORD_BITS = 16
RANK = 8
BINS = 12
EPOCHS = 10
RATE = 0.1
DECAY = 1e-5
THRESHOLD = 0.5

#: Structure statistics: name, and the value of the first and last bin.
STATISTICS = (
    ("log2_words", 0.0, 15.0), ("log2_bytes", 0.0, 18.0), ("mean_word_bytes", 2.0, 12.0),
    ("upper", 0.0, 0.6), ("digit", 0.0, 0.3), ("symbol", 0.0, 0.2), ("punctuation", 0.0, 0.2),
    ("non_ascii", 0.0, 0.3), ("distinct_words", 0.0, 1.0), ("most_frequent_word", 0.0, 0.5),
    ("same_as_previous", 0.0, 0.9), ("log2_lines", 0.0, 10.0), ("short_lines", 0.0, 1.0),
)
SIZE = (1 << WORD_BITS) + len(STATISTICS) * BINS


def _class_table() -> np.ndarray:
    """Byte classes: 1 upper, 2 digit, 3 symbol, 4 punctuation, 5 non-ASCII, 6 line feed."""
    t = np.zeros(256, np.int64)
    t[65:91], t[48:58], t[128:] = 1, 2, 5
    t[list(b"#*$%&|<>@^~{}\\=+_/")] = 3
    t[list(b".,;:!?")] = 4
    t[10] = 6
    return t


@dataclass
class Rows:
    """Inputs of each text, text by text: index, weight, offsets."""
    index: np.ndarray
    weight: np.ndarray
    off: np.ndarray


def rows_of(texts, powers: Powers) -> Rows:
    n = len(texts)
    words = words_of(texts, powers)
    total = words.per_doc(n)
    order = np.lexsort((words.hash, words.doc))
    doc, h = words.doc[order], words.hash[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    doc, h = doc[at], h[at]
    bucket = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)

    sizes = texts.sizes
    owner = np.repeat(np.arange(n), sizes)
    classes = np.bincount(owner * 8 + _class_table()[texts.buf], minlength=8 * n).reshape(n, 8)
    per_byte = classes / np.maximum(sizes, 1)[:, None]
    word_bytes = np.bincount(words.doc, weights=words.end - words.start, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc, count)
    same = np.zeros(n)
    if len(words.hash) > 1:
        again = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        same = np.bincount(words.doc[1:][again], minlength=n).astype(float)
    lines = classes[:, 6] + 1
    words_or_1 = np.maximum(total, 1)
    values = np.stack([
        np.log2(total + 1), np.log2(sizes + 1), word_bytes / words_or_1, *(per_byte[:, k] for k in (1, 2, 3, 4, 5)),
        np.bincount(doc, minlength=n) / words_or_1, most / words_or_1, same / words_or_1,
        np.log2(lines), 1.0 / np.maximum(1.0, total / lines)], axis=1)
    low = np.array([s[1] for s in STATISTICS])
    high = np.array([s[2] for s in STATISTICS])
    bins = np.ceil(np.clip((values - low) / (high - low), 0, 1) * (BINS - 1)).astype(np.int64)
    bins += (1 << WORD_BITS) + np.arange(len(STATISTICS)) * BINS

    index = np.concatenate([bucket, bins.ravel()])
    weight = np.concatenate([count / words_or_1[doc], np.ones(bins.size)])
    whose = np.concatenate([doc, np.repeat(np.arange(n), len(STATISTICS))])
    order = np.argsort(whose, kind="stable")
    whose = whose[order]
    return Rows(index[order], weight[order], np.searchsorted(whose, np.arange(n + 1)))


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def logits(rows: Rows, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores before the logistic function; the weighted vectors and their
    sums. Every text has its structure inputs, so no row is empty."""
    x = rows.weight[:, None]
    v = m.factors[rows.index] * x
    start = rows.off[:-1]
    s = np.add.reduceat(v, start, axis=0)
    pairs = 0.5 * ((s * s) - np.add.reduceat(v * v, start, axis=0)).sum(axis=1)
    return m.bias + np.add.reduceat(m.linear[rows.index] * rows.weight, start) + pairs, v, s


def fit(texts: pa.Array, y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adagrad on the log loss, in a fixed order."""
    rng = np.random.default_rng(10)
    m = Model(0.0, np.zeros(SIZE), rng.normal(0.0, 0.05, (SIZE, RANK)))
    bias_square, square, factor_square = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, RANK), 1e-4)
    powers = Powers()
    parts = [(rows_of(t, powers), y[t.lo:t.hi]) for t in text_slices(texts, 1 << 18)]
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(parts)):
            rows, label = parts[k]
            z, v, s = logits(rows, m)
            g = 1 / (1 + np.exp(-z)) - label
            counts = np.diff(rows.off)
            each = np.repeat(g, counts) * rows.weight
            order = np.argsort(rows.index, kind="stable")
            index = rows.index[order]
            first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
            at = index[first]
            d = np.add.reduceat(each[order], first) + DECAY * m.linear[at]
            square[at] += d * d
            m.linear[at] -= RATE * d / np.sqrt(square[at])
            dv = each[:, None] * (np.repeat(s, counts, axis=0) - v)
            d = np.add.reduceat(dv[order], first, axis=0) + DECAY * m.factors[at]
            factor_square[at] += d * d
            m.factors[at] -= RATE * d / np.sqrt(factor_square[at])
            d = g.sum()
            bias_square += d * d
            m.bias -= RATE * d / np.sqrt(bias_square)
    return Model(float(m.bias), m.linear.astype(np.float32), m.factors.astype(np.float32))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2.4 MB, fixed by SIZE and RANK
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, m = Powers(), shared.value
        for batch in batches:
            for t in text_slices(batch.column("text")):
                z, _, _ = logits(rows_of(t, powers), m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(t.lo, len(t)),
                     pa.array(1 / (1 + np.exp(-z.astype(np.float64))))], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def quality(documents: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. The model is fitted on
    at most ``max_fit_rows`` labelled rows that are not held out."""
    model = fit(*fit_sample(documents, labels, "quality", max_fit_rows))
    return scored(documents, model).select(
        "doc_id", is_held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
