"""Line-first cleaning by rules.

Each line (split at line feeds) with a word is judged on its own: it fails
if no word of it ends in terminal punctuation, as navigation (many separators),
for symbols or exclamation marks on many words, or with a boilerplate phrase. Failing
lines are removed; then a document that lost too large a share of its words is
rejected. Before that, documents with too few words or too many repeated
3-word windows fail the base rules.

Words are runs of characters other than space and 0x09-0x0D. Case counts except
in boilerplate phrases.

Defined results: null texts count as empty; a text without words has all counts
0 and fails the base rules; repeated rows are judged alike; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelscope.llm.batches import Powers, range_hash, text_slices, window_hashes, words_of

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
WINDOW_WORDS = 3
#: A document is rejected when its removed lines hold more of its words than this.
MAX_LOST_PCT = 50
#: A line is navigation with this many separators and this share of its words.
MIN_SEPARATORS, MIN_SEPARATOR_PCT = 3, 10
#: A line fails when more than this share of its words carries a symbol, or ends in "!!".
MAX_SYMBOL_PCT, MAX_SHOUT_PCT = 30, 30

# Fixed values.
SYMBOLS = "#*$%&|<>"
TERMINAL = (".", "!", "?", "\"", "'", ")", ":", ";", "…", "”", "’", "»", "。", "！", "？")
SEPARATORS = ("|", ">", "»", "·", "•", "/")
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript",
    "log in to", "lorem ipsum", "privacy policy", "read more", "sign in to", "sign up for",
    "subscribe to our", "terms of service", "terms of use", "use of cookies",
)

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray) -> np.ndarray:
    """Running counts: entry i is the number of set flags before i."""
    return np.concatenate([[0], np.cumsum(flags)])


def _first_seen(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each entry, whether no earlier one of its text has its hash."""
    order = np.lexsort((h, doc))  # stable: of equals, the earliest comes first
    d, x = doc[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    out = np.empty(len(x), bool)
    out[order] = new
    return out


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each entry, whether another one of its text has its hash."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    same = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
    hit = np.zeros(len(x), bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.empty(len(x), bool)
    out[order] = hit
    return out


def _ends_in(buf: np.ndarray, start: np.ndarray, end: np.ndarray, endings: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(len(end), bool)
    for text in endings:
        raw = text.encode()
        hit = end - start >= len(raw)
        for k, byte in enumerate(reversed(raw)):
            hit &= buf[np.maximum(end - 1 - k, 0)] == byte
        out |= hit
    return out


def judge(t, powers: Powers) -> dict[str, np.ndarray]:
    """Counts and verdicts of the texts of a slice, and the byte ranges of
    their removed lines (``bad_doc``, ``bad_start``, ``bad_end``)."""
    n, buf = len(t), t.buf
    words = words_of(t, powers, lower=False)
    total = words.per_doc(n)
    symbol = np.isin(buf, np.frombuffer(SYMBOLS.encode(), np.uint8))
    lead = _sums((buf & 0xC0) != 0x80)
    symbols = _sums(symbol)

    # 3-word windows
    at, h = window_hashes(words, WINDOW_WORDS)
    covered = np.zeros(len(words.doc), bool)
    again = at[_repeated(words.doc[at], h)]
    for k in range(WINDOW_WORDS):
        covered[again + k] = True

    # lines: between line feeds and the ends of texts
    feeds = np.flatnonzero(buf == 10)
    ends = np.unique(np.concatenate([feeds, t.off[1:]]))
    line_of = np.searchsorted(ends, words.start, side="right")
    first = np.flatnonzero(np.append(True, line_of[1:] != line_of[:-1])) if len(line_of) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(line_of)) - 1 if len(first) else first
    doc = words.doc[first]
    line_end = ends[line_of[first]]
    before = ends[np.maximum(line_of[first] - 1, 0)]  # a line feed, or the end of the text before
    line_start = np.where(line_of[first] > 0, before + (buf[np.minimum(before, max(len(buf) - 1, 0))] == 10), 0) \
        if len(first) else first
    line_start = np.maximum(line_start, t.off[doc])
    n_in = last - first + 1
    dup = ~_first_seen(doc, range_hash(words.prefix, line_start, line_end, powers))

    size = words.end - words.start
    per_line = lambda flags: np.add.reduceat(flags.astype(np.int64), first) if len(first) else first
    separator = np.zeros(len(size), bool)
    for s in SEPARATORS:
        raw = s.encode()
        separator |= (size == len(raw)) & _ends_in(buf, words.start, words.end, (s,))
    n_sep = per_line(separator)
    n_symbol = per_line(symbols[words.end] > symbols[words.start])
    n_shout = per_line(_ends_in(buf, words.start, words.end, ("!!",)))
    bad = per_line(_ends_in(buf, words.start, words.end, TERMINAL)) == 0
    bad |= (n_sep >= MIN_SEPARATORS) & (100 * n_sep >= MIN_SEPARATOR_PCT * n_in)
    bad |= (100 * n_symbol > MAX_SYMBOL_PCT * n_in) | (100 * n_shout > MAX_SHOUT_PCT * n_in)
    phrase = re.compile("|".join(map(re.escape, BOILERPLATE)).encode(), re.IGNORECASE)
    hits = np.array([m.span() for m in phrase.finditer(buf.tobytes())], np.int64).reshape(-1, 2)
    if len(hits) and len(first):
        line = np.searchsorted(line_start, hits[:, 0], side="right") - 1
        line, stop = line[line >= 0], hits[:, 1][line >= 0]
        bad[line[stop <= line_end[line]]] = True

    lost = np.bincount(doc, weights=n_in * bad, minlength=n).astype(np.int64)
    repeat = np.bincount(words.doc, weights=covered, minlength=n).astype(np.int64)
    base_failed = (total < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PCT * total)
    return {
        "n_words": total,
        "word_chars": np.bincount(words.doc, weights=lead[words.end] - lead[words.start], minlength=n).astype(np.int64),
        "n_symbols": symbols[t.off[1:]] - symbols[t.off[:-1]],
        "n_dup_lines": np.bincount(doc, weights=dup, minlength=n).astype(np.int64),
        "n_repeat_words": repeat, "base_failed": base_failed, "n_lost_words": lost,
        "kept": ~base_failed & (100 * lost <= MAX_LOST_PCT * total),
        "bad_doc": doc[bad], "bad_start": line_start[bad], "bad_end": line_end[bad],
    }


def _without(raw: bytes, ranges: list[tuple[int, int]]) -> str:
    """The text without the lines at ``ranges`` and their line feeds."""
    out, at = [], 0
    for a, b in ranges:
        out.append(raw[at:a])
        at = b + 1
    out.append(raw[at:])
    return b"".join(out).decode()


def cleaned(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """Counts and verdict of every row; with ``with_text`` the text without
    its failing lines as ``clean_text``."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    counts = (*COLUMNS, "n_lost_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for t in text_slices(batch.column("text")):
                found = judge(t, powers)
                columns = {"doc_id": batch.column("doc_id").slice(t.lo, len(t))}
                columns |= {c: pa.array(found[c].astype(np.int64)) for c in counts}
                columns |= {c: pa.array(found[c]) for c in ("base_failed", "kept")}
                if with_text:
                    cut = np.searchsorted(found["bad_doc"], np.arange(len(t) + 1))
                    columns["clean_text"] = pa.array([_without(t.raw(i), [
                        (int(a - t.off[i]), int(b - t.off[i])) for a, b in zip(
                            found["bad_start"][cut[i]:cut[i + 1]], found["bad_end"][cut[i]:cut[i + 1]])])
                        for i in range(len(t))])
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in counts) + \
        ", base_failed boolean, kept boolean" + (", clean_text string" if with_text else "")
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def quality_rules(documents: DataFrame) -> DataFrame:
    """Counts and verdict of every row, without texts."""
    return cleaned(documents, with_text=False)
