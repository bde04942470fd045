"""Token counts by a two-tier lookup of pre-token lengths.

A text's count is the sum of the token counts of its pre-tokens (the matches
of the tokenizer's pattern). Tasks find all pre-tokens of a slice at once as
positions in one array of code points and hash them; the distinct ones are
looked up in a broadcast table of frequent pre-tokens (two 64-bit hashes and a
length each, sorted, of bounded size), and what is missing there is encoded
once and remembered by the Python worker, over all its tasks. Pre-tokens never
leave the task that reads them: no shuffle.

The table is made from a sample of about ``SAMPLE_ROWS`` rows. Only speed
depends on it, never a count.

Defined results: a null or empty text has 0 bytes and 0 tokens; special tokens
inside a text count one each, as the library's default has it; repeated rows
are counted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelscope.llm.batches import Powers, Texts, mix, range_hash, text_slices
from panelscope.llm.bpe import Vocabulary, fragments, load, merged

LIMIT_TOKENS = 512
#: Rows (about) whose pre-tokens fill the table, entries taken of each, entries of the table.
SAMPLE_ROWS = 1_024
ENTRIES_PER_ROW = 256
TABLE_ENTRIES = 16_384
#: Pre-tokens remembered by a worker before it starts afresh.
CACHE_ENTRIES = 250_000
#: Longer pre-tokens are told apart by their characters, not by their hashes.
HASHED_CHARS = 256
#: Texts are worked on in pieces of about this many bytes.
PIECE_BYTES = 1 << 22

OTHER, LETTER, NUMBER, SPACE = range(4)
_CODES = 0x110000
_QUOTE, _BLANK = 0x27, 0x20
# What follows the quote of a contraction in the public pattern.
_ONE_LETTER = "stmd"
_TWO_LETTERS = ("re", "ve", "ll")


def code_classes() -> np.ndarray:
    """The pattern's class of every code point."""
    table = np.zeros(_CODES, np.uint8)
    for lo in range(0, _CODES, 1 << 16):
        block = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(lo, lo + (1 << 16)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, block):
                table[lo + m.start():lo + m.end()] = kind
    return table


def match_starts(cp: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a match of the pattern begins. ``first`` marks the first
    code point of each piece and has one entry more, for the end."""
    n = len(cp)
    inner = ~first[1:n]  # whether point i + 1 goes on in the piece of point i
    begin = first[:n].copy()
    begin[1:] |= cls[1:] != cls[:-1]
    # of the white space before a word, the last character goes apart; a blank joins the word
    last = np.zeros(n, bool)
    last[:-1] = (cls[:-1] == SPACE) & (cls[1:] != SPACE) & inner
    begin |= last
    begin[1:] &= ~(last & (cp == _BLANK))[:-1]
    quote = np.flatnonzero(begin[:-1] & (cp[:-1] == _QUOTE) & inner)
    a = cp[quote + 1]
    third = np.minimum(quote + 2, n - 1)
    b = np.where((quote + 2 < n) & ~first[third], cp[third], 0)
    size = np.where(np.isin(a, [ord(c) for c in _ONE_LETTER]), 2, 0)
    for x, y in _TWO_LETTERS:
        size[(a == ord(x)) & (b == ord(y))] = 3
    quote, size = quote[size > 0], size[size > 0]
    begin[quote + 1] = False
    behind = quote + size
    begin[behind[behind < n]] = True
    return begin


@dataclass
class Lengths:
    """The broadcast table, the tokenizer for what it misses, and the worker's
    own cache. Spark keeps one copy in each Python worker."""
    vocabulary: Vocabulary
    key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # ascending
    check: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    length: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cache: dict[str, int] = field(default_factory=dict)
    cache_entries: int = CACHE_ENTRIES
    classes: np.ndarray | None = None
    powers: Powers | None = None
    special: regex.Pattern | None = None

    def ready(self) -> Lengths:
        if self.classes is None:
            self.classes, self.powers = code_classes(), Powers()
            names = sorted(self.vocabulary.special, key=len, reverse=True)
            self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
            self.byte_ids = [self.vocabulary.ids[bytes([b])] for b in range(256)]
        return self

    def tokens_of(self, pre_token: str) -> int:
        found = self.cache.get(pre_token)
        if found is None:
            if len(self.cache) >= self.cache_entries:
                self.cache.clear()
            found = self.cache[pre_token] = sum(
                len(merged([self.byte_ids[b] for b in f], self.vocabulary.merges))
                for f in fragments(pre_token.encode(), self.vocabulary.joined))
        return found


@dataclass
class PreTokens:
    """Pre-tokens of a slice: text index, start and end in ``chars``, hashes;
    ``extra`` counts the special tokens of each text."""
    chars: str
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    second: np.ndarray
    extra: np.ndarray


def pieces(t: Texts, limit: int = PIECE_BYTES) -> Iterator[Texts]:
    """The slice, or a single long text in pieces that end where a character is
    followed by a blank (no match of the pattern goes over that)."""
    raw = t.buf.tobytes()
    if len(t) != 1 or len(raw) <= limit:
        yield t
        return
    at, cut = 0, regex.compile(rb"[!-~] ")
    while at < len(raw):
        m = cut.search(raw, at + limit)
        to = m.start() + 1 if m else len(raw)
        yield Texts(t.lo, t.hi, t.buf[at:to], np.array([0, to - at]))
        at = to


def pre_tokens(t: Texts, table: Lengths) -> PreTokens:
    chars = t.buf.tobytes().decode()
    cp = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
    n = len(cp)
    # code points before each byte offset
    points = np.zeros(len(t.buf) + 1, np.int64)
    np.cumsum((t.buf & 0xC0) != 0x80, out=points[1:])
    off = points[t.off]
    first = np.zeros(n + 1, bool)
    first[off] = True
    extra = np.zeros(len(t), np.int64)
    named = [(m.start(), m.end()) for m in table.special.finditer(chars)] if table.special else []
    if named:
        # a match over the edge of two texts is none
        lo, hi = np.array(named).T
        doc = np.searchsorted(off, lo, side="right") - 1
        whole = hi <= off[doc + 1]
        lo, hi, doc = lo[whole], hi[whole], doc[whole]
        np.add.at(extra, doc, 1)
        first[lo] = first[hi] = True
    if not n:
        none = np.zeros(0, np.int64)
        return PreTokens(chars, none, none, none, none.astype(np.uint64), none.astype(np.uint64), extra)
    start = np.flatnonzero(match_starts(cp, table.classes[cp], first))
    end = np.append(start[1:], n)
    if named:
        keep = np.ones(len(start), bool)
        inside = np.searchsorted(lo, start, side="right") - 1
        keep[(inside >= 0) & (start < hi[np.maximum(inside, 0)])] = False
        start, end = start[keep], end[keep]
    up, _ = table.powers.upto(n + 1)
    hashes = []
    for value in (cp.astype(np.uint64) + np.uint64(1), mix(cp.astype(np.uint64) + np.uint64(0x1F2E3D4C5B6A7988))):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(value * up[:n], out=prefix[1:])
        hashes.append(range_hash(prefix, start, end, table.powers))
    return PreTokens(chars, np.searchsorted(off, start, side="right") - 1, start, end, *hashes, extra)


def lengths_of(p: PreTokens, table: Lengths) -> np.ndarray:
    """Tokens of each pre-token."""
    key, at, back = np.unique(p.first, return_index=True, return_inverse=True)
    found = np.full(len(key), -1, np.int64)
    if len(table.key):
        pos = np.minimum(np.searchsorted(table.key, key), len(table.key) - 1)
        hit = (table.key[pos] == key) & (table.check[pos] == p.second[at])
        found[hit] = table.length[pos[hit]]
    short = p.end - p.start <= HASHED_CHARS
    for i in np.flatnonzero((found < 0) & short[at]).tolist():
        found[i] = table.tokens_of(p.chars[p.start[at[i]]:p.end[at[i]]])
    out = found[back]
    # long ones, and those whose first hash agrees with another's, one by one
    for i in np.flatnonzero(~short | (p.second != p.second[at][back]) | (out < 0)).tolist():
        out[i] = table.tokens_of(p.chars[p.start[i]:p.end[i]])
    return out


def counts_of(t: Texts, table: Lengths) -> np.ndarray:
    total = np.zeros(len(t), np.int64)
    for piece in pieces(t):
        p = pre_tokens(piece, table)
        np.add.at(total, p.doc, lengths_of(p, table))
        total += p.extra
    return total


def frequent(documents: DataFrame, table: Lengths, rows: int = SAMPLE_ROWS,
             entries: int = TABLE_ENTRIES) -> Lengths:
    """``table`` with the most frequent pre-tokens of about ``rows`` rows, of
    which each gives at most ``ENTRIES_PER_ROW``."""
    n = documents.count()
    if not n:
        return table
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.ready()
        for batch in batches:
            for t in (piece for whole in text_slices(batch.column("text")) for piece in pieces(whole)):
                names, counts = [], []
                p = pre_tokens(t, own)
                edge = np.searchsorted(p.doc, np.arange(len(t) + 1))
                for a, b in zip(edge[:-1], edge[1:]):
                    got = Counter(p.chars[s:e] for s, e in zip(p.start[a:b], p.end[a:b]) if e - s <= HASHED_CHARS)
                    for name, c in got.most_common(ENTRIES_PER_ROW):
                        names.append(name)
                        counts.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())],
                                                 names=["pre_token", "n"])

    # bounded: rows * ENTRIES_PER_ROW entries (a row of more than PIECE_BYTES gives as many for each piece)
    sample = documents.select("text").sample(min(1.0, rows / n), seed=11)
    total: Counter = Counter()
    for name, c in zip(*sample.mapInArrow(run, "pre_token string, n long").toArrow().to_pydict().values()):
        total[name] += c
    chosen = sorted(sorted(total), key=total.__getitem__, reverse=True)[:entries]
    if not chosen:
        return table
    table.ready()
    raw = [name.encode() for name in chosen]
    p = pre_tokens_as_given(raw, table)
    key, at = np.unique(p.first, return_index=True)
    return Lengths(table.vocabulary, key, p.second[at],
                   np.array([table.tokens_of(chosen[i]) for i in at], np.int64), cache_entries=table.cache_entries)


def pre_tokens_as_given(raw: list[bytes], table: Lengths) -> PreTokens:
    """Hashes of whole byte strings, each taken as one pre-token."""
    sizes = np.array([len(r.decode()) for r in raw], np.int64)
    end = np.cumsum(sizes)
    chars = b"".join(raw).decode()
    cp = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.uint64)
    up, _ = table.powers.upto(len(cp) + 1)
    hashes = []
    for value in (cp + np.uint64(1), mix(cp + np.uint64(0x1F2E3D4C5B6A7988))):
        prefix = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(value * up[:len(cp)], out=prefix[1:])
        hashes.append(range_hash(prefix, end - sizes, end, table.powers))
    return PreTokens(chars, np.arange(len(raw)), end - sizes, end, *hashes, np.zeros(len(raw), np.int64))


def token_counts(documents: DataFrame, path: str, limit_tokens: int = LIMIT_TOKENS,
                 sample_rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, by the tokenizer file
    at ``path`` (read by the driver)."""
    table = frequent(documents, Lengths(load(path)), sample_rows, entries)
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.ready()
        for batch in batches:
            for t in text_slices(batch.column("text")):
                n = counts_of(t, own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(t.lo, len(t)), pa.array(t.sizes), pa.array(n),
                     pa.array(n > limit_tokens)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
