"""Byte-level BPE encoding and decoding with forced boundaries.

Merges only ever build vocabulary tokens. A byte pair that occurs inside no
token can therefore never be joined: it is a certain cut, and the fragments on
both sides are encoded independently and concatenated. Before that, a text is
split at its special tokens and by the tokenizer's own pattern; a change from a
non-space to a space always ends a match of the pattern, so such units are
looked up whole, and only a unit not seen before goes through pattern, cuts
and merges.

Defined results: a null or empty text has no ids and decodes to the empty text;
ids that do not form UTF-8 decode with replacement characters; repeated rows
are encoded alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.batches import text_slices

# The public pattern of this tokenizer family, and Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\t-\r \x85\xa0  -     　"
#: Units remembered by a task before it starts afresh.
MEMO_UNITS = 250_000
LONG_FRAGMENT = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself where it is
    printable, else the next free one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Vocabulary:
    """What a tokenizer file says; its size is that of the file."""
    ids: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair of ids -> rank, id of the whole
    special: dict[str, int]
    joined: frozenset[tuple[int, int]] = field(repr=False)  # byte pairs inside some token

    def tokens(self) -> list[bytes]:
        """Bytes of each id."""
        out = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for raw, i in self.ids.items():
            out[i] = raw
        for text, i in self.special.items():
            out[i] = text.encode()
        return out


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter = byte_letters()
    raw = lambda s: bytes(letter[c] for c in s)
    special = {}
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token with flags: {t}")
        special[t["content"]] = t["id"]
    if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" \
            or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a plain byte-level tokenizer")
    ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    merges = {}
    for rank, m in enumerate(spec["model"]["merges"]):
        a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
        merges[ids[a], ids[b]] = (rank, ids[a + b])
    return Vocabulary(ids, merges, special, frozenset(p for t in ids for p in zip(t, t[1:])))


def fragments(raw: bytes, joined: frozenset[tuple[int, int]]) -> list[bytes]:
    """``raw`` cut at every byte pair that no token contains."""
    pairs = list(zip(raw, raw[1:]))
    if joined.issuperset(pairs):
        return [raw]
    at = [i for i, p in enumerate(pairs, 1) if p not in joined]
    return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)])]


def merged(parts: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left."""
    if len(parts) > LONG_FRAGMENT:
        return merged_long(parts, merges)
    none = (1 << 60, 0)
    found = [merges.get(p, none) for p in zip(parts, parts[1:])]
    while found:
        best = min(found)
        if best is none:
            break
        i = found.index(best)
        parts[i:i + 2] = [best[1]]
        del found[i]
        if i:
            found[i - 1] = merges.get((parts[i - 1], best[1]), none)
        if i < len(found):
            found[i] = merges.get((best[1], parts[i + 1]), none)
    return parts


def merged_long(parts: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same with a linked list and a heap: n log n."""
    parts = list(parts)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = []

    def push(i: int, j: int) -> None:
        if (m := merges.get((parts[i], parts[j]))) is not None:
            heapq.heappush(heap, (m[0], i, m[1], parts[i], parts[j]))

    for i in range(len(parts) - 1):
        push(i, i + 1)
    while heap:
        _, i, whole, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue  # one of the two was merged meanwhile
        parts[i], parts[j] = whole, -1
        k = after[i] = after[j]
        if k < len(parts):
            before[k] = i
            push(i, k)
        if before[i] >= 0:
            push(before[i], i)
    return [p for p in parts if p >= 0]


class Encoder:
    """Encodes texts; remembers the ids of units and of fragments."""

    def __init__(self, v: Vocabulary, memo_units: int = MEMO_UNITS) -> None:
        self.v, self.memo_units = v, memo_units
        self.units: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.byte_ids = [v.ids[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(PATTERN)
        self.word = re.compile(" ?[A-Za-z]+").fullmatch  # a unit that is one match of the pattern
        self.unit = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.special = regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")") if v.special else None

    def fragment(self, raw: bytes) -> bytes:
        out = self.pieces.get(raw)
        if out is None:
            if len(self.pieces) >= self.memo_units:
                self.pieces.clear()
            out = self.pieces[raw] = array("i", merged([*map(self.byte_ids.__getitem__, raw)], self.v.merges)).tobytes()
        return out

    def new_unit(self, text: str) -> bytes:
        words = [text] if self.word(text) else self.pattern.findall(text)
        out = b"".join([self.fragment(f) for word in words for f in fragments(word.encode(), self.v.joined)])
        if len(self.units) >= self.memo_units:
            self.units.clear()
        self.units[text] = out
        return out

    def plain(self, text: str) -> bytes:
        get, new = self.units.get, self.new_unit
        return b"".join([get(u) or new(u) for u in self.unit.findall(text)])

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return b"".join(np.int32(self.v.special[s]).tobytes() if s in self.v.special else self.plain(s)
                        for s in self.special.split(text))


def _lists(ends: list[int], values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.array([0, *ends], np.int32)), pa.array(values))


def _encoder(v: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(v)
    for batch in batches:
        for t in text_slices(batch.column("text")):
            found = [encoder.encode(t.raw(i).decode()) for i in range(len(t))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(t.lo, len(t)),
                 _lists(np.cumsum([len(f) // 4 for f in found]).tolist(),
                        np.frombuffer(b"".join(found), np.int32))], names=["doc_id", "ids"])


def _decoder(tokens: list[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    token = tokens.__getitem__
    for batch in batches:
        ids = batch.column("ids")
        values, off = ids.values.to_numpy().tolist(), ids.offsets.to_numpy().tolist()
        text = [b"".join(map(token, values[a:b])).decode(errors="replace") for a, b in zip(off, off[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), ids, pa.array(text, pa.string())], names=["doc_id", "ids", "decoded"])


def _schema(df: DataFrame) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>"


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every text, with the tokenizer file at ``path`` (read
    by the driver; executors get its tables by broadcast, bounded by the file)."""
    shared = documents.sparkSession.sparkContext.broadcast(load(path))
    return documents.select("doc_id", "text").mapInArrow(lambda b: _encoder(shared.value, b), _schema(documents))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and the text they stand for as ``decoded``."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path).tokens())
    return encoded.select("doc_id", "ids").mapInArrow(
        lambda b: _decoder(shared.value, b), _schema(encoded) + ", decoded string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; encoder and
    decoder share a Python worker."""
    shared = documents.sparkSession.sparkContext.broadcast(load(path))
    both = documents.select("doc_id", "text").mapInArrow(
        lambda b: _decoder(shared.value.tokens(), _encoder(shared.value, b)),
        _schema(documents) + ", decoded string")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
