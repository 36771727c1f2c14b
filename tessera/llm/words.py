"""Vectorised word splitting and hashing over the buffers of an Arrow string column.

Words are runs of bytes outside a set of ASCII separators, so UTF-8 text can be cut on bytes. A
word's hash is a polynomial over its bytes (random byte values, odd multiplier modulo 2^64) read off
prefix sums and then mixed; a window's hash is a polynomial over its words' hashes. All helpers work
on slices of about ``SLICE_BYTES`` of text, so a task's memory doesn't depend on the batch size Spark
chooses; one document is never split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: Text of a slice where rows travel through a stage whole: temporary arrays take some twenty times as much.
ROW_SLICE_BYTES = 1 << 20
_CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Separators of the lower-cased alphanumeric words: all ASCII but digits and a-z.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, _CHUNK + 4096)
        for k, base in enumerate((_BASE, _BASE_INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a run of texts: byte ranges, hashes, and each text's first word (``first[i+1]`` ends it)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of each run of ``k`` words inside one text."""
        n = len(self.hash)
        if n < k:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        acc = self.hash[: n - k + 1].copy()
        for j in range(1, k):
            acc *= _STEP
            acc += self.hash[j : n - k + 1 + j]
        starts = self.first[:-1]
        ok = np.ones(n, bool)
        for j in range(1, k):  # starts of windows that would run over a text's end
            at = self.first[1:] - j
            ok[at[(at >= starts)]] = False
        ok = ok[: n - k + 1]
        at = np.flatnonzero(ok)
        return at, mix(acc[at])


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null reads as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def split_words(off: np.ndarray, raw: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Words of the texts ``raw[off[i]:off[i+1]]``."""
    data = LOWER[raw] if lower else raw
    inside = ~separators[data]
    if not inside.any():
        z = np.empty(0, np.int64)
        return Words(data, z, z, np.empty(0, np.uint64), np.zeros(len(off), np.int64))
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    h = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + _CHUNK)))
        b0, b1 = int(start[lo]), int(end[hi - 1])
        up, down = _power(b1 - b0 + 1)
        sums = np.zeros(b1 - b0 + 1, np.uint64)
        np.cumsum(_BYTE[data[b0:b1]] * up[: b1 - b0], out=sums[1:])
        s, e = start[lo:hi] - b0, end[lo:hi] - b0
        h[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_BASE)
        lo = hi
    return Words(data, start, end, mix(h), np.searchsorted(start, off))


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """Consecutive parts of a batch of about ``limit`` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    off, _ = text_buffers(col)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield batch.slice(lo, hi - lo)
        lo = hi


def row_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of whole rows (a struct ``row``), with views of the row's ``doc_id`` and ``text`` beside it:
    a text comes to Python once."""
    row = column(batch, "row")
    names = [f.name.lower() for f in row.type]
    doc_id, text = (pc.struct_field(row, [names.index(c)]) for c in ("doc_id", "text"))
    yield from slices(pa.RecordBatch.from_arrays([row, doc_id.cast(pa.int64()), text], names=["row", "doc_id", "text"]), limit=ROW_SLICE_BYTES)


def column(batch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return col


def joined(words: Words, keep: np.ndarray, text: int) -> bytes:
    """The kept words of one text, joined by one space."""
    lo, hi = int(words.first[text]), int(words.first[text + 1])
    k = keep[lo:hi]
    if not k.any():
        return b""
    s, e = words.start[lo:hi][k], words.end[lo:hi][k]
    data = words.data
    # runs of kept words that are neighbours separated by exactly one space are copied in one piece
    single = np.zeros(len(s), bool)
    if len(s) > 1:
        single[1:] = (s[1:] - e[:-1] == 1) & (data[np.minimum(e[:-1], len(data) - 1)] == 0x20)
    begin = np.flatnonzero(~single)
    last = np.append(begin[1:], len(s)) - 1
    return b" ".join(data[a:b].tobytes() for a, b in zip(s[begin].tolist(), e[last].tolist(), strict=True))
