"""Substring deduplication with FM-indexes: words of passages that start in an earlier document go.

A window of 13 words is removed if its words also start in a document with a smaller id. The text
that can hold such windows is indexed in shards, each an FM-index over a wavelet matrix of word numbers,
and documents are streamed past the shards by backward search: a window's interval tells all its
occurrences, and the smallest document of the interval decides.

So that no document has to be searched in every shard, text is dealt to shards by content. A window's
anchor is the smallest hash among its runs of about six words; equal windows have equal anchors.
1. Documents are dealt to buckets of a few MB. Every bucket lists its anchors.
2. An anchor that occurs in one document only can't hold a repeated window. The others go back to
   their buckets, marked if very frequent.
3. A bucket cuts the texts around shared anchors into segments (all windows of one anchor in a row),
   lists equal segments once with their smallest document, and deals them to the shard of the anchor.
   Around a very frequent anchor each window is dealt by its own hash, so a common line spreads
   over all shards.
4. A shard builds the index of its segments, searches every segment's windows in it, and answers with
   the smallest document of each window that occurs twice or more.
5. The bucket removes the words of windows whose smallest document is smaller than their own.

A null ``doc_id`` neither removes nor loses words; rows with one id are one document to each other
(no row is smaller). Null text has no words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import text_bytes
from tessera.llm.words import Words, column, joined, mix, split_words, text_buffers

WINDOW = 13
#: Words of an anchor in corpora of up to 100 GB; one more for every factor of 32, so that words meet by
#: chance as rarely in a large corpus. The length changes how text is dealt, never what is found.
ANCHOR = 6
BUCKET_BYTES = 8 << 20
ANCHORS_PER_GROUP = 1 << 20
#: An anchor in more documents than this deals its windows one by one.
FREQUENT = 5000

_U = np.uint64
_NO_DOC = np.iinfo(np.int64).max


# -- the index ---------------------------------------------------------------------------------


class WaveletMatrix:
    """Ranks over a sequence of numbers, one bit vector per binary digit (packed, counts per 64 bits)."""

    def __init__(self, seq: np.ndarray, top: int):
        self.n = len(seq)
        self.bits = max(1, int(top).bit_length())
        self.zeros: list[int] = []
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(64 + -len(bit) % 64, np.uint8)), bitorder="little").view(_U)
            self.words.append(packed)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(packed)))[:-1].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (_U(1) << (at & 63).astype(_U)) - _U(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & low)

    def ranks(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, lo), self._ones(level, at)
            lo = np.where(one, self.zeros[level] + a, lo - a)
            at = np.where(one, self.zeros[level] + b, at - b)
        return at - lo


class FMIndex:
    """FM-index of word sequences. Suffixes are sorted by their first 16 words, which is all that a
    backward search of at most 16 words needs."""

    DEPTH = 16

    def __init__(self, text: np.ndarray, top: int):
        """text: word numbers from 1, with 0 after every sequence."""
        self.text = text
        n = len(text)
        rank = text.astype(np.int64)
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - step)] = rank[step:]
            ahead[: max(0, n - step)] += 1
            key = rank << 32 | ahead
            order = np.argsort(key, kind="stable") if n < 2 else np.argsort(key)
            in_order = key[order]
            new = np.append(0, np.cumsum(in_order[1:] != in_order[:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if step >= self.DEPTH or (n and new[-1] == n - 1):
                break
        self.sa = order
        self.first = np.searchsorted(text[order], np.arange(top + 2))
        self.bwt = WaveletMatrix(text[order - 1], top)

    def search(self, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the ``length`` words of the text that end before ``end``, by backward search. A
        search stops at an interval of one suffix: nothing else matches it."""
        symbol = self.text[end - 1]
        lo, hi = self.first[symbol].astype(np.int64), self.first[symbol + 1].astype(np.int64)
        live = np.flatnonzero(hi - lo > 1)
        for j in range(2, length + 1):
            if not len(live):
                break
            symbol = self.text[end[live] - j]
            both = self.bwt.ranks(np.concatenate([symbol, symbol]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.first[symbol] + both[: len(live)], self.first[symbol] + both[len(live):]
            live = live[hi[live] - lo[live] > 1]
        return lo, hi


# -- anchors and segments ----------------------------------------------------------------------


def anchor_words(size: int) -> int:
    """Words of an anchor for a corpus of ``size`` bytes."""
    return min(WINDOW - 2, ANCHOR + max(0, (size.bit_length() - 32) // 5))


def _anchors(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window."""
    at, h = w.windows(k)
    full = np.full(len(w.hash), ~_U(0))
    full[at] = h
    at, _ = w.windows(WINDOW)
    if not len(at):
        return at, np.empty(0, _U)
    low = full[: len(full) - (WINDOW - k)].copy()
    for j in range(1, WINDOW - k + 1):
        np.minimum(low, full[j : len(full) - (WINDOW - k) + j], out=low)
    return at, low[at]


def _bucket(table: pa.Table) -> tuple[Words, np.ndarray, pa.Table]:
    """Words of a bucket's documents and their ids, in an order that is the same each time."""
    table = table.combine_chunks()
    ids = column(table, "doc_id")
    known = ids.fill_null(_NO_DOC).to_numpy()
    off, raw = text_buffers(column(table, "text"))
    return split_words(off, raw), known, table


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of hashes begins in the sorted keys, and the end."""
    at = (np.arange(n, dtype=object) * (2**64 // n)).astype(_U)
    return np.append(np.searchsorted(keys, at), len(keys))


def _list_anchors(groups: int, k: int):
    def run(key, table):
        w, ids, _ = _bucket(table)
        at, anchor = _anchors(w, k)
        new = np.ones(len(at), bool)
        owner = w.text_of()[at] if len(at) else at
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        anchor, doc = anchor[new], ids[owner[new]]
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        keep = doc != _NO_DOC
        anchor, doc = anchor[keep], doc[keep]
        start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.empty(0, np.int64)
        stop = np.append(start[1:], len(anchor))
        one = np.where(doc[start] == doc[stop - 1], 1, 2).astype(np.int32) if len(start) else np.empty(0, np.int32)
        count = np.where(one == 1, 1, stop - start).astype(np.int32)
        anchor = anchor[start]
        cut = _cuts(anchor, groups)
        rows = [[i, key[0].as_py(), anchor[a:b].tobytes(), count[a:b].tobytes()]
                for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                        names=["part", "bucket", "anchors", "counts"])
    return run


def _share_anchors(table: pa.Table) -> pa.Table:
    """Anchors in two documents or more, back to every bucket that listed them."""
    buckets = table.column("bucket").to_numpy()
    lists = [np.frombuffer(x, _U) for x in table.column("anchors").to_pylist()]
    anchor = np.concatenate(lists)
    count = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    value, which = np.unique(anchor, return_inverse=True)
    total = np.bincount(which, weights=count, minlength=len(value))
    # rows of one document share a bucket, so two buckets are two documents
    other = total > 1
    out = []
    first = np.append(0, np.cumsum([len(x) for x in lists]))
    for i, b in enumerate(buckets.tolist()):
        mine = which[first[i] : first[i + 1]]
        ok = other[mine]
        if ok.any():
            out.append((b, value[mine[ok]].tobytes(), (total[mine[ok]] > FREQUENT).tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()), strict=True)],
                    names=["bucket", "anchors", "frequent"])


def _segments(w: Words, ids: np.ndarray, shared: np.ndarray, frequent: np.ndarray, k: int):
    """(first window, windows, key) of each segment: consecutive windows around one shared anchor."""
    at, anchor = _anchors(w, k)
    if not len(at) or not len(shared):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, _U),)
    found = np.searchsorted(shared, anchor)
    found[found == len(shared)] = 0
    ok = (shared[found] == anchor) & (ids[w.text_of()[at]] != _NO_DOC)
    at, anchor, often = at[ok], anchor[ok], frequent[found[ok]]
    if not len(at):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, _U),)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | often[1:]
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(at)))
    own = np.zeros(len(w.hash), _U)
    place, h = w.windows(WINDOW)
    own[place] = h
    return at[start], n, np.where(often[start], own[at[start]], mix(anchor[start]))


def _cut_segments(shards: int, k: int):
    def run(key, docs, answers):
        names = ["shard", "bucket", "lengths", "alphabet", "words", "least", "many"]
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 5
        empty = pa.table([pa.array([], t) for t in kinds], names=names)
        if not docs.num_rows or not answers.num_rows:
            return empty
        w, ids, _ = _bucket(docs)
        shared = np.concatenate([np.frombuffer(x, _U) for x in answers.column("anchors").to_pylist()])
        frequent = np.concatenate([np.frombuffer(x, bool) for x in answers.column("frequent").to_pylist()])
        order = np.argsort(shared)
        at, n, to = _segments(w, ids, shared[order], frequent[order], k)
        if not len(at):
            return empty
        # equal segments once, with their smallest document and whether there is another
        length = n + WINDOW - 1
        value = _segment_keys(w.hash, at, length)
        doc = ids[w.text_of()[at]]
        order = np.lexsort((doc, value, to))
        at, length, to, value, doc = at[order], length[order], to[order], value[order], doc[order]
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (to[1:] != to[:-1])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(at))
        many = doc[start] != doc[stop - 1]
        at, length, to, doc = at[start], length[start], to[start], doc[start]
        cut = _cuts(to, shards)
        rows = []
        for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if b > a:
                alphabet, number = np.unique(w.hash[_spread(at[a:b], length[a:b])], return_inverse=True)
                rows.append((s, key[0].as_py(), length[a:b].astype(np.int32).tobytes(), alphabet.tobytes(), number.astype(_number(len(alphabet))).tobytes(), doc[a:b].tobytes(), many[a:b].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    return run


def _windows_of(h: np.ndarray) -> np.ndarray:
    """The window hash (as of Words.windows) at every word but the last ones."""
    return Words(h, h, h, h, np.array([0, len(h)])).windows(WINDOW)[1]


def _segment_keys(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each run of words ``h[start:start+length]``."""
    base = 0x9E3779B97F4A7C15
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * np.cumprod(np.full(len(h), base, _U)), out=total[1:])
    down = np.cumprod(np.full(len(h) + 1, pow(base, -1, 1 << 64), _U))
    return mix((total[start + length] - total[start]) * down[start] + length.astype(_U))


def _number(n: int) -> type:
    """The type that numbers ``n`` words."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())


def _search_shard(table: pa.Table) -> pa.Table:
    """The smallest document of every window that occurs more than once, for each bucket that asked.

    Equal segments of several buckets are indexed and searched once."""
    col = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
    lengths, least, many = col("lengths", np.int32), col("least", np.int64), col("many", bool)
    asked = np.repeat(table.column("bucket").to_numpy(), [len(x) for x in lengths])
    length, doc, many = np.concatenate(lengths).astype(np.int64), np.concatenate(least), np.concatenate(many)
    alphabets = col("alphabet", _U)
    h = np.concatenate([a[np.frombuffer(x, _number(len(a)))] for a, x in zip(alphabets, table.column("words").to_pylist(), strict=True)])
    start = np.append(0, np.cumsum(length))[:-1]
    _, one, which, times = np.unique(_segment_keys(h, start, length), return_index=True, return_inverse=True, return_counts=True)
    owner = np.full(len(one), _NO_DOC)
    np.minimum.at(owner, which, doc)
    twice = times > 1
    np.logical_or.at(twice, which, many)

    # the index: segments one after another, a 0 behind each
    size = length[one]
    words = h[_spread(start[one], size)]
    alphabet, number = np.unique(words, return_inverse=True)
    of = np.repeat(np.arange(len(one)), size)
    place = np.arange(len(words)) + of
    text = np.zeros(len(words) + len(one), np.int64)
    text[place] = number + 1
    index = FMIndex(text, len(alphabet))
    windows = size - WINDOW + 1
    first = np.append(0, np.cumsum(size))[:-1]
    seg, word = np.repeat(np.arange(len(one)), windows), _spread(first, windows)
    lo, hi = index.search(place[word] + WINDOW, WINDOW)
    # intervals of one length are equal or apart: the smallest document of each
    smallest = owner[seg]
    wide = np.flatnonzero(hi - lo > 1)
    if len(wide):
        left, group = np.unique(lo[wide], return_inverse=True)
        right = np.empty(len(left), np.int64)
        right[group] = hi[wide]
        inside = np.zeros(len(text), np.int64)
        inside[place] = of
        by_suffix = np.append(np.where(text[index.sa] > 0, owner[inside[index.sa]], _NO_DOC), _NO_DOC)
        smallest[wide] = np.minimum.reduceat(by_suffix, np.stack([left, right], axis=1).ravel())[::2][group]
    value = _windows_of(words)[word]

    # every bucket hears of the windows of its segments that another document may have first
    base = np.append(0, np.cumsum(windows))[:-1]
    n = windows[which]
    back = _spread(base[which], n)
    ask = np.repeat(np.arange(len(which)), n)
    news = (smallest[back] < doc[ask]) | many[ask]
    to, value, smallest = asked[ask[news]], value[back[news]], smallest[back[news]]
    order = np.lexsort((smallest, value, to))
    to, value, smallest = to[order], value[order], smallest[order]
    new = np.ones(len(to), bool)
    new[1:] = (to[1:] != to[:-1]) | (value[1:] != value[:-1])
    to, value, smallest = to[new], value[new], smallest[new]
    cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.empty(0, np.int64)
    stop = np.append(cut[1:], len(to))
    return pa.table({"bucket": pa.array(to[cut]), "windows": pa.array([value[a:b].tobytes() for a, b in zip(cut, stop, strict=True)], pa.binary()),
                     "least": pa.array([smallest[a:b].tobytes() for a, b in zip(cut, stop, strict=True)], pa.binary())})


def _covered(w: Words, ids: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Words inside a window that starts in a smaller document."""
    if not answers.num_rows:
        return np.zeros(len(w.hash), bool)
    value = np.concatenate([np.frombuffer(x, _U) for x in answers.column("windows").to_pylist()])
    least = np.concatenate([np.frombuffer(x, np.int64) for x in answers.column("least").to_pylist()])
    order = np.lexsort((least, value))
    value, least = value[order], least[order]
    at, h = w.windows(WINDOW)
    k = np.searchsorted(value, h)
    k[k == len(value)] = 0
    own = ids[w.text_of()[at]] if len(at) else at
    hit = at[(value[k] == h) & (least[k] < own) & (own != _NO_DOC)] if len(at) else at
    cover = np.zeros(len(w.hash) + 1, np.int64)
    cover[hit] += 1
    np.add.at(cover, hit + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def _remove(with_text: bool):
    def run(key, docs, answers):
        names = ["doc_id", "n_words", "n_removed", "kept"]
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(),) * 3 + (pa.string(),)], names=names)
        w, ids, table = _bucket(docs)
        gone = _covered(w, ids, answers)
        total = np.append(0, np.cumsum(gone))
        kept = [joined(w, ~gone, i) for i in range(table.num_rows)]
        kept = [x.decode() for x in kept] if with_text else [hashlib.sha256(x).hexdigest() for x in kept]
        return pa.table([column(table, "doc_id"), pa.array(w.counts), pa.array(total[w.first[1:]] - total[w.first[:-1]]), pa.array(kept, pa.string())], names=names)
    return run


def deduplicate(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and ``kept``, the words left joined by one space (or,
    without ``with_text``, the SHA-256 of their UTF-8 in hex)."""
    rows, size = text_bytes(docs)
    buckets = max(1, size // BUCKET_BYTES)
    parts = max(1, size // (25 * ANCHORS_PER_GROUP))  # about one anchor in 25 bytes
    k = anchor_words(size)
    spread = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spread = spread.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(buckets))).otherwise(
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).cast("long"))
    anchors = spread.groupBy("bucket").applyInArrow(_list_anchors(parts, k), "part long, bucket long, anchors binary, counts binary")
    shared = anchors.groupBy("part").applyInArrow(_share_anchors, "bucket long, anchors binary, frequent binary")
    cut = spread.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(
        _cut_segments(buckets, k), "shard long, bucket long, lengths binary, alphabet binary, words binary, least binary, many binary")
    found = cut.groupBy("shard").applyInArrow(_search_shard, "bucket long, windows binary, least binary")
    return spread.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(
        _remove(with_text), "doc_id long, n_words long, n_removed long, kept string")
