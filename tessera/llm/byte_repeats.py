"""Suffix-array deduplication: bytes of strings of 400 bytes that also start somewhere else go.

Repeats are found in merged Burrows-Wheeler transforms. A symbol is a block of 50 bytes (its 64-bit hash), and every byte
of a text starts a suffix, whose symbols are the blocks from there on; so 8 symbols are 400 bytes.
Each piece of text has its own sorted transform. Transforms are merged without sorting suffixes again: an interleave that is right for
h symbols becomes right for h + 1 by one stable pass over the transforms' symbols (each suffix moves to
its predecessor by the piece's own rank mapping), and where a block of the interleave splits, the
common prefix of its neighbours is known. Blocks of one suffix are left out of later passes. What is still together after 8
passes are the repeated intervals.

No task can merge the whole corpus, so text is dealt to shards by content. A window's anchor is the smallest
hash among its runs of 32 bytes; equal windows have equal anchors.
1. Documents are dealt to buckets of a few MB. Every bucket lists its anchors.
2. Anchors that occur once can't hold a repeated window. The others go back to their buckets, marked if very many different texts hold them.
3. A bucket lists the windows around very frequent anchors by hash, and hears which occur twice.
4. A bucket cuts the texts around shared anchors into segments (all windows of one anchor in a row), lists equal segments once with their
   places, and deals them to the shard of the anchor. Around a very frequent anchor each window that occurs twice is dealt by its own hash,
   so a common line spreads over all shards.
5. A shard makes one transform of the segments of each few buckets, merges them, and tells the buckets the places of repeated windows.
6. The bucket removes their bytes.

Null and empty text has no bytes. ``doc_id`` decides nothing: null or repeated ids and repeated rows are
documents like others. A repeat may overlap itself, in texts of any length. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import text_bytes
from tessera.llm.words import column, mix, text_buffers

WINDOW = 400
SYMBOL = 50
DEPTH = WINDOW // SYMBOL
#: Bytes of an anchor.
GRAM = 32
BUCKET_BYTES = 8 << 20
ANCHORS_PER_GROUP = 1 << 20
#: An anchor in more different segments than this deals its windows one by one.
FREQUENT = 5000
#: Shards for each bucket: small ones, as a merge reaches all over its suffixes.
SHARDS = 4
#: Text of one transform within a shard.
PIECE_BYTES = 1 << 18
_CHUNK = 1 << 17

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F)


# -- hashes of runs of bytes --------------------------------------------------------------------


def _eights(raw: np.ndarray) -> np.ndarray:
    """A mixed hash of the 8 bytes at every place."""
    n = max(0, len(raw) - 7)
    h = np.ndarray((n,), "<u8", np.ascontiguousarray(raw).data, strides=(1,)) * _A if n else np.empty(0, _U)
    h ^= h >> _U(32)
    return h


def _joined(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of runs of two lengths to the hash of the longer run: left[i] and right[i + gap]."""
    n = max(0, len(right) - gap)
    h = left[:n] * _B
    h += right[gap : gap + n]
    h *= _C
    h ^= h >> _U(29)
    return h


def _grams(raw: np.ndarray) -> np.ndarray:
    h = _eights(raw)
    h = _joined(h, h, 8)
    return _joined(h, h, 16)


def _symbols(raw: np.ndarray) -> np.ndarray:
    """The hash of the 50 bytes at every place: of the first 32 and of the last 32 of them."""
    h = _grams(raw)
    return mix(_joined(h, h, SYMBOL - GRAM))


def _window_hashes(raw: np.ndarray) -> np.ndarray:
    h = _grams(raw)
    n = GRAM
    while 2 * n <= WINDOW:
        h, n = _joined(h, h, n), 2 * n
    return mix(_joined(h, h, WINDOW - n))


# -- buckets and anchors ------------------------------------------------------------------------


def _bucket(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """(offsets, bytes, rows) of a bucket's documents in an order that is the same each time: rows of one key are equal."""
    table = table.combine_chunks()
    table = table.take(np.lexsort((column(table, "doc_id").fill_null(0).to_numpy(), column(table, "key").to_numpy())))
    off, raw = text_buffers(column(table, "text"))
    return off, raw, table


def _runs(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor, places) of the runs of consecutive windows of a text that have one anchor.
    ``places``: at how many places windows of the run have the anchor first."""
    span = WINDOW - GRAM + 1
    starts, anchors, at_first = [], [], []
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    valid = np.zeros(len(raw) + 1, np.int8)
    long_ = np.flatnonzero(np.diff(off) >= WINDOW)
    np.add.at(valid, off[long_], 1)
    np.add.at(valid, off[long_ + 1] - WINDOW + 1, -1)
    valid = np.cumsum(valid, dtype=np.int8)[:-1].astype(bool) if len(raw) else np.zeros(0, bool)
    before, was_valid = None, False
    for lo in range(0, max(0, len(raw) - WINDOW + 1), _CHUNK):
        hi = min(lo + _CHUNK, len(raw) - WINDOW + 1)
        gram = _grams(raw[lo : hi + WINDOW - 1])
        low, n = gram, 1
        while 2 * n <= span:
            low, n = np.minimum(low[:-n], low[n:]), 2 * n
        low = np.minimum(low[: hi - lo], low[span - n : span - n + hi - lo])
        ok = valid[lo:hi]
        new = np.empty(hi - lo, bool)
        new[1:] = low[1:] != low[:-1]
        new[0] = before is None or low[0] != before
        new[1:] |= ok[1:] != ok[:-1]
        new[0] |= bool(ok[0]) != was_valid
        new |= cut[lo:hi]
        at = np.flatnonzero(new)
        at_first.append(np.flatnonzero(gram[: hi - lo] == low) + lo)
        starts.append(at + lo)
        anchors.append(low[at])
        before, was_valid = low[-1], bool(ok[-1])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int64)
    start, anchor = np.concatenate(starts), np.concatenate(anchors)
    length = np.diff(np.append(start, max(0, len(raw) - WINDOW + 1)))
    # a window that begins with its anchor, and the next one of the run has it again further on
    begins = np.concatenate(at_first)
    run = np.searchsorted(start, begins, side="right") - 1
    again = begins + 1 < start[run] + length[run]
    keep = valid[start]
    return start[keep], length[keep], anchor[keep], 1 + np.bincount(run[again], minlength=len(start))[keep]


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of hashes begins in the sorted keys, and the end."""
    at = (np.arange(n, dtype=object) * (2**64 // n)).astype(_U)
    return np.append(np.searchsorted(keys, at), len(keys))


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Whether any of the keys differs from the one before it."""
    head = np.ones(len(keys[0]), bool)
    head[1:] = False
    for k in keys:
        head[1:] |= k[1:] != k[:-1]
    return head


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)


_LIST = (["part", "bucket", "hashes", "many", "kinds"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])
_NEWS = (["bucket", "level", "hashes", "frequent"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])


def _listed(bucket: int, parts: int, value: np.ndarray, times: np.ndarray, kind: np.ndarray) -> pa.Table:
    """A bucket's hashes by range: whether each occurs more than once, and in how many kinds of text."""
    order = np.lexsort((kind, value))
    value, times, kind = value[order], times[order], kind[order]
    at = np.flatnonzero(_heads(value)) if len(value) else np.empty(0, np.int64)
    many = np.add.reduceat(times, at) > 1 if len(at) else np.empty(0, bool)
    kinds = np.add.reduceat(_heads(value, kind).astype(np.int32), at) if len(at) else np.empty(0, np.int32)
    value = value[at]
    cut = _cuts(value, parts)
    return _rows([(i, bucket, value[a:b].tobytes(), many[a:b].tobytes(), kinds[a:b].astype(np.int32).tobytes())
                  for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a], *_LIST)


def _list_anchors(parts: int):
    def run(key, table):
        off, raw, _ = _bucket(table)
        start, n, anchor, times = _runs(off, raw)
        # texts of one kind begin and end alike and are of one length: equal segments are
        ends = _at_eights(raw, start) * _A + _at_eights(raw, start + n + WINDOW - 9)
        return _listed(key[0].as_py(), parts, anchor, times, mix(ends) ^ n.astype(_U))
    return run


def _at_eights(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at some places, as numbers."""
    out = np.zeros(len(at), _U)
    for j in range(8):
        out = out << _U(8) | raw[at + j].astype(_U)
    return out


def _share(level: int):
    """Hashes that occur twice or more, back to every bucket that listed them."""
    def run(table):
        buckets = table.column("bucket").to_numpy()
        get = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        lists = get("hashes", _U)
        value, which, among = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared = among > 1
        np.logical_or.at(shared, which, np.concatenate(get("many", bool)))
        kinds = np.bincount(which, weights=np.concatenate(get("kinds", np.int32)), minlength=len(value))
        first, rows = np.append(0, np.cumsum([len(x) for x in lists])), []
        for i, b in enumerate(buckets.tolist()):
            mine = which[first[i] : first[i + 1]]
            mine = mine[shared[mine]]
            if len(mine):
                rows.append((b, level, value[mine].tobytes(), (kinds[mine] > FREQUENT).tobytes()))
        return _rows(rows, *_NEWS)
    return run


def _heard(news: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, whether frequent) that a bucket heard of."""
    picked = [(h, f) for v, h, f in zip(*(news.column(c).to_pylist() for c in ("level", "hashes", "frequent")), strict=True) if v == level]
    value = np.concatenate([np.frombuffer(h, _U) for h, _ in picked]) if picked else np.empty(0, _U)
    often = np.concatenate([np.frombuffer(f, bool) for _, f in picked]) if picked else np.empty(0, bool)
    order = np.argsort(value)
    return value[order], often[order]


def _found(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether x is among the values, where)."""
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())


def _hashes_of(raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Window hashes of runs of windows."""
    return np.concatenate([_window_hashes(raw[s : s + k + WINDOW - 1]) for s, k in zip(start.tolist(), n.tolist(), strict=True)]) if len(start) else np.empty(0, _U)


def _list_windows(parts: int):
    def run(key, docs, news):
        anchor, often = _heard(news, 0)
        if not docs.num_rows or not often.any():
            return _rows([], *_LIST)
        off, raw, _ = _bucket(docs)
        start, n, of, _ = _runs(off, raw)
        hit, at = _found(anchor, of)
        hit &= often[at]
        value = _hashes_of(raw, start[hit], n[hit])
        return _listed(key[0].as_py(), parts, value, np.ones(len(value), np.int64), np.zeros(len(value), _U))
    return run


# -- segments -----------------------------------------------------------------------------------

_CUT = (["shard", "bucket", "lengths", "text", "places", "at"], [pa.int64(), pa.int64()] + [pa.binary()] * 4)


def _cut_segments(shards: int):
    def run(key, docs, news):
        if not docs.num_rows or not news.num_rows:
            return _rows([], *_CUT)
        off, raw, _ = _bucket(docs)
        anchor, often = _heard(news, 0)
        start, n, of, _ = _runs(off, raw)
        hit, at = _found(anchor, of)
        start, n, of, often = start[hit], n[hit], of[hit], often[at[hit]]
        # around very frequent anchors the windows that occur twice, one by one
        single = _spread(start[often], n[often])
        value = _hashes_of(raw, start[often], n[often])
        twice, _ = _found(_heard(news, 1)[0], value)
        start = np.append(start[~often], single[twice])
        n = np.append(n[~often], np.ones(int(twice.sum()), np.int64))
        to = np.append(mix(of[~often]), value[twice])
        shard = (to >> _U(32)) * _U(shards) >> _U(32)
        row = np.searchsorted(off, start, side="right") - 1
        place = row << 32 | start - off[row]
        data = raw.tobytes()
        by_shard: dict[int, dict[bytes, list[int]]] = {}
        for s, a, k, p in zip(shard.tolist(), start.tolist(), n.tolist(), place.tolist(), strict=True):
            by_shard.setdefault(s, {}).setdefault(data[a : a + k + WINDOW - 1], []).append(p)
        return _rows([(s, key[0].as_py(), np.array([len(x) for x in texts], np.int32).tobytes(), b"".join(texts),
                       np.array([len(x) for x in texts.values()], np.int32).tobytes(), np.array([p for x in texts.values() for p in x], np.int64).tobytes())
                      for s, texts in by_shard.items()], *_CUT)
    return run


# -- transforms and their merge -----------------------------------------------------------------


@dataclass
class Transform:
    """Burrows-Wheeler transform of a collection of texts over 50-byte symbols.

    ``alphabet`` holds the symbols' hashes in order. The first ``ends`` suffixes in sorted order hold no whole symbol;
    ``firsts`` has the number of the first symbol of each other one. ``bwt`` has for each suffix the number (from 1) of
    the symbol before it, 0 at the first 50 places of a text, and ``back`` the sorted place of the suffix that is longer by that
    symbol. ``place`` is a suffix's place in the sorted order, by its place in the texts (one more place than bytes each)."""

    alphabet: np.ndarray
    firsts: np.ndarray
    bwt: np.ndarray
    back: np.ndarray
    ends: int
    place: np.ndarray


def transform(texts: list[bytes]) -> Transform:
    """Suffixes sorted by their symbols: by the first, then by ranks twice as far ahead as long as some tie. A text's
    end is smaller than all symbols; ends differ, in the order of the texts."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    size = np.array([len(x) for x in texts], np.int32) + 1
    end = np.cumsum(size, dtype=np.int32) - 1
    n = len(raw)
    place = np.arange(n, dtype=np.int32)
    whole = np.repeat(end, size) - place >= SYMBOL
    at = np.flatnonzero(whole).astype(np.int32)
    hashes = _symbols(raw)[at]
    o = np.argsort(hashes)
    hashes = hashes[o]
    head = _heads(hashes)
    ends = n - len(at)
    order = np.concatenate([np.flatnonzero(~whole).astype(np.int32), at[o]])
    firsts = np.cumsum(head, dtype=np.int32)
    symbol = np.zeros(n, np.int32)
    symbol[order[ends:]] = firsts
    head = np.append(np.ones(ends, bool), head)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    tied = order[~head | ~np.append(head[1:], True)]
    ahead = SYMBOL
    while len(tied):
        key = rank[tied].astype(np.int64) << 32 | rank[tied + ahead]
        o = np.argsort(key)
        tied, key = tied[o], key[o]
        first = key >> 32
        here = place[: len(tied)]
        head = _heads(key)
        rank[tied] = first + np.maximum.accumulate(np.where(head, here, 0)) - np.maximum.accumulate(np.where(_heads(first), here, 0))
        tied = tied[~head | ~np.append(head[1:], True)]
        ahead *= 2
    order[rank] = place
    start = np.append(0, end[:-1] + 1).astype(np.int32)
    before = order - np.int32(SYMBOL)
    inside = np.repeat(start, size)[order] <= before
    return Transform(hashes[_heads(hashes)] if len(hashes) else hashes, firsts, np.where(inside, symbol[before], 0), np.where(inside, rank[before], -1), ends, rank)


def _in_order(number: np.ndarray) -> np.ndarray:
    """Where the numbers stand when sorted, equal ones in their order: number and place in one integer, sorted."""
    key = number.astype(np.int64) << 32
    key |= np.arange(len(number))
    key.sort()
    return (key & 0xFFFFFFFF).astype(np.int32)


def merge(parts: list[Transform], depth: int = DEPTH) -> list[np.ndarray]:
    """For each transform and each of its suffixes in sorted order: the symbols, up to ``depth``, that it has in common with
    some other suffix of the collection."""
    offset = np.append(0, np.cumsum([len(p.bwt) for p in parts]))
    alphabet = np.sort(np.concatenate([p.alphabet for p in parts]))
    alphabet = alphabet[_heads(alphabet)] if len(alphabet) else alphabet
    numbers = [np.append(0, np.searchsorted(alphabet, p.alphabet) + 1).astype(np.int32) for p in parts]
    before = np.concatenate([k[p.bwt] for k, p in zip(numbers, parts, strict=True)])
    back = np.concatenate([p.back + np.int32(o) for p, o in zip(parts, offset, strict=False)])  # where there is a symbol before
    common = np.zeros(offset[-1], np.int8)

    # the interleave for one symbol: each transform has its suffixes in that order already
    first = np.concatenate([k[p.firsts] for k, p in zip(numbers, parts, strict=True)])
    order = np.concatenate([np.arange(o + p.ends, o + len(p.bwt), dtype=np.int32) for o, p in zip(offset, parts, strict=False)])
    again = np.bincount(first, minlength=len(alphabet) + 1) > 1
    some = np.flatnonzero(again[first])
    some = some[_in_order(first[some])]
    head, order = (_heads(first[some]) if len(some) else np.empty(0, bool)), order[some]
    for h in range(1, depth + 1):
        single = head & np.append(head[1:], True)
        order, block = order[~single], np.cumsum(head, dtype=np.int32)[~single]
        common[order] = h
        if h == depth or not len(order):
            break
        symbol = before[order]
        some = np.flatnonzero(symbol)
        to = some[_in_order(symbol[some])]
        head = _heads(symbol[to], block[to]) if len(to) else np.empty(0, bool)
        order = back[order[to]]
    return np.split(common, offset[1:-1])


_TELL = (["bucket", "row", "start", "end"], [pa.int64()] + [pa.binary()] * 3)


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE_BYTES."""
    lo, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= PIECE_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _merge_shard(table: pa.Table) -> pa.Table:
    """The places of repeated windows, as byte ranges of rows, for every bucket that sent segments."""
    table = table.sort_by("bucket")
    texts: dict[bytes, int] = {}
    which, places, buckets = [], [], []
    for b, lengths, text, count, at in zip(*(table.column(c).to_pylist() for c in ("bucket", *_CUT[0][2:])), strict=True):
        lo = 0
        for size in np.frombuffer(lengths, np.int32).tolist():
            which.append(texts.setdefault(text[lo : lo + size], len(texts)))
            lo += size
        places.append(np.frombuffer(count, np.int32))
        buckets.append((b, len(places[-1]), np.frombuffer(at, np.int64)))
    which, places = np.array(which), np.concatenate(places)
    copied = np.bincount(which, weights=places) > 1
    listed = list(texts)
    cuts = list(_pieces(listed))
    parts = [transform(listed[a:b]) for a, b in cuts]
    common = merge(parts)
    # runs of repeated windows of each text
    owner, begin, stop = [], [], []
    for (a, b), part, c in zip(cuts, parts, common, strict=True):
        size = np.array([len(x) for x in listed[a:b]]) + 1
        windows = size - WINDOW
        base = np.cumsum(size) - size
        of = np.repeat(np.arange(b - a), windows)
        again = (c[part.place[_spread(base, windows)]] >= DEPTH) | copied[a:b][of]
        starts = again & _heads(of, again)
        ends = again & np.append(_heads(of, again)[1:], True)
        inside = _spread(np.zeros(b - a, np.int64), windows)
        owner.append(of[starts] + a)
        begin.append(inside[starts])
        stop.append(inside[ends] + WINDOW)
    owner, begin, stop = np.concatenate(owner), np.concatenate(begin), np.concatenate(stop)
    first = np.searchsorted(owner, np.arange(len(listed) + 1))
    rows, lo = [], 0
    for b, n, at in buckets:
        text = np.repeat(which[lo : lo + n], places[lo : lo + n])
        lo += n
        k = first[text + 1] - first[text]
        if k.any():
            run, at = _spread(first[text], k), np.repeat(at, k)
            rows.append((b, (at >> 32).astype(np.int32).tobytes(), ((at & 0xFFFFFFFF) + begin[run]).astype(np.int32).tobytes(),
                         ((at & 0xFFFFFFFF) + stop[run]).astype(np.int32).tobytes()))
    return _rows(rows, *_TELL)


def _joined_ranges(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal ranges that byte ranges make together; of two rows, they stay apart."""
    order = np.argsort(start)
    row, start, reach = row[order], start[order], np.maximum.accumulate(end[order])
    head = _heads(row)
    head[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return row[at], start[at], reach[np.append(at[1:], len(row))[: len(at)] - 1]


def _remove(with_text: bool):
    """The answers' byte ranges, joined, say what goes: memory grows with them and the text, without an array over its bytes."""
    def run(key, docs, answers):
        names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64()] * 4 + [pa.binary() if with_text else pa.string()]
        if not docs.num_rows:
            return _rows([], names, kinds)
        off, raw, table = _bucket(docs)
        row, start, end = (np.concatenate([np.frombuffer(x, np.int32) for x in answers.column(c).to_pylist()] or [np.empty(0, np.int32)]).astype(np.int64)
                           for c in _TELL[0][1:])
        row, start, end = _joined_ranges(row, off[row] + start, off[row] + end)
        n, gone = len(off) - 1, np.append(0, np.cumsum(end - start))
        first = np.searchsorted(row, np.arange(n + 1))

        def kept(i: int) -> Iterator[np.ndarray]:
            at = int(off[i])
            for k in range(first[i], first[i + 1]):
                yield raw[at : start[k]]
                at = int(end[k])
            yield raw[at : off[i + 1]]

        def digest(i: int) -> str:
            h = hashlib.sha256()
            for x in kept(i):
                h.update(x)
            return h.hexdigest()

        left = [b"".join(kept(i)) if with_text else digest(i) for i in range(n)]
        return pa.table([column(table, "doc_id"), pa.array(np.diff(off)), pa.array(gone[first[1:]] - gone[first[:-1]]),
                         pa.array(np.diff(first)), pa.array(left, kinds[-1])], names=names)
    return run


def deduplicate(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (removed runs) and ``kept``, the bytes left (binary, as a cut may part a
    character; or, without ``with_text``, their SHA-256 in hex)."""
    _, size = text_bytes(docs)
    buckets = max(1, size // BUCKET_BYTES)
    parts = max(1, size // (200 * ANCHORS_PER_GROUP))  # about one anchor in 200 bytes
    spread = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spread = spread.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("long"))
    listed, news = "part long, bucket long, hashes binary, many binary, kinds binary", "bucket long, level int, hashes binary, frequent binary"
    by_bucket = spread.groupBy("bucket")
    anchors = by_bucket.applyInArrow(_list_anchors(parts), listed).groupBy("part").applyInArrow(_share(0), news)
    windows = by_bucket.cogroup(anchors.groupBy("bucket")).applyInArrow(_list_windows(parts), listed).groupBy("part").applyInArrow(_share(1), news)
    cut = by_bucket.cogroup(anchors.unionAll(windows).groupBy("bucket")).applyInArrow(
        _cut_segments(buckets * SHARDS), "shard long, bucket long, lengths binary, text binary, places binary, at binary")
    found = cut.groupBy("shard").applyInArrow(_merge_shard, "bucket long, row binary, start binary, end binary")
    return by_bucket.cogroup(found.groupBy("bucket")).applyInArrow(
        _remove(with_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'binary' if with_text else 'string'}")
