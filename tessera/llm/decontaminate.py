"""Benchmark decontamination with suffix arrays over the training text.

Every shard (a few MB of whole documents, one slice of a scan task) gets a word-level suffix array:
the shard's words become integers in the benchmark's vocabulary (0: a word no item has) and the
suffixes are sorted by their first ``DEPTH`` words. A suffix whose first two words occur in no item
in a row can't match two words, so those suffixes are left out of the sort (the array is sparse; a
search for what is left finds the same). Every suffix of every item is then binary-searched in every
shard: the two neighbours of its place share its longest verbatim match, and the suffixes that share
a whole window (``window`` words of one item, or all of a shorter item) are a contiguous range, which
gives the locations. Documents never leave their task; only the benchmark moves, in blocks of at most
``BLOCK_BYTES``, so that no broadcast grows with it. Several blocks are several passes whose hits are
united per document.

Null text has no words; a null item id reads as the empty string; an item without words matches nothing; repeated rows each get their own row;
an empty benchmark or an empty table gives no hits or no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import NOT_ALNUM, Words, column, row_slices, slices, split_words, text_buffers

WINDOW = 10
DEPTH = 16
BLOCK_BYTES = 16 << 20


@dataclass
class Suffixes:
    """All item suffixes of one block that can start a match, as a matrix of word numbers."""

    vocabulary: np.ndarray  # sorted word hashes; number = place + 1
    text: np.ndarray  # the items' words, 0 after each item
    at: np.ndarray  # suffix -> place in text
    item: np.ndarray  # suffix -> item
    need: np.ndarray  # suffix -> words a match must have to be a window (0: no window starts here)
    ids: list[str]
    pairs: np.ndarray  # sorted word-number pairs, and single words of one-word items


def item_suffixes(ids: list[str], texts: list[str | None], window: int = WINDOW) -> Suffixes:
    off, raw = text_buffers(pa.array(texts, pa.large_string()))
    w = split_words(off, raw, NOT_ALNUM, lower=True)
    vocabulary = np.unique(w.hash)
    number = np.searchsorted(vocabulary, w.hash) + 1
    n = w.counts
    owner = w.text_of()
    place = np.arange(len(w.hash)) + owner  # one 0 after each item
    text = np.zeros(len(w.hash) + len(n) + DEPTH, np.int64)
    text[place] = number
    left = w.first[1:][owner] - np.arange(len(w.hash))  # words from here to the item's end
    need = np.where(left >= window, window, 0)
    whole = (n[owner] < window) & (left == n[owner])
    need[whole] = n[owner][whole]
    pairs = np.unique(text[place] << 32 | text[place + 1])
    return Suffixes(vocabulary, text, place, owner, need, ids, pairs)


def shard_array(words: Words, block: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(the shard's word numbers, 0 after each document; its suffix array)."""
    owner = words.text_of()
    place = np.arange(len(words.hash)) + owner
    text = np.zeros(len(words.hash) + len(words.first) + DEPTH, np.int64)
    if len(block.vocabulary):
        k = np.searchsorted(block.vocabulary, words.hash)
        k[k == len(block.vocabulary)] = 0
        text[place] = np.where(block.vocabulary[k] == words.hash, k + 1, 0)
    at = place[text[place] > 0]
    ok = _within(block.pairs, text[at] << 32 | text[at + 1]) | _within(block.pairs, text[at] << 32)
    at = at[ok]
    rows = text[at[:, None] + np.arange(DEPTH)] if len(at) else np.zeros((0, DEPTH), np.int64)
    return text, at[np.lexsort(rows.T[::-1])]


def _within(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    k = np.searchsorted(table, x)
    k[k == len(table)] = 0
    return table[k] == x


def _compare(text: np.ndarray, at: np.ndarray, other: np.ndarray, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Sign of (suffix of text - suffix of other) over the first ``depth`` words."""
    cols = np.arange(DEPTH)
    d = np.sign(text[at[:, None] + cols] - other[start[:, None] + cols])
    d[cols >= depth[:, None]] = 0
    first = np.argmax(d != 0, axis=1)
    return d[np.arange(len(d)), first]


def _search(text: np.ndarray, sa: np.ndarray, block: Suffixes, q: np.ndarray, depth: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of item suffixes ``q`` by their first ``depth`` words, all at once."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        c = _compare(text, sa[mid], block.text, block.at[q[open_]], depth[open_])
        down = c <= 0 if right else c < 0
        lo[open_[down]] = mid[down] + 1
        hi[open_[~down]] = mid[~down]


def _match(text: np.ndarray, at: np.ndarray, other: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Words two suffixes share, to the end of the item or the document."""
    n = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        a, b = at[live] + n[live], start[live] + n[live]
        same = (text[a] == other[b]) & (text[a] > 0)
        live = live[same]
        n[live] += 1
    return n


def _verbatim(at: np.ndarray, start: np.ndarray, item: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each hit the words of the verbatim match that it is part of: hits one word further on, in the text and in the item, go on with it."""
    order = np.lexsort((at, at - start, item))
    a, d, i = at[order], (at - start)[order], item[order]
    new = np.ones(len(a), bool)
    new[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)
    run = np.cumsum(new) - 1
    out = np.empty(len(a), np.int64)
    out[order] = (np.bincount(run) - 1 + need[order][new])[run] if len(a) else 0
    return out


def search_shard(words: Words, block: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window hits (first word, words, item), each item's longest match in the shard, and the words of each hit's whole match."""
    none = np.empty(0, np.int64)
    longest = np.zeros(len(block.ids), np.int64)
    text, sa = shard_array(words, block)
    if not len(sa) or not len(block.at):
        return none, none, none, longest, none
    q = np.arange(len(block.at))
    place = _search(text, sa, block, q, np.full(len(q), DEPTH), False)
    for near in (place - 1, place):
        ok = (near >= 0) & (near < len(sa))
        np.maximum.at(longest, block.item[q[ok]], _match(text, sa[near[ok]], block.text, block.at[q[ok]]))
    # neighbours have the longest match of fewer than DEPTH words; longer ones are runs of hits
    q = np.flatnonzero(block.need > 0)
    lo, hi = (_search(text, sa, block, q, block.need[q], right) for right in (False, True))
    n = hi - lo
    which = np.repeat(np.arange(len(q)), n)
    at = sa[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    first = at - np.searchsorted(words.first + np.arange(len(words.first)), at, side="right") + 1
    need, item = block.need[q][which], block.item[q][which]
    whole = _verbatim(at, block.at[q][which], item, need)
    np.maximum.at(longest, item, whole)
    return first, need, item, longest, whole


_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()),
                   ("hits", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))])
_HITS_SQL = "doc_id long, n_words long, n_hit long, longest long, hits array<struct<first:long,last:long>>, items array<string>"


def _hits(part, block: Suffixes) -> pa.RecordBatch:
    off, raw = text_buffers(column(part, "text"))
    w = split_words(off, raw, NOT_ALNUM, lower=True)
    first, n, item, _, whole = search_shard(w, block)
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + n, -1)
    hit = np.cumsum(cover[:-1]) > 0
    total = np.append(0, np.cumsum(hit))
    doc = np.searchsorted(w.first, first, side="right") - 1
    hits: list[list] = [[] for _ in range(part.num_rows)]
    items: list[list] = [[] for _ in range(part.num_rows)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    for d, i in {(d, i) for d, i in zip(doc.tolist(), item.tolist(), strict=True)}:
        items[d].append(block.ids[i])
    for a, b in edge.reshape(-1, 2).tolist():  # runs of hit words, cut at document ends
        d = int(np.searchsorted(w.first, a, side="right")) - 1
        while a < b:
            stop = min(b, int(w.first[d + 1]))
            if stop > a:
                hits[d].append({"first": a - int(w.first[d]), "last": stop - 1 - int(w.first[d])})
            a, d = stop, d + 1
    longest = np.zeros(part.num_rows, np.int64)
    np.maximum.at(longest, doc, whole)
    return pa.RecordBatch.from_arrays(
        [column(part, "doc_id").cast(pa.int64()), pa.array(w.counts), pa.array(total[w.first[1:]] - total[w.first[:-1]]),
         pa.array(longest), pa.array(hits, _HITS.field("hits").type), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))], schema=_HITS)


def benchmark_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in blocks of at most about ``limit`` bytes by a hash of the item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = int(size // limit) + 1
    if n == 1:
        return [items]
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n))
    return [items.where(key == i) for i in range(2 * n)]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, the hit word ranges, the items with an occurring window, and ``longest``, the words of its longest verbatim
    match with an item (0 where none is as long as a window)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = benchmark_blocks(benchmark, limit)
    if len(blocks) > 1:
        return _united(rows, blocks, window)
    block = _load(blocks[0], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _hits(part, Suffixes(*block.value))

    return rows.mapInArrow(run, _HITS_SQL)


def _load(items: DataFrame, window: int):
    if not 1 <= window <= DEPTH:
        raise ValueError(f"a window has 1 to {DEPTH} words")
    return _broadcast(items, window)


def _broadcast(items: DataFrame, window: int):
    """One block of the benchmark, at most about two times BLOCK_BYTES, broadcast to the tasks."""
    got = items.toArrow()
    block = item_suffixes(got.column("item_id").to_pylist(), got.column("text").to_pylist(), window)
    return items.sparkSession.sparkContext.broadcast(tuple(vars(block).values()))


def _united(rows: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """Hits of several blocks united per document; rows with one doc_id and equal results are alike,
    rows with one doc_id and different texts are told apart by a digest of the text."""
    out = None
    for items in blocks:
        block = _load(items, window)

        def run(batches, block=block):
            for batch in batches:
                for part in slices(batch):
                    got = _hits(part, Suffixes(*block.value))
                    yield pa.RecordBatch.from_arrays([*got.columns, column(part, "digest")], names=[*got.schema.names, "digest"])

        one = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit("")))).mapInArrow(run, _HITS_SQL + ", digest string")
        one = one.groupBy("doc_id", "digest", "n_words").agg(
            F.first("hits").alias("hits"), F.first("items").alias("items"), F.max("longest").alias("longest"), F.count(F.lit(1)).alias("copies"))
        out = one if out is None else out.unionByName(one)
    merged = out.groupBy("doc_id", "digest", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.max("longest").alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("copies").alias("copies"))
    united = F.expr("""aggregate(hits, cast(array() as array<struct<first:bigint,last:bigint>>), (a, h) ->
        CASE WHEN size(a) > 0 AND a[size(a) - 1].last >= h.first - 1
             THEN concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].first as first, greatest(a[size(a) - 1].last, h.last) as last)))
             ELSE concat(a, array(h)) END)""")
    merged = merged.withColumn("hits", united).withColumn("n_hit", F.expr("aggregate(hits, 0L, (n, h) -> n + h.last - h.first + 1)"))
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "n_words", "n_hit", "longest", "hits", "items")


def locations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per run of hit words: doc_id, first and last word, the document's matching items."""
    return scan(docs, benchmark, window).select("doc_id", "items", F.explode("hits").alias("h")).select("doc_id", "h.first", "h.last", "items")


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per item: the most words that it shares verbatim with any document, over all shards."""
    rows = docs.select(F.col("text").cast("string").alias("text"))
    out = None
    for items in benchmark_blocks(benchmark):
        block = _load(items, WINDOW)

        def run(batches, block=block):
            b = Suffixes(*block.value)
            best = np.zeros(len(b.ids), np.int64)
            for batch in batches:
                for part in slices(batch):
                    off, raw = text_buffers(column(part, "text"))
                    np.maximum(best, search_shard(split_words(off, raw, NOT_ALNUM, lower=True), b)[3], out=best)
            yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.string()), pa.array(best)], names=["item_id", "longest"])

        one = rows.mapInArrow(run, "item_id string, longest long")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("item_id").agg(F.max("longest").alias("longest"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The input's rows, all columns, without a word inside a benchmark window. One pass over the
    documents for each block of the benchmark; no shuffle."""
    out = docs
    for items in benchmark_blocks(benchmark):
        block = _load(items, window)
        names = out.columns
        packed = out.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))

        def run(batches, block=block):
            for batch in batches:
                for part in row_slices(batch):
                    clean = pa.array(column(_hits(part, Suffixes(*block.value)), "n_hit").to_numpy() == 0)
                    yield pa.RecordBatch.from_arrays([column(part, "row").filter(clean)], names=["row"])
            pa.default_memory_pool().release_unused()  # the worker lives on

        kind = packed.schema["row"].dataType.simpleString()
        out = packed.mapInArrow(run, f"row {kind}").select("row.*")
    return out
