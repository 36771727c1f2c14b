"""N-gram Jaccard join by universe partitioning and the pigeonhole principle (exact).

A document's set is its distinct k-word shingles. Two sets of r <= s shingles reach the similarity num / den
only if they differ in at most (r + s) (den - num) / (den + num) shingles. A ``Law`` holds k, num and den and what follows from them:
``OP8`` (3 words, 0.9) for the query, ``COPIES`` (5 words, 0.8) for the pipeline's stage. Sizes fall into bands; a band's scheme cuts the
universe of shingles by hash into m segments and gives segment i a budget t_i of 1 (must be equal) or
2 (may differ by one shingle), with ``sum t_i = H + 2`` where H is the largest difference that the
band allows. If two similar sets differed in every segment by t_i or more, they would differ in more
than H; with the one unit to spare, segments that agree have budgets of 2 at least in total.
So similar sets share a signature: the segment's content for t = 1, and for t = 2 the content and its
one-deletion neighbourhood. A set signs under its own band's scheme, and under the next lower
one if it can be the larger partner there.

Allocation by cost: exact signatures cost one row a unit, one-deletion neighbourhoods as many as the segment has
shingles but keep segments long; a scheme uses as many exact segments as leave about
``segment`` shingles in each and neighbourhoods for the rest. An empty segment agrees with every other
empty one and costs the most candidates: the spare unit pays for leaving it out. A set with several
empty segments signs each pair of them instead, which covers what one spare unit doesn't. A law without ``segment``
has exact segments only, so many that a set occupies more than H of them: of H + 1 occupied ones one agrees. The few sets that
occupy no more share one signature of their scheme.

Equal sets are one class from the start. Sets that share a signature form a group, and a group is
resolved without listing its pairs. Under a law of exact segments a set shares all its signatures but H with each similar
set, so a member that shares fewer with others leaves its groups first, and the others leave their largest groups. Every member x is compared (whole sets) with the group's leader
L, the member that shares most signatures with others. Members linked with L are connected; what is left are pairs
(x, y) of one leader's members where x isn't linked with L. With
D_x = x - L + (L - x) the difference of x and y is |D_x| + |D_y| - 2 |D_x & D_y|, so a link needs
``o = (|D_x| + |D_y| - (r + s) (den - num) / (den + num)) / 2`` shared elements of D_x and D_y, and as x isn't linked with L
o is 1 at least. So a prefix join on the differences (rarest elements of the leader's members first)
finds all such pairs: copies with edits of their own share only what is common and don't meet.
Each pair found is compared on the whole sets.

Words are runs of non-white-space, A-Z lower-cased. Fewer than k words: the sequence is the one
shingle; none (or null text): no set, linked with nothing. A null ``doc_id`` takes part as any other
and is never the smallest id unless alone. Repeated rows belong to one class. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.tables import durable, text_bytes
from tessera.llm.words import Words, column, mix, slices, split_words, text_buffers

BAND = 1.2
SIGNATURES_PER_BUCKET = 1 << 20


class Law:
    """Words of a shingle, the similarity num / den, and the bands and schemes that follow from them.

    ``segment``: shingles that exact segments are to have; None: exact segments only, more of them than H by as many as are left empty."""

    def __init__(self, shingle: int, num: int, den: int, segment: int | None = None):
        self.shingle, self.num, self.den = shingle, num, den
        # a set's partners lie in its own band or the next one
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(max(starts[-1] + 1, int(starts[-1] * BAND), (starts[-1] - 1) * den // num + 1))
        self.starts = np.array(starts)
        top = self.starts[1:] - 1
        self.partner = top * den // num  # the largest size that can link with a set of the band
        self.limit = (top + self.partner) * (den - num) // (den + num)  # H
        self.units = self.limit + 2
        low = (self.units + 1) // 2
        if segment:
            self.segments = np.maximum(low, np.minimum(self.units, self.starts[:-1] // segment))
        else:
            # the fewest exact segments of which a set of the band hardly ever occupies H or fewer (four deviations)
            m, n = self.limit + 1, self.starts[:-1]
            while True:
                a = n / m
                mean, spread = -m * np.expm1(-a), np.sqrt(np.maximum(0, m * (np.exp(-a) - (1 + a) * np.exp(-2 * a))))
                short = (mean - 4 * spread < self.limit + 1) & (m < 4 * n)
                if not short.any():
                    break
                m = m + short * np.maximum(1, m // 64)
            self.units = self.segments = m
        self.loose = self.units - self.segments  # segments with budget 2, the first ones
        self.spare = segment is not None  # one unit pays for an empty segment
        self.text_bytes = 24 if segment else 8  # text for one signature, about


#: op8's: similarity 0.9 of 3-word shingles, 100 * intersection >= 90 * union, sets differ in (r + s) / 19 at most.
OP8 = Law(3, 90, 100, segment=7)
#: The stage's: similarity 0.8 of 5-word shingles, sets differ in (r + s) / 9 at most.
COPIES = Law(5, 80, 100)
STARTS, LIMIT = OP8.starts, OP8.limit

_U = np.uint64


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): text i has the sorted distinct shingles ``hashes[first[i]:first[i+1]]``."""
    n = w.counts
    at, h = w.windows(k)
    short = np.flatnonzero((n > 0) & (n < k))
    acc = np.zeros(len(short), _U)
    for j in range(k - 1):
        there = n[short] > j
        acc[there] = acc[there] * _U(0xD6E8FEB86659FD93) + w.hash[w.first[short[there]] + j] + _U(j + 1)
    owner = np.concatenate([np.searchsorted(w.first, at, side="right") - 1, short])
    if len(short):
        h = np.concatenate([h, mix(acc + _U(0x51ED27))])
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
    first = np.searchsorted(owner, np.arange(len(n) + 1))
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[lo:hi].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return np.append(0, np.cumsum(new))[first], h[new]


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, _U)
    np.cumsum(x, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def set_keys(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set."""
    return _sums(mix(h + _U(0x1234567)), first), _sums(mix(h ^ _U(0x5DEECE66D5DEECE6)), first)


def signatures(first: np.ndarray, h: np.ndarray, law: Law = OP8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, need) rows of all sets under their schemes. ``need``: how many signatures of the scheme the
    set shares with each set that it is similar to, at least."""
    size = np.diff(first)
    band = np.searchsorted(law.starts, size, side="right") - 1
    sets = np.arange(len(size))
    own = sets[(size > 0) & (law.limit[np.maximum(band, 0)] > 0)]
    low = sets[(band > 0) & (size <= law.partner[np.maximum(band - 1, 0)]) & (law.limit[np.maximum(band - 1, 0)] > 0)]
    entry = np.concatenate([own, low])
    scheme = np.concatenate([band[own], band[low] - 1])
    if not len(entry):
        return np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.uint16)
    m, loose = law.segments[scheme], law.loose[scheme]
    base = np.append(0, np.cumsum(m))
    n = size[entry]
    of = np.repeat(np.arange(len(entry)), n)
    start = np.append(0, np.cumsum(n))
    x = h[np.arange(start[-1]) - start[of] + first[entry][of]]
    salt = mix(scheme.astype(_U) + _U(77))
    part = (mix(x ^ salt[of]) % m[of].astype(_U)).astype(np.int64)
    slot = base[of] + part
    value = mix(x + _U(0xABCDEF12345))
    total = np.zeros(base[-1], _U)
    np.add.at(total, slot, value)
    count = np.bincount(slot, minlength=base[-1])
    slot_entry = np.repeat(np.arange(len(entry)), m)
    slot_part = np.arange(base[-1]) - base[slot_entry]
    seed = mix(salt[slot_entry] + slot_part.astype(_U))
    strict = slot_part >= loose[slot_entry]
    empty = strict & (count == 0)
    exact = np.flatnonzero(~empty)
    near = np.flatnonzero(part < loose[of])
    by = [slot_entry[exact], of[near]]
    sig = [mix(total[exact] + seed[exact]), mix(total[slot[near]] - value[near] + seed[slot[near]])]
    gaps = np.bincount(slot_entry[empty], minlength=len(entry))
    need = np.ones(len(entry), np.int64)
    if not law.spare:  # sets of H occupied segments at most may agree in empty ones only, then both are such
        # similar sets differ in H segments at most, so all but H of those that one of them occupies agree
        need = np.clip(m - gaps - law.limit[scheme], 1, 0xFFFF)
        few = np.flatnonzero(m - gaps <= law.limit[scheme])
        by.append(few)
        sig.append(mix(scheme[few].astype(_U) + _U(99)))
        gaps = gaps * 0
    for e in np.flatnonzero(gaps > 1).tolist():  # each pair of empty segments
        s = seed[base[e] : base[e + 1]][empty[base[e] : base[e + 1]]]
        i, j = np.triu_indices(len(s), 1)
        by.append(np.full(len(i), e))
        sig.append(mix(s[i] + mix(s[j])))
    by = np.concatenate(by)
    return entry[by], np.concatenate(sig), need[by].astype(np.uint16)


def _text_sets(part, law: Law) -> tuple[np.ndarray, np.ndarray]:
    off, raw = text_buffers(column(part, "text"))
    return shingle_sets(split_words(off, raw, lower=True), law.shingle)


def _binary(first: np.ndarray, raw: np.ndarray) -> pa.Array:
    """Slices of an array as a binary column."""
    width = raw.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def _keyed(part, law: Law) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    first, h = _text_sets(part, law)
    one, two = set_keys(first, h)
    both = np.empty(2 * len(one), _U)
    both[::2], both[1::2] = one, two
    return first, h, one.view(np.int64), _binary(np.arange(len(one) + 1) * 2, both), np.diff(first)


def _classes(law: Law):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, _, one, key, n = _keyed(part, law)
                more = [x for x in part.schema.names if x not in ("doc_id", "text")]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(n.astype(np.int64)), pa.array(one), key, *[column(part, x) for x in more]],
                                                 names=["doc_id", "n_shingles", "node", "key", *more])
    return run


def _sets(law: Law):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                first, h, one, key, n = _keyed(part, law)
                yield pa.RecordBatch.from_arrays([pa.array(one), key, pa.array(n.astype(np.int64)), _binary(first, h)], names=["node", "key", "n", "items"])
    return run


def _sign(buckets: int, law: Law):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                first, h = _text_sets(part, law)
                one, two = set_keys(first, h)
                # equal sets of this slice sign once
                _, keep = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True)
                alone = np.zeros(len(one), bool)
                alone[keep] = True
                who, sig, need = signatures(first, h, law)
                ok = alone[who]
                who, sig, need = who[ok], sig[ok], need[ok]
                order = np.argsort(sig)
                sig, node, need = sig[order], one[who[order]], need[order]
                edge = np.searchsorted(sig, (np.arange(buckets, dtype=object) * (2**64 // buckets)).astype(_U)) if buckets > 1 else np.zeros(1, np.int64)
                edge = np.append(edge, len(sig))
                full = np.flatnonzero(np.diff(edge))
                cut = np.append(edge[full], len(sig))
                yield pa.RecordBatch.from_arrays([pa.array(full), _binary(cut, sig), _binary(cut, node), _binary(cut, need)], names=["bucket", "sig", "node", "need"])
    return run


def _groups(table: pa.Table) -> pa.Table:
    """Sets that share a signature: (gid, node, need, members, times); groups of the same sets are listed once, with the number of their signatures."""
    sig, node, need = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("sig", _U), ("node", _U), ("need", np.uint16)))
    order = np.lexsort((node, sig))
    sig, node, need = sig[order], node[order], need[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node, need = sig[new], node[new], need[new]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(sig)))
    first = np.append(start, len(sig))
    gid = mix(_sums(mix(node ^ mix(need.astype(_U))), first) + n.astype(_U))
    _, keep, times = np.unique(gid, return_index=True, return_counts=True)
    times = times[n[keep] > 1]
    keep = keep[n[keep] > 1]
    of = np.repeat(keep, n[keep])
    rows = np.repeat(start[keep] - np.append(0, np.cumsum(n[keep]))[:-1], n[keep]) + np.arange(len(of))
    return pa.table({"gid": gid[of].view(np.int64), "node": node[rows].view(np.int64), "need": need[rows].astype(np.int32), "members": n[of],
                     "times": np.repeat(times, n[keep])})


def _several(groups: DataFrame) -> DataFrame:
    """Groups of two members or more, with their number."""
    several = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.drop("members").join(several.select("gid", F.col("n").alias("members")), "gid")


def _supported(groups: DataFrame) -> DataFrame:
    """The entries that a similar pair can't do without.

    A member that shares fewer signatures with others than it needs goes; that takes support from others, so it is done
    twice (any number of times is exact). Of the k signatures left to a member, a partner has all but k - need. So with all signatures in
    one order, smallest groups first, the first one that the two have in common is among the first k - need + 1 of each: the rest,
    the large groups, aren't needed."""
    for _ in range(2):
        enough = groups.groupBy("node", "need").agg(F.sum("times").alias("have")).where("have >= need").select("node", "need")
        groups = _several(groups.join(enough, ["node", "need"], "left_semi"))
    own = Window.partitionBy("node", "need")
    before = F.sum("times").over(own.orderBy("members", "gid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("times")
    first = groups.withColumn("spare", F.sum("times").over(own) - F.col("need")).withColumn("before", before).where("before <= spare")
    return _several(first.drop("spare", "before"))


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of the sorted x are in the sorted y."""
    if not len(y):
        return np.zeros(len(x), bool)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x


def _pairs(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    a, b = column(batch, "items_a"), column(batch, "items_b")
    for i in range(batch.num_rows):
        yield np.frombuffer(a[i].as_buffer(), _U), np.frombuffer(b[i].as_buffer(), _U)


def _compare(law: Law):
    """Pairs with both sets: whether den * intersection >= num * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in _pairs(batch):
                if law.den * min(len(x), len(y)) < law.num * max(len(x), len(y)):
                    linked.append(False)
                    continue
                both = int(np.count_nonzero(_shared(x, y) if len(x) < len(y) else _shared(y, x)))
                linked.append(law.den * both >= law.num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([column(batch, "key_a"), column(batch, "key_b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
    return run


def _differences(law: Law):
    """Pairs (x, leader) with both sets: one row per element that only one of them has, as a hash of leader and element. The first
    row of an x tells its size n, the number d of its rows, and ``most_x`` and ``most_y``: the last place, rarest first, of a prefix in
    which x must share an element with a partner, if x isn't linked with the leader (0: it is) or if the partner isn't."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts, facts = [], [], []
            linked, leader = column(batch, "linked").to_pylist(), column(batch, "leader").to_numpy().astype(_U)
            for i, (x, y) in enumerate(_pairs(batch)):
                delta = np.concatenate([x[~_shared(x, y)], y[~_shared(y, x)]])
                d = len(delta)
                over = (law.den + law.num) * d - (law.den - law.num) * (len(x) + len(y))  # o >= over / 2 / (law.den + law.num)
                at.append(np.full(d, i))
                parts.append(mix(delta ^ mix(leader[i : i + 1])))
                facts.append((len(x), d, 0 if linked[i] else d - max(1, -(-over // (2 * (law.den + law.num)))) + 1,
                              d - max(1, -(-law.num * d // (law.num + law.den))) + 1))
            if not parts:
                continue
            at = np.concatenate(at)
            first = np.ones(len(at), bool)
            first[1:] = at[1:] != at[:-1]
            rows = pa.array(np.where(first, at, 0), mask=~first)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "x").take(pa.array(at)), *(pa.array(c, pa.int32()).take(rows) for c in zip(*facts, strict=True)),
                 pa.array(np.concatenate(parts).view(np.int64))], names=["x", "n", "d", "most_x", "most_y", "element"])
    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, on: str) -> DataFrame:
    for s in "ab":
        pairs = pairs.join(sets.select(F.col(on).alias(f"{on}_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "items") if c != on]), f"{on}_{s}")
    return pairs


def _compared(pairs: DataFrame, sets: DataFrame, on: str, law: Law) -> DataFrame:
    """(a, b, linked) of candidate pairs given by ``on``_a and ``on``_b, on whole sets."""
    full = _with_sets(pairs, sets, on).where("key_a <> key_b")
    return full.select("key_a", "items_a", "key_b", "items_b").mapInArrow(_compare(law), "a binary, b binary, linked boolean")


def _across(stars: DataFrame, sets: DataFrame, law: Law) -> DataFrame:
    """(key_a, key_b) of pairs of one leader's members that may link, one not linked with the leader. ``stars``: written
    rows (a, b, linked) with a number x."""
    open_ = stars.groupBy("b").agg(F.min("x").alias("leader"), F.count(F.lit(1)).alias("k"), F.min("linked").alias("all")).where("k > 1 AND NOT all").select("b", "leader")
    pairs = stars.join(open_, "b").select("x", "leader", F.col("a").alias("key_a"), F.col("b").alias("key_b"), "linked")
    rows = durable(_with_sets(pairs, sets, "key").select("x", "leader", "items_a", "items_b", "linked").mapInArrow(
        _differences(law), "x long, n int, d int, most_x int, most_y int, element long"), "differences")
    # an element that one member only has can't be shared; such elements rank first, so places count from the end
    often = rows.groupBy("element").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("f"), "element"))
    facts = rows.where("n is not null").drop("element")
    # written, as both sides of the join read it and the shuffles that rank the elements can go
    rows = durable(rows.select("x", "element").join(often, "element").withColumn("rank", rank).drop("f").join(facts, "x")
                   .withColumn("place", F.col("d") - F.col("rank") + 1).where("place <= greatest(most_x, most_y)"), "prefixes")
    part = lambda s: rows.where(f"place <= most_{s}").select("element", *[F.col(c).alias(f"{c}_{s}") for c in ("x", "n", "d", "place")])
    o = F.expr(f"ceil((d_x + d_y - (n_x + n_y) * {law.den - law.num} div {law.den + law.num}) / 2)")
    near = F.expr(f"n_x * {law.den} >= n_y * {law.num} AND n_y * {law.den} >= n_x * {law.num} AND x_x <> x_y")
    met = part("x").join(part("y"), "element").where(
        near & (F.col("place_x") <= F.col("d_x") - o + 1) & (F.col("place_y") <= F.col("d_y") - o + 1)
    ).select("x_x", "x_y").distinct()
    for s in "xy":
        met = met.join(stars.select(F.col("x").alias(f"x_{s}"), F.col("a").alias(f"a_{s}")), f"x_{s}")
    return met.select(F.least("a_x", "a_y").alias("key_a"), F.greatest("a_x", "a_y").alias("key_b")).distinct()


def _digest():
    return F.xxhash64(F.col("text").cast("string"), F.length("text"))


def linked_classes(docs: DataFrame, law: Law = OP8, with_digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_shingles, key; labels: key, label of every class linked to another)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, size = text_bytes(rows)
    buckets = 1
    while buckets * SIGNATURES_PER_BUCKET * law.text_bytes < size:
        buckets *= 2
    of_docs = durable((rows.withColumn("digest", _digest()) if with_digest else rows).mapInArrow(_classes(law), "doc_id long, n_shingles long, node long, key binary" + ", digest long" * with_digest), "sets")
    groups = durable(
        rows.mapInArrow(_sign(buckets, law), "bucket long, sig binary, node binary, need binary").groupBy("bucket")
        .applyInArrow(_groups, "gid long, node long, need int, members long, times long"), "groups")
    if not law.spare:
        groups = durable(_supported(groups), "supported")

    known = groups.groupBy("node").agg(F.sum("members").alias("shared"))  # the candidates
    first = of_docs.where("n_shingles > 0").groupBy("key", "node").agg(F.min("doc_id").alias("doc_id"))
    first = first.join(known, "node", "left_semi")
    # the candidates grow with the corpus, so they are never broadcast to the texts
    texts = rows.join(first.select(F.col("doc_id").alias("want")).distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("want")), "left_semi")
    sets = durable(texts.select("text").mapInArrow(_sets(law), "node long, key binary, n long, items binary").dropDuplicates(["key"]), "candidates")

    leader = groups.join(known, "node").groupBy("gid").agg(F.max(F.struct("shared", "node")).alias("top")).select("gid", F.col("top.node").alias("node_b"))
    pairs = groups.join(leader, "gid").where("node <> node_b").select(F.col("node").alias("node_a"), "node_b").distinct()
    stars = durable(_compared(pairs, sets, "node", law).withColumn("x", F.monotonically_increasing_id()), "stars")
    more = durable(_compared(_across(stars, sets, law), sets, "key", law), "links")
    label = components(stars.drop("x").unionAll(more).where("linked"))
    return of_docs, label.withColumnRenamed("node", "key")


def near_duplicates(docs: DataFrame, law: Law = OP8) -> DataFrame:
    """Per document: doc_id, n_shingles, and component_id, the smallest doc_id reachable by links."""
    of_docs, label = linked_classes(docs, law)
    named = of_docs.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    some = F.col("n_shingles") > 0
    smallest = named.where(some).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = named.where(some).join(smallest, "label").select("doc_id", "n_shingles", "component_id")
    return out.unionAll(of_docs.where(~some).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, law: Law = COPIES) -> DataFrame:
    """The input's rows, all columns, without those of which a near copy stays.

    A row is told apart by its id and text. Of each component one row stays: the one with the smallest id (null ids come
    last), among equal ids the one with the smallest digest of the text. So a text goes only if a copy of it stays, whatever other
    texts share its id. A document given in several rows of equal id and text stays once; rows without words
    are copies of nothing else."""
    of_docs, label = linked_classes(docs, law, with_digest=True)
    rows = durable(of_docs.join(label, "key", "left").select("doc_id", "digest", "n_shingles", F.coalesce("label", "key").alias("label")), "found")
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = rows.where("n_shingles > 0").groupBy("label").agg(F.min(member).alias("first"))
    spare = rows.join(first, "label").where(member != F.col("first")).select(F.col("doc_id").alias("_spare"), F.col("digest").alias("_of")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_spare")) & (_digest() == F.col("_of"))
    kept = docs.join(spare, same, "left_anti")
    again = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_spare"), F.col("digest").alias("_of"))
    if again.isEmpty():
        return kept
    return kept.join(again, same, "left_anti").unionAll(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
