"""Suffix-array deduplication against brute force over all 400-byte strings, and merged transforms against sorted suffixes."""

import hashlib
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import byte_repeats as B
from tests.llm.fixtures import corpus, documents, empty, sentence

W = B.WINDOW


def plain(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row, by listing every string of W bytes."""
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    times = {}
    for _, b in texts:
        for p in range(len(b) - W + 1):
            times[b[p : p + W]] = times.get(b[p : p + W], 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - W + 1):
            if times[b[p : p + W]] > 1:
                gone[p : p + W] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


def awkward():
    rnd = random.Random(5)
    passage = sentence(rnd, 130)
    texts = [sentence(rnd, rnd.randint(60, 200)) for _ in range(12)]
    texts += [sentence(rnd, rnd.randint(5, 90)) + " " + passage + " " + sentence(rnd, rnd.randint(5, 90)) for _ in range(12)]
    exact = sentence(rnd, 400).encode()[: 2 * W].decode(errors="ignore")
    texts += [exact[:W], "x" + exact[:W], exact[: W - 1] + "#", exact[W:] + exact[:W], exact[1 : W - 30] * 2]
    texts += ["a" * (W - 1), "a" * W, "ab" * W, "abcdefghijklmnop" * 30, "z" * 3000, "q" * (W + 1), "ü" * 500, "\0" * 900, "é" + "ü" * 210]
    texts += [passage + passage + passage, None, "", " "]
    return [(i, t, "en", "s", "clash") for i, t in enumerate(texts)] + [(3, passage, None, None, None), (None, passage, None, None, None), (None, None, None, None, None)]


def of_spark(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in frame.collect()), key=str)


SCHEMA = "doc_id long, text string, lang string, key string, bucket string"


@pytest.mark.parametrize("bucket, frequent", [(8 << 20, 5000), (1 << 12, 5000), (1 << 12, 2)])
def test_equals_brute_force(spark, monkeypatch, bucket, frequent):
    monkeypatch.setattr(B, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(B, "FREQUENT", frequent)
    monkeypatch.setattr(B, "PIECE_BYTES", 1 << 11)
    monkeypatch.setattr(B, "_CHUNK", 700)
    rows = awkward()
    assert of_spark(B.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_the_shared_corpus(spark):
    assert of_spark(B.deduplicate(documents(spark))) == plain(corpus())


def test_digest_instead_of_bytes(spark):
    rows = awkward()
    got = B.deduplicate(spark.createDataFrame(rows, SCHEMA), with_text=False).collect()
    assert sorted(r.kept for r in got) == sorted(hashlib.sha256(x[-1]).hexdigest() for x in plain(rows))


def test_empty_table(spark):
    assert B.deduplicate(empty(spark)).collect() == []


def blocks(text, p):
    """The suffix at p as its hashes of whole symbols."""
    h = B._symbols(np.frombuffer(text, np.uint8))
    return tuple(int(h[i]) for i in range(p, len(text) - B.SYMBOL + 1, B.SYMBOL))


def some_texts(seed):
    rnd = random.Random(seed)
    base = sentence(rnd, 200).encode()
    return [base[a : a + rnd.randint(W, 700)] for a in (rnd.randint(0, 400) for _ in range(12))] + [b"xy" * 300, b"xy" * 250]


def test_transform_is_sorted_and_maps_back():
    texts = list(dict.fromkeys(some_texts(1)))
    t = B.transform(texts)
    suffixes = [(i, p) for i, x in enumerate(texts) for p in range(len(x) + 1)]
    by_place = sorted(range(len(suffixes)), key=lambda k: t.place[k])
    keys = [blocks(texts[suffixes[k][0]], suffixes[k][1]) for k in by_place]
    assert keys == sorted(keys) and sorted(t.place) == list(range(len(suffixes)))
    assert all(len(k) == 0 for k in keys[: t.ends]) and all(keys[t.ends:])
    for k, (_, p) in enumerate(suffixes):
        if p >= B.SYMBOL:
            assert t.back[t.place[k]] == t.place[k - B.SYMBOL] and t.bwt[t.place[k]] == t.firsts[t.back[t.place[k]] - t.ends]
        else:
            assert t.bwt[t.place[k]] == 0
    # the rank mapping that the transform alone defines: equal symbols keep their order
    order = np.argsort(t.bwt, kind="stable")
    order = order[t.bwt[order] > 0]
    assert (t.back[order] == np.arange(t.ends, len(t.bwt))).all()


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_merge_gives_common_prefixes(parts):
    texts = list(dict.fromkeys(some_texts(2) + some_texts(3)))
    groups = [texts[k::parts] for k in range(parts)]
    common = B.merge([B.transform(g) for g in groups])
    every = [blocks(x, p) for x in texts for p in range(len(x) + 1)]
    prefixes = {}
    for s in every:
        for h in range(1, B.DEPTH + 1):
            if len(s) >= h:
                prefixes[s[:h]] = prefixes.get(s[:h], 0) + 1
    for g, c in zip(groups, common, strict=True):
        t = B.transform(g)
        at = 0
        for x in g:
            for p in range(len(x) + 1):
                s = blocks(x, p)
                want = max((h for h in range(1, min(len(s), B.DEPTH) + 1) if prefixes[s[:h]] > 1), default=0)
                assert c[t.place[at]] == want
                at += 1


def test_long_texts_of_one_letter_stay_fast():
    start = time.time()
    table = pa.table({"doc_id": [1, 2], "key": [1, 2], "text": ["a" * 2_000_000, "ab" * 500_000]})
    anchors = B._list_anchors(1)((pa.scalar(0),), table)
    news = B._share(0)(anchors)
    cut = B._cut_segments(1)((pa.scalar(0),), table, news)
    out = B._remove(True)((pa.scalar(0),), table, B._merge_shard(cut))
    assert out.column("n_removed").to_pylist() == [2_000_000, 1_000_000] and time.time() - start < 60


def test_removal_takes_little_memory():
    text = sentence(random.Random(8), 3000).encode()
    n, size = 200, len(text)
    docs = pa.table({"doc_id": range(n), "key": range(n), "text": [text.decode()] * n})
    ranges = [(i, s, s + W) for i in range(n) for s in (0, 100, 100 + W, 900 + W, size - W)]
    answers = B._rows([(0, *(np.array(x, np.int32).tobytes() for x in zip(*ranges, strict=True)))], *B._TELL)
    tracemalloc.start()
    try:
        out = B._remove(False)((pa.scalar(0),), docs, answers)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    left = text[100 + 2 * W : 900 + W] + text[900 + 2 * W : -W]
    assert {(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in out.to_pylist()} == {(size, size - len(left), 3, hashlib.sha256(left).hexdigest())}
    assert peak < 4 * n * size


def test_touching_ranges_join_within_a_row_only():
    got = B._joined_ranges(*np.array([[1, 900, 1400], [0, 0, 500], [1, 500, 900], [0, 100, 450], [2, 1401, 1900], [2, 2000, 2500]]).T)
    assert [x.tolist() for x in got] == [[0, 1, 2, 2], [0, 500, 1401, 2000], [500, 1400, 1900, 2500]]
    assert [x.tolist() for x in B._joined_ranges(*[np.empty(0, np.int64)] * 3)] == [[], [], []]
