"""N-gram join and substring deduplication against brute force."""

import collections
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import components, ngram_join, substrings
from tests.llm.fixtures import SCHEMA, corpus, documents, empty, lower_az

SPACES = " \t\n\r\x0b\x0c"


def words(text):
    return (text or "").encode().split()


def shingles(text, k=3):
    w = lower_az(text).encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows, k=3, percent=90):
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, a in enumerate(sets):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(a), (min(ids) if ids else None) if a else rows[i][0]))
    return collections.Counter(out)


def test_near_duplicates_match_brute_force(spark):
    got = ngram_join.near_duplicates(documents(spark)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_components(corpus())


def test_near_duplicates_in_a_large_family_of_edited_copies(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 40)}"
        rows.append((i, " ".join(w), "en", "s", ""))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_components(rows)


def test_the_stages_law_in_families_that_share_lines(spark):
    """Five words and 0.8, among texts that share a line or a passage but are no copies, chains of edits and tiny texts."""
    rnd = random.Random(8)
    line = " ".join(f"line{i}" for i in range(16))
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = []
    for i in range(150):
        own = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(3, 60))]
        rows.append(" ".join([*own[: len(own) // 2], line if i % 2 else passage, *own[len(own) // 2:]]))
    base = rows[0].split()
    for i in range(80):  # edits that add up, so that ends of the chain are no copies of each other
        base[rnd.randrange(len(base))] = f"e{i}"
        rows.append(" ".join(base))
    rows += [" ".join(f"t{j}" for j in range(n)) + (" x" if n % 2 else "") for n in range(1, 30)]
    rows = [(i, t, "en", "s", "") for i, t in enumerate(rows)]
    want = brute_components(rows, 5, 80)
    assert want != brute_components(rows)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), ngram_join.COPIES).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    kept = {r.doc_id for r in ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {c for _, _, c in want}


def test_empty_table(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    assert ngram_join.keep_one(empty(spark)).count() == 0
    assert substrings.deduplicate(empty(spark)).count() == 0


def test_keep_one_keeps_one_of_each_group_and_all_columns(spark):
    rows = corpus()
    kept = ngram_join.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    want = {(d, c) for d, _, c in brute_components(rows, 5, 80)}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({d for d, c in want if d == c and d is not None})


def test_keep_one_by_row_with_null_and_repeated_ids(spark):
    text = {x: " ".join(f"{x}{i}" for i in range(40)) for x in "abcdefg"}
    near = {x: t.replace(f"{x}39", "other") for x, t in text.items()}
    rows = [
        (1, text["a"]), (None, near["a"]), (None, text["b"]), (None, text["c"]),  # b and c are copies of nothing
        (5, near["d"]), (5, text["e"]), (2, text["d"]),  # one text of id 5 is a copy, the other isn't
        (9, text["f"]), (9, near["f"]), (None, text["g"]), (None, near["g"]),  # near copies that share an id, or have none
        (None, ""), (None, None), (7, text["e"] + " z"), (7, text["e"] + " z"),
    ]
    got = [(r.doc_id, r.text) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) == 9
    assert {(1, text["a"]), (None, text["b"]), (None, text["c"]), (5, text["e"]), (2, text["d"]), (None, ""), (None, None)} - set(got) == set()
    assert [d for d, t in got if t in (text["f"], near["f"])] == [9]
    assert [d for d, t in got if t in (text["g"], near["g"])] == [None]


def test_keep_one_takes_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    two = [*words[:30], "x", *words[31:60], "y", *words[61:]]  # 86 / 106 on five words, 92 / 104 on three
    three = [*words[:20], "x", *words[21:50], "y", *words[51:80], "z", *words[81:]]  # 81 / 111 on five words
    rows = [(1, " ".join(words)), (2, " ".join(two)), (3, " ".join(three))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == {1, 3}
    assert {r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {1, 2, 3}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 600), st.floats(0, 0.25))
def test_sets_similar_under_the_stage_share_a_signature(seed, size, share):
    rnd = random.Random(seed)
    a = set(rnd.sample(range(10**9), size))
    b = (a - set(rnd.sample(sorted(a), int(rnd.random() * share * size)))) | set(rnd.sample(range(10**9, 2 * 10**9), int(rnd.random() * share * size)))
    if not b or len(a & b) * 100 < 80 * len(a | b) or a == b:
        return
    arrays = [np.sort(np.array(sorted(x), np.uint64)) for x in (a, b)]
    who, sig, need = ngram_join.signatures(np.array([0, len(a), len(a) + len(b)]), np.concatenate(arrays), ngram_join.COPIES)
    both = set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())
    assert both
    # in some scheme the two share as many as each of them needs
    needs = [collections.Counter(need[(who == i) & np.isin(sig, list(both))].tolist()) for i in (0, 1)]
    assert all(any(n >= k for k, n in c.items()) for c in needs)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(4, 400), st.floats(0, 0.12))
def test_similar_sets_share_a_signature(seed, size, share):
    """The pigeonhole argument: whenever two sets reach the similarity, they have a signature in common."""
    rnd = random.Random(seed)
    a = set(rnd.sample(range(10**9), size))
    drop = rnd.sample(sorted(a), int(rnd.random() * share * size))
    b = (a - set(drop)) | set(rnd.sample(range(10**9, 2 * 10**9), int(rnd.random() * share * size)))
    if len(a & b) * 100 < 90 * len(a | b) or a == b:
        return
    arrays = [np.sort(np.array(sorted(x), np.uint64)) for x in (a, b)]
    first = np.array([0, len(a), len(a) + len(b)])
    who, sig, _ = ngram_join.signatures(first, np.concatenate(arrays))
    mine, other = set(sig[who == 0].tolist()), set(sig[who == 1].tolist())
    assert ngram_join.LIMIT[np.searchsorted(ngram_join.STARTS, min(len(a), len(b)), side="right") - 1] == 0 or mine & other


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and all(got[i] == 200 for i in (200, 201, 202))


def brute_substrings(rows):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return collections.Counter(out)


def test_substrings_match_brute_force(spark):
    assert collections.Counter(tuple(r) for r in substrings.deduplicate(documents(spark)).collect()) == brute_substrings(corpus())
    hashed = substrings.deduplicate(documents(spark), with_text=False).collect()
    want = collections.Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_substrings(corpus()).elements())
    assert collections.Counter(tuple(r) for r in hashed) == want


def test_substrings_over_many_buckets_and_frequent_anchors(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(substrings, "ANCHORS_PER_GROUP", 40)
    monkeypatch.setattr(substrings, "FREQUENT", 3)
    assert collections.Counter(tuple(r) for r in substrings.deduplicate(documents(spark)).collect()) == brute_substrings(corpus())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=8), st.integers(1, 6))
def test_backward_search_counts_occurrences(sequences, length):
    text = np.array([x for s in sequences for x in [*s, 0]])
    index = substrings.FMIndex(text, 4)
    ends, want = [], []
    flat = text.tolist()
    for i in range(len(flat) - length):
        pattern = flat[i : i + length]
        if 0 not in pattern:
            ends.append(i + length)
            want.append(sum(flat[j : j + length] == pattern for j in range(len(flat) - length + 1)))
    if ends:
        lo, hi = index.search(np.array(ends), length)
        assert [n if n > 1 else 1 for n in (hi - lo).tolist()] == want
