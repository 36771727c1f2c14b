"""Rule ledger and benchmark decontamination against brute force."""

import collections
import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from tessera.llm import decontaminate, quality
from tessera.llm.words import row_slices
from tests.llm.fixtures import corpus, documents, empty, lower_az

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_ledger_matches_brute_force(spark):
    book = quality.ledger(documents(spark))
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in book.collect())
    assert got == collections.Counter((d, *measured(t)) for d, t, *_ in corpus())
    for r in book.collect():
        assert bool(r.failed & quality.BIT["few_words"]) == (r.n_words < 20)
        assert bool(r.failed & quality.BIT["repeated_windows"]) == (100 * r.n_repeat_words > 30 * r.n_words)


def test_policies_and_ablations_come_from_the_ledger(spark):
    book = quality.ledger(documents(spark)).cache()
    rows = book.collect()
    for policy in quality.POLICIES:
        kept = sum(r.failed & policy.mask == 0 for r in rows)
        assert quality.apply_policy(book, policy).where("kept").count() == kept
        for a in quality.ablations(book, policy).collect():
            rest = policy.mask & ~quality.BIT[a.rule]
            assert a.n_kept_without == sum(r.failed & rest == 0 for r in rows)
            assert a.n_failed == sum(bool(r.failed & quality.BIT[a.rule]) for r in rows)
            assert a.n_failed_alone == a.n_kept_without - kept
    docs = documents(spark)
    clean = quality.keep_clean(docs)
    assert clean.schema == docs.schema
    want = [r.doc_id for r in quality.apply_policy(book).where("kept").collect()]
    assert collections.Counter(r.doc_id for r in clean.collect()) == collections.Counter(want)


def test_empty_tables(spark):
    assert quality.ledger(empty(spark)).count() == 0 and quality.keep_clean(empty(spark)).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(empty(spark), bench).count() == 0
    assert {r.n_hit for r in decontaminate.scan(documents(spark), bench).collect()} == {0}


def items():
    texts = [r[1] for r in corpus()]
    long_ = texts[6].split(" ")
    return [(1, " ".join(long_[3:30])), (2, "zz " + " ".join(texts[24].split(" ")[:12])), (3, "two words"), (4, None), (5, ""), (6, "RIVER ran"),
            (7, texts[33]), (None, "nowhere to be found at all"), (1, " ".join(long_[3:30])), (8, "ñandú, öl!")]


def brute(docs, bench):
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = ALNUM.findall(lower_az(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    out = []
    for d, t, *_ in docs:
        w = ALNUM.findall(lower_az(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                if k in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return collections.Counter(out)


def test_hits_match_brute_force_in_one_block_and_in_several(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    want = brute(corpus(), items())
    assert any(k[2] for k in want)
    for limit in (decontaminate.BLOCK_BYTES, 150):
        got = decontaminate.scan(documents(spark), bench, limit=limit).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    docs = documents(spark)
    kept = decontaminate.keep_uncontaminated(docs, bench)
    assert kept.schema == docs.schema
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(d for d, _, n, _ in want.elements() if not n)


def test_longest_matches_and_locations(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "nothing here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so Alpha, beta gamma. then alpha beta"), (2, "gamma delta alpha"), (3, "x alpha beta gamma delta y")], "doc_id long, text string")
    assert {r.item_id: r.longest for r in decontaminate.longest_matches(docs, bench).collect()} == {"1": 4, "2": 0}
    assert [tuple(r) for r in decontaminate.locations(docs, bench).collect()] == [(3, 1, 4, ["1"])]


def test_longest_verbatim_matches_of_long_passages_and_ties(spark):
    rnd = random.Random(3)
    words = [f"w{rnd.randint(0, 60)}" for _ in range(400)]
    passage = words[:60]
    bench = [("whole", " ".join(passage)), ("tail", " ".join([*passage[:20], *words[100:140]])), ("short", "one two three"), ("same", "la " * 40)]
    texts = [" ".join(passage), " ".join([*words[200:230], *passage, *words[230:260]]), " ".join([*passage[:25], "x", *passage[25:]]), " ".join(passage[:9]),
             " ".join([*passage[:20], *words[100:133], "end"]), "la " * 25, "one two three four", "nothing", None, ""]
    texts += [" ".join([*passage[:16], f"t{i}", *words[300:320]]) for i in range(30)]

    def common(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0, *(row[j] + 1 if x == y else 0 for j, y in enumerate(b))]
            best = max(best, *row)
        return best

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items_ = spark.createDataFrame(bench, "item_id string, text string")
    got = {r.doc_id: r.longest for r in decontaminate.scan(docs, items_).collect()}
    for i, t in enumerate(texts):
        per_item = [(common((t or "").split(), b.split()), min(10, len(b.split()))) for _, b in bench]
        assert got[i] == max((n for n, need in per_item if n >= need), default=0), i
    longest = {r.item_id: r.longest for r in decontaminate.longest_matches(docs, items_).collect()}
    assert longest == {k: max(common((t or "").split(), b.split()) for t in texts) for k, b in bench}


def test_windows_have_a_bound(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="window"):
        decontaminate.scan(docs, spark.createDataFrame([("i", "a")], "item_id string, text string"), window=20)


def test_stages_of_whole_rows_hold_little_in_python(spark):
    text = " ".join(f"word{i % 977}" for i in range(200))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8000)), "text": [text] * 8000})
    row = pa.StructArray.from_arrays(batch.columns, names=["Doc_id", "Text"])
    for read in (lambda: quality._measure(iter([batch])), lambda: row_slices(pa.RecordBatch.from_arrays([row], names=["row"]))):
        tracemalloc.start()
        parts = 0
        for part in read():
            assert part.num_rows <= 1000
            parts += part.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert parts == 8000 and peak < 60 << 20, peak
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    for out in (quality.keep_clean(docs), decontaminate.keep_uncontaminated(docs, spark.createDataFrame([("a", "x y")], "item_id string, text string"))):
        assert "AS text" not in out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1]  # each text is sent once, in its row
        assert out.count() <= 1
