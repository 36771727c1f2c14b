"""Merkle manifest against a plain tree walk, over sources of one row to several chunks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tests.llm.fixtures import corpus, empty


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """(root, siblings of each leaf: (left, right) by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            lo = a // 3 * 3
            paths[i].append(("".join(nodes[lo:a]), "".join(nodes[a + 1 : lo + 3])))
            at[i] = a // 3
        nodes = [digest("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        ordered = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((ordered, *plain_tree([plain_leaf(r) for r in ordered])))
    root, top = plain_tree([t[1] for t in trees])
    return sorted((str(r[0]), plain_leaf(r), sub, root, str(p + above))
                  for (ordered, sub, paths), above in zip(trees, top, strict=True) for r, p in zip(ordered, paths, strict=True))


def of_spark(frame):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, str([(s["left"], s["right"]) for s in r.path])) for r in frame.collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos long, tree string"


def rows_of(n, source, first=0):
    return [(first + i, source, None if i % 5 == 0 else "en", i if i % 3 else None, "a\nb" * (i % 4) if i % 7 else None) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_a_plain_walk(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "CHUNK", merkle.ARITY ** levels)
    rows = [x for n, s, at in ((1, "one", 0), (3, "b", 10), (28, None, 100), (27, "ä", 200), (100, "hot", 1000), (4, "", 50)) for x in rows_of(n, s, at)]
    rows += [rows[40], (None, "hot", None, None, None), (None, "hot", None, None, "x"), (1000, "hot", "fr", 3, "the id again")]
    assert of_spark(merkle.manifest(frame(spark, rows))) == plain_manifest(rows)


def test_the_shared_corpus(spark):
    rows = [(r[0], r[3], r[2], len(r[1] or ""), r[1]) for r in corpus()]
    assert of_spark(merkle.manifest(frame(spark, rows))) == plain_manifest(rows)


def test_single_row_is_its_own_root(spark):
    rows = [(5, None, None, None, None)]
    got = merkle.manifest(frame(spark, rows)).collect()[0]
    assert (got.leaf, got.subroot, got.root, got.path) == (plain_leaf(rows[0]),) * 3 + ([],)


def test_empty_table(spark):
    docs = empty(spark).withColumn("n_chars", F.lit(1))
    assert merkle.manifest(docs).collect() == []


def test_fold_detects_a_changed_row(spark):
    rows = rows_of(40, "s")
    torn = merkle.leaf({"text": F.translate("text", "\n", "")})
    tree = merkle.manifest(frame(spark, rows), torn)
    got = tree.select("doc_id", "root", merkle.fold(F.col("leaf")).alias("own"), merkle.fold(F.col("other")).alias("changed")).collect()
    text = {r[0]: r[4] for r in rows}
    assert len(got) == 40 and all(r.own == r.root for r in got)
    assert all((r.changed == r.root) == ("\n" not in (text[r.doc_id] or "")) for r in got)
