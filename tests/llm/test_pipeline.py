"""The corpus pipeline against brute force, stage by stage."""

import collections

import corpus_pipeline
from tests.llm.fixtures import corpus, documents
from tests.llm.test_dedup import brute_components
from tests.llm.test_quality_decontaminate import brute, items, measured


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontaminated", "mixed", "sharded"]


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = [r[:4] for r in corpus()]
    sf = str(tmp_path)
    documents(spark).drop("slot").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    one = corpus_pipeline.quality_rules(spark, docs, sf)
    kept = {r.doc_id for r in one.collect()}
    failed = {d for d, t, *_ in rows for n, _, _, _, k in [measured(t)] if n < 20 or 100 * k > 30 * n}
    assert not kept & (failed - {None})

    two = corpus_pipeline.near_duplicates(spark, one, sf)
    left = [(r.doc_id, r.text, r.lang, r.source) for r in one.collect()]
    want = {d for d, _, c in brute_components(left, 5, 80) if d == c and d is not None}
    assert {r.doc_id for r in two.where("doc_id is not null").collect()} == want

    three = corpus_pipeline.decontaminated(spark, two, sf)
    left = [(r.doc_id, r.text) for r in two.collect()]
    assert collections.Counter(r.doc_id for r in three.collect()) == collections.Counter(d for d, _, n, _ in brute(left, items()).elements() if not n)

    four = corpus_pipeline.mixed(spark, three, sf)
    assert {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    for stage in (one, two, three, four):
        assert stage.columns == docs.columns

    out = corpus_pipeline.run(spark, sf)
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(r.doc_id for r in four.collect())
    assert out.columns == [*docs.columns, "shard", "slot"]
