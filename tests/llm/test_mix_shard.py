"""Mixing and sharding: exact sizes, deviation bounds, the hypergeometric law."""

import collections
import random
import zlib
from fractions import Fraction

import pytest

from tessera.llm import mixing, numbering, sharding
from tests.llm.fixtures import corpus, documents, empty


def test_shards_have_exact_sizes_and_gapless_slots(spark):
    docs = documents(spark).repartition(7)
    out = sharding.shuffle(docs, shards=5)
    rows = out.collect()
    assert collections.Counter(r.text for r in rows) == collections.Counter(t for _, t, *_ in corpus())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 5
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shuffle(empty(spark), shards=5).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_matrix_has_its_margins(spark, seed):
    sizes = [(i, n) for i, n in enumerate([5, 0, 1200, 33, 7, 1, 90])]
    rows = sharding.communication_matrix(spark.createDataFrame(sizes, "block int, n long"), 6, seed).collect()
    total = sum(n for _, n in sizes)
    assert {r.block: sum(r.counts) for r in rows} == dict(sizes)
    columns = [sum(c) for c in zip(*[r.counts for r in rows], strict=True)]
    assert sum(columns) == total and max(columns) - min(columns) <= 1


def test_matrix_follows_the_hypergeometric_law(spark):
    """Two blocks, two shards: the mean and variance of one count over many seeds."""
    counts = []
    for seed in range(80):
        rows = sharding.communication_matrix(spark.createDataFrame([(0, 40), (1, 60)], "block int, n long"), 2, seed).collect()
        counts.append(next(r.counts[0] for r in rows if r.block == 0))
    mean = sum(counts) / len(counts)
    variance = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert abs(mean - 20) < 1.2 and 3 < variance < 11  # 20 and 6.06


@pytest.mark.parametrize("bits", [0, 3])
def test_positions_are_gapless_in_groups_of_any_size(spark, bits):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}" if i % 4 else None, rnd.getrandbits(64) - 2**63) for i in range(400)]
    out = numbering.numbered(spark.createDataFrame(rows, "g string, k long"), "g", "k", "at", bits).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.g].append((r["at"], r.k))
    assert sum(map(len, by.values())) == 400
    assert all([a for a, _ in sorted(v)] == list(range(len(v))) for v in by.values())


def test_schedule_deviates_by_less_than_a_block():
    rnd = random.Random(9)
    for _ in range(20):
        weights = {f"s{k}": rnd.random() ** 3 + 1e-4 for k in range(rnd.randint(1, 12))}
        share = mixing.apportion(weights, 500)
        cycle = sum(share.values())
        assert cycle == 500
        order = {slot: s for s, slots in mixing.schedule(share).items() for slot in slots}
        had = collections.Counter()
        for t in range(cycle):
            had[order[t]] += 1
            for s in share:
                assert abs(had[s] - share[s] / cycle * (t + 1)) < 1
        assert had == share


def test_blocks_follow_the_target_weights_over_the_whole_table():
    """A hot source of a third among 1,000, far over 10,000 blocks: within a block of the exact weights at every slot."""
    weights = {"hot": 0.5} | {f"s{k:03}": 0.001 for k in range(1000)}
    share = mixing.apportion(weights)
    w = [Fraction(x) / sum(map(Fraction, weights.values())) for x in (weights[s] for s in share)]
    hot = list(share).index("hot")
    blocks = [10_000 if k == hot else 20 for k in range(len(w))]
    found = list(mixing.steps(list(share.values()), blocks))
    assert len(found) == sum(blocks) == 30_000
    done = 0
    for slot, k, i in found:
        assert int(i / w[k]) <= slot < -(-(i + 1) // w[k])
        done += k == hot
        assert abs(done - w[hot] * (slot + 1)) < 1
    assert mixing.apportion({"a": 1 / 3, "b": 1 / 3, "c": 1e-6}, 10_000) == {"a": 5000, "b": 5000}  # none is reserved


def test_slots_go_on_from_any_state():
    share, blocks = [5, 1, 7], [9, 40, 3]
    whole, taken = list(mixing.steps(share, blocks)), [0, 0, 0]
    for j, (slot, k, i) in enumerate(whole):
        assert list(mixing.steps(share, blocks, slot, taken)) == whole[j:]
        taken[k] = i + 1


@pytest.mark.parametrize("sizes", [{"hot": 3200, **{f"s{k}": 320 for k in range(19)}}, {f"s{k}": 6400 // k for k in range(1, 21)}])
def test_kept_set_has_the_target_weights(spark, sizes):
    weights = mixing.temperature_weights(sizes)
    share = mixing.apportion(weights)
    blocks = [-(-sizes[s] // 16) for s in share]
    horizon = mixing.horizon_of(list(share.values()), blocks, 1.0)
    kept = dict(zip(share, mixing.held(list(share.values()), blocks, horizon), strict=True))
    total, low = sum(weights.values()), min(sizes.values())
    assert sum(kept.values()) == horizon  # no slot is empty
    assert all(abs(kept[s] - horizon * weights[s] / total) < 1 for s in sizes)
    assert all(abs(kept[s] * 16 / sizes[s] - (low / sizes[s]) ** 0.3) * sizes[s] <= 48 for s in sizes)  # share dropped: 1 - (m / n) ** 0.3
    ids = [s for s, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, f"t{i}", s) for i, s in enumerate(ids)], "doc_id long, text string, source string")
    stage = collections.Counter(r.source for r in mixing.keep_mixed(docs).collect())
    column = collections.Counter(r.source for r in mixing.mix(docs).where("kept").collect())
    assert stage == column and all(16 * kept[s] - 15 <= stage[s] <= 16 * kept[s] for s in sizes)


def test_mix_places_every_document_once(spark):
    docs = documents(spark)
    rows = mixing.mix(docs, alive=0, block_rows=2).collect()
    assert len(rows) == len(corpus()) and all(r.kept for r in rows)
    assert len({r.place for r in rows}) == len(rows)
    some = mixing.mix(docs, {"s1": 3.0, "s2": 1.0}, alive=1, block_rows=1).collect()
    assert {r.source for r in some if r.kept} == {"s1", "s2"} and any(r.slot is None for r in some)
    kept = collections.Counter(r.source for r in some if r.kept)
    sizes = collections.Counter(r[3] for r in corpus())
    assert kept["s1"] == sizes["s1"] or kept["s2"] == sizes["s2"]
    assert mixing.keep_mixed(docs).columns == docs.columns
    assert mixing.mix(empty(spark)).count() == 0


def test_query_columns(spark, tmp_path):
    from tessera.llm.queries import QUERIES

    documents(spark).drop("slot").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op2_shard"](spark, str(tmp_path)).collect()
    want = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in corpus())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
