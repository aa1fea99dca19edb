"""Hot groups, second routing trees and large seed tables: the ways that only large inputs take, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from test_vectors_texts import brute_pairs, frame

from larkspur.llm import leakage, mixing, neighbours


def small_trees(monkeypatch, sample=128, shard=16, visitors=64):
    for name, value in (("SAMPLE_ROWS", sample), ("SHARD_ROWS", shard), ("LEAF_ROWS", 4), ("VISITOR_ROWS", visitors), ("LARGE", 1)):
        monkeypatch.setattr(neighbours, name, value)


def test_second_trees_are_exact_at_factor_one(spark, monkeypatch):
    small_trees(monkeypatch)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(60, 16)), 15, axis=0).astype(np.float32) + rng.normal(size=(900, 16)).astype(np.float32) * 0.25
    ids = np.arange(900) * 7
    got = set(rows(neighbours.similar_pairs(frame(spark, ids, x), 5, 0.85, 16, factor=1.0)))
    assert got == brute_pairs(ids, x, 5, 0.85)


def test_a_third_of_nearly_one_direction(spark, monkeypatch):
    small_trees(monkeypatch, sample=64)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=16)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[::3] = (hot + rng.normal(size=(200, 16)) * 1e-2) * rng.uniform(0.5, 2.0, 200)[:, None]
    ids = np.arange(600)
    got = set(rows(neighbours.similar_pairs(frame(spark, ids, x), 5, 0.85, 16, factor=1.0)))
    want = brute_pairs(ids, x, 5, 0.85)
    assert len(got ^ want) <= len(want) // 500 and len(want) > 500


def test_one_direction_at_many_lengths_is_one_group(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 16)).astype(np.float32)
    x[::3] = (np.rint(rng.normal(size=16) * 64) / 64 + 0.0).astype(np.float32) * np.arange(1, 31, dtype=np.float32)[:, None]
    ids = np.arange(90)
    seen = []
    real = neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda v, *a, **k: seen.append(v.count()) or real(v, *a, **k))
    got = set(rows(neighbours.similar_pairs(frame(spark, ids, x), 5, 0.85, 16, factor=1.0)))
    assert seen == [61] and got == brute_pairs(ids, x, 5, 0.85)


def test_samples_are_not_empty_at_any_size(spark):
    df = spark.range(100_000)
    share = neighbours._sampled(df, 0.02, "s").count()
    assert 1_600 < share < 2_400
    assert int(4_096 / 4e11 * 2.0**63) > 10**10


@pytest.mark.parametrize("hot", [2, 50_000])
def test_large_seed_tables_and_hot_hashes_give_the_same_overlaps(spark, monkeypatch, hot):
    rng = np.random.default_rng(11)
    phrase = [f"common{k}" for k in range(12)]
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 30, 20)), *(phrase if i % 3 == 0 else []), "end"]) for i in range(60)]
    items = [" ".join([*(phrase if j % 2 else [f"w{x}" for x in rng.integers(0, 30, 12)]), f"own{j}"]) for j in range(12)]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = rows(leakage.overlaps(corpus, tests))
    assert len([r for r in want if r[2] >= 12]) >= 20 * 6
    monkeypatch.setattr(leakage, "HOT_HITS", hot)
    monkeypatch.setattr(leakage, "SEED_TABLE_ROWS", 3)
    assert rows(leakage.overlaps(corpus, tests)) == want


def test_the_map_of_bits_lets_every_known_hash_through(spark):
    table = leakage.seed_table(spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(300)))], "doc_id long, text string"), leakage.SEEDS[:1])
    codes = np.array([r["hash"] for r in table.collect()]).view(np.uint64)
    bits = leakage.known_hashes(table, leakage.SEEDS[:1])
    assert bits.bits is None and len(bits.may_be(0, codes)) == len(codes)


@pytest.mark.parametrize("seed", range(5))
def test_best_stretch_equals_a_loop(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        item, doc, shift = rng.integers(0, 2, rng.integers(1, 30)).astype(str), rng.integers(0, 2, rng.integers(1, 40)).astype(str), int(rng.integers(-20, 30))
        run = best = score = top = begin = equal = 0
        found = (0, 0)
        for k, same in enumerate(doc[i + shift] == item[i] for i in range(max(0, -shift), min(len(item), len(doc) - shift))):
            run = run + 1 if same else 0
            best = max(best, run)
            if score <= 0:
                score, begin, equal = 0, k, 0
            score += 1 if same else -2
            equal += bool(same)
            if score > top:
                top, found = score, (equal, k - begin + 1)
        assert leakage._best_stretch(list(doc), list(item), shift) == (best, *found)


def test_documents_between_sources_lower_the_total_until_targets_are_met(spark):
    rng = np.random.default_rng(1)
    a, b = [f"alpha{k}" for k in range(20)], [f"beta{k}" for k in range(20)]
    text = lambda share: " ".join(rng.choice(a if rng.random() < share else b) for _ in range(30))
    docs = [(i, text(1.0), "a") for i in range(150)] + [(500 + i, text(0.0), "b") for i in range(150)] + [(1000 + i, text(0.5), None) for i in range(300)]
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 4)], "source string, target_weight double, max_repeats int")
    m = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), targets)
    assert m.residual <= mixing.TOLERANCE
    got = {r["source"]: r for r in m.shares().collect()}
    assert got["a"]["expected_share"] == pytest.approx(0.9, abs=0.03) and max(r["copies"] for r in m.draws.collect()) <= 4
