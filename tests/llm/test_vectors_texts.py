"""Neighbours, leakage, mixing and reading levels against brute force, exact rounds and held-out ratings."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from larkspur.llm import leakage, mixing, neighbours, reading
from larkspur.llm.words import words_of


def brute_pairs(ids, x, k, floor):
    u = x.astype(np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    out = set()
    for i in range(len(ids)):
        s = u @ u[i]
        near = sorted((j for j in range(len(ids)) if j != i and s[j] >= floor), key=lambda j: (-round(s[j], 9), ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in near}
    return out


def vectors(n=1500, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, d))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d)) * 0.35
    return np.arange(1, n + 1) * 3, x.astype(np.float32)


def frame(spark, ids, x, extra=()):
    data = [(int(i), [float(a) for a in v], "clash") for i, v in zip(ids, x, strict=True)] + list(extra)
    return spark.createDataFrame(data, "id long, v array<float>, leaf string")


def test_factor_one_is_exact_whatever_the_shards(spark, monkeypatch):
    ids, x = vectors(600)
    df = frame(spark, ids, x)
    for shard, leaf, visitors in ((4096, 256, 65536), (60, 16, 50)):
        monkeypatch.setattr(neighbours, "SHARD_ROWS", shard)
        monkeypatch.setattr(neighbours, "LEAF_ROWS", leaf)
        monkeypatch.setattr(neighbours, "VISITOR_ROWS", visitors)
        assert set(rows(neighbours.similar_pairs(df, 5, 0.85, 16, factor=1.0))) == brute_pairs(ids, x, 5, 0.85)


def test_recall_of_the_relaxed_search(spark, monkeypatch):
    ids, x = vectors(3000, 32, 3)
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 400)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 64)
    want = brute_pairs(ids, x, 5, 0.85)
    got = set(rows(neighbours.similar_pairs(frame(spark, ids, x), 5, 0.85, 32)))
    assert len(got & want) >= 0.9 * len(want) and len(want) > 1000


def test_copies_ties_and_unusable_vectors(spark, monkeypatch):
    ids, x = vectors(200)
    x[:80] = x[0]
    x[80:90] = x[0] * 2
    bad = [(9001, None, "x"), (9002, [0.0] * 16, "x"), (9003, [1.0] * 8, "x"), (9004, [float("nan")] * 16, "x"), (None, [1.0] * 16, "x"), (3, [float(a) for a in x[0]], "x")]
    df = frame(spark, ids, x, bad)
    monkeypatch.setattr(neighbours, "HELD_PAIRS", 300)
    assert set(rows(neighbours.similar_pairs(df, 5, 0.85, 16, factor=1.0))) == brute_pairs(ids, x, 5, 0.85)
    assert neighbours.similar_pairs(df.limit(0), 5, 0.85, 16).count() == 0
    assert neighbours.similar_pairs(df.where("id = 9002"), 5, 0.85, 16).count() == 0


ITEM = "The cedar extension of Komdora confirmed 5,528 million in reserves for copper dermatitis since the merger closed."


@pytest.mark.parametrize(
    "text",
    [
        ITEM, ITEM.upper().replace(" ", " "), "x <b>The</b> cedar **extension** of _Komdora_ conﬁrmed 5,528 mil­lion in reserves", "intro. " + ITEM.replace(",", "").replace(" million", "  \n million"),
        "&quot;cedar extension of Komdora confirmed 5‑528 million&quot; ", "word " * 70_000 + ITEM,
    ],
)
def test_leaks_found(spark, text):
    corpus = spark.createDataFrame([(1, text, 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, "a"), (8, "nothing in common with these words at all here", "b")], "item_id long, text string, doc_id string")
    assert rows(leakage.leaks(corpus, items)) == [(1, 7)]


def test_leaks_equal_brute_force_on_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(60)]
    items = [" ".join(rng.choice(vocabulary, rng.integers(0, 20))) for _ in range(20)]
    for i in range(0, 60, 3):
        part = items[i % 20].split()[: 7 + i % 4]
        texts[i] += " " + " ".join(part) + " zz"
    grams = lambda t: {tuple(w[k : k + 8]) for w in [words_of(t)] for k in range(len(w) - 7)}
    want = sorted(((i, j) for i, t in enumerate(texts) for j, q in enumerate(items) if grams(t) & grams(q)), key=repr)
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, items[0]), (99, None), (0, texts[0])], "doc_id long, text string")
    tests = spark.createDataFrame([*enumerate(items), (None, "x"), (50, None)], "item_id long, text string")
    assert rows(leakage.leaks(corpus, tests)) == want and want
    monkeypatch.setattr(leakage, "SEED_TABLE_ROWS", 3)
    assert rows(leakage.leaks(corpus, tests)) == want
    assert leakage.leaks(corpus.limit(0), tests).count() == 0 and leakage.leaks(corpus, tests.limit(0)).count() == 0
    with pytest.raises(ValueError, match="min_words"):
        leakage.leaks(corpus, tests, 5)


def test_overlaps_tolerate_substitutions(spark):
    swapped = ITEM.replace("million", "thousand")
    r = leakage.overlaps(spark.createDataFrame([(1, swapped)], "doc_id long, text string"), spark.createDataFrame([(7, ITEM)], "item_id long, text string")).first()
    assert r["run"] == 9 and r["matched"] == len(words_of(ITEM)) - 1 and r["span"] == len(words_of(ITEM))


def stretches(longest):
    """Every stretch up to so many words, True for an equal one, that a best overlap can be: single substitutions, a score
    above zero all along and highest at the end, eight equal words."""
    open_ends = [((), 0, 0)]
    while open_ends:
        nearer = []
        for bits, score, top in open_ends:
            for same in (True, False):
                now = score + (1 if same else -2)
                if now > 0 and len(bits) < longest and (same or bits[-1]):
                    nearer.append(((*bits, same), now, max(top, now)))
                    if now > top and sum(bits) + same >= 8:
                        yield (*bits, same)
        open_ends = nearer


def test_every_stretch_with_single_substitutions_hits_a_seed():
    masks = [[i for i, c in enumerate(seed) if c == "1"] for seed in leakage.SEEDS]
    found = list(stretches(20))
    assert tuple(c == "=" for c in "===x===x===") in found and len(found) > 300
    for bits in found:
        assert any(all(bits[k + i] for i in mask) for k in range(len(bits) - 7) for mask in masks), bits


def replaced_words(n, every, at):
    return [f"other{k}" if k % every == at else f"word{k}" for k in range(n)]


def test_overlaps_of_short_runs(spark):
    item = " ".join(f"word{k}" for k in range(99))
    corpus = spark.createDataFrame([(1, " ".join(replaced_words(11, 4, 3))), (2, " ".join(replaced_words(99, 4, 3)))], "doc_id long, text string")
    got = rows(leakage.overlaps(corpus, spark.createDataFrame([(7, item)], "item_id long, text string")))
    assert got == [(1, 7, 3, 9, 11), (2, 7, 3, 75, 99)]


def test_overlaps_are_the_same_on_both_ways(spark, monkeypatch):
    item = [f"word{k}" for k in range(108)]
    text = item[:8] + [f"other{k}" if k % 4 == 0 else w for k, w in enumerate(item[8:], 1)]
    assert sum(a == b for a, b in zip(item, text, strict=True)) == 83
    rng = np.random.default_rng(8)
    noise = [" ".join(w if rng.random() < 0.8 else "zz" for w in item[a : a + 60]) for a in (0, 20, 48)]
    corpus = spark.createDataFrame([(1, "intro " + " ".join(text)), (2, noise[0]), (2, noise[1]), (3, noise[2])], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[30:70]))], "item_id long, text string")
    got = rows(leakage.overlaps(corpus, items))
    last = max(k for k, (a, b) in enumerate(zip(item, text, strict=True)) if a == b)
    assert got[0][:2] == (1, 7) and got[0][3:] == (83, last + 1)
    for name, value in (("SEED_TABLE_ROWS", 3), ("LONG_ITEM", 50)):
        with monkeypatch.context() as m:
            m.setattr(leakage, name, value)
            assert rows(leakage.overlaps(corpus, items)) == got


def mixture(spark):
    docs = [(i, "alpha beta gamma " * (1 + i % 7), ["Big One", "BIG_ONE", "big-one"][i % 3], 0) for i in range(300)]
    docs += [(1000 + i, "delta epsilon zeta " * (2 + i % 3), "small", 0) for i in range(20)]
    docs += [(2000 + i, "delta epsilon zeta eta", None, 0) for i in range(12)] + [(3000, "other words", "unwanted", 0), (3001, None, "small", 0), (3002, "", "small", 0), (None, "x", "small", 0)]
    targets = spark.createDataFrame([("big one", 0.5, 1), ("Small", 0.5, 3), ("small", 0.2, 9), ("absent", 0.3, 2), (None, 0.5, 1), ("none", 0.0, 1)], "source string, target_weight double, max_repeats int")
    return spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int"), targets


def test_mix_meets_targets_under_caps(spark):
    docs, targets = mixture(spark)
    m = mixing.mix(docs, targets)
    got = {r["source"]: r for r in m.shares().collect()}
    assert set(got) == {"big_one", "small", "absent"} and got["absent"]["tokens_drawn"] == 0
    assert got["big_one"]["expected_share"] == pytest.approx(0.5, abs=0.02) and got["small"]["expected_share"] == pytest.approx(0.5, abs=0.02)
    assert got["big_one"]["most_copies"] <= 1 and got["small"]["most_copies"] <= 9
    draws = {r["doc_id"]: r for r in m.draws.collect()}
    assert len(draws) == 300 + 20 + 12 + 1 and draws[3000]["copies"] == 0
    guessed = [r["p"] for k, r in draws.items() if 2000 <= k < 3000]
    assert len(guessed) == 12 and all(p[2] > p[1] and 0.9 <= sum(p) <= 1.000001 for p in guessed), guessed[:2]
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, targets).draws.collect()}
    assert again == {k: r["copies"] for k, r in draws.items()}


def test_unlabelled_documents_of_a_source_without_repeats_are_drawn(spark):
    docs = [(i, "alpha beta gamma " * 5, "once") for i in range(60)] + [(1000 + i, "delta epsilon zeta " * 5, "other") for i in range(60)]
    docs += [(2000 + i, "alpha beta gamma " * 5, None) for i in range(60)]
    targets = spark.createDataFrame([("once", 1.0, 1)], "source string, target_weight double, max_repeats int")
    m = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), targets)
    draws = {r["doc_id"]: r for r in m.draws.collect()}
    guessed = [r for k, r in draws.items() if k >= 2000]
    assert len(guessed) == 60 and sum(r["copies"] for r in guessed) >= 45
    assert all(r["copies"] <= 1 and 0.8 <= r["rate"] < 1.0 for r in guessed) and all(draws[k]["copies"] == 1 for k in range(60))
    assert all(draws[1000 + i]["copies"] == 0 for i in range(60))


def test_small_wanted_sources_are_classes_among_many_labels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FIT_ROWS", 60)
    docs = [(i, "alpha beta gamma " * 3, f"site {i % 120}") for i in range(1200)] + [(5000 + i, "delta epsilon zeta " * 3, "rare") for i in range(6)]
    docs += [(9000 + i, "delta epsilon zeta " * 3, None) for i in range(5)] + [(9500, "alpha beta gamma " * 3, None)]
    counted = mixing.token_counts(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    got = {r["doc_id"]: r["p"] for r in mixing.memberships(counted, ["absent", "rare"]).where("source is null").collect()}
    assert len(got) == 6 and all(got[9000 + i][1] > 0.5 for i in range(5)) and got[9500][1] < 0.1 and {p[0] for p in got.values()} == {0.0}
    assert mixing._fit_parts({0: 5, 1: 100, 2: 1000}) == {0: 1.0, 1: 0.27, 2: 0.028}


def test_mix_of_nothing(spark):
    docs, targets = mixture(spark)
    assert mixing.mix(docs.limit(0), targets).draws.count() == 0
    assert {r["copies"] for r in mixing.mix(docs, targets.limit(0)).draws.collect()} == {0}
    assert {r["tokens_drawn"] for r in mixing.mix(docs.where("source = 'unwanted'"), targets).shares().collect()} == {0}


def test_token_counts_are_those_of_the_vocabulary(spark):
    docs = spark.createDataFrame([(1, "Hello world, it's 2024!", "s"), (2, "<|endoftext|>", "s")], "doc_id long, text string, source string")
    encoding = mixing._encoding(mixing.TOKENIZER)
    got = {r["doc_id"]: r["tokens"] for r in mixing.token_counts(docs).collect()}
    assert got == {1: len(encoding.encode_ordinary("Hello world, it's 2024!")), 2: len(encoding.encode_ordinary("<|endoftext|>"))}
    assert encoding.decode(encoding.encode_ordinary("exact round é")) == "exact round é"


EASY = "We sat in the sun and the dog ran to us. "
HARD = "Pharmacokinetic characterisation of the investigational immunotherapy demonstrated dose-proportional exposure with negligible accumulation in the participants of the randomised investigation. "


def reading_frames(spark):
    docs = [(i, EASY * (5 + i % 5) + f"Then she gave {i} of them to me. ") for i in range(30)] + [(100 + i, HARD * (3 + i % 4) + f"The cohort {i} was evaluated. ") for i in range(30)]
    docs += [(200, "Le chien est dans la maison et le chat est sur la table avec les enfants. " * 6), (201, "Too short."), (202, None), (203, ""), (None, EASY * 9), (204, "!!! ??? " * 60), (0, docs[0][1]), (205, HARD * 3000)]
    ratings = [(i, 1, "a") for i in range(10)] + [(100 + i, 4, "b") for i in range(10)] + [(3, 1, "b"), (4, 4, "c"), (5, None, "a"), (None, 2, "a"), (777, 2, "a")]
    return spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, word string"), spark.createDataFrame(ratings, "doc_id long, reading_level int, rater string")


def test_reading_levels(spark, monkeypatch):
    docs, ratings = reading_frames(spark)
    want = {i: 1 for i in range(30)} | {100 + i: 4 for i in range(30)} | {205: 4}
    for head in (500_000, 5):
        monkeypatch.setattr(reading, "HEAD_WORDS", head)
        assert {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, ratings).select("doc_id", "reading_level").collect()} == want
    assert reading.reading_levels(docs.limit(0), ratings).count() == 0
    assert {r["reading_level"] for r in reading.reading_levels(docs, ratings.limit(0)).collect()} == {None}


TELEGRAPHIC = "Methodology: a mixed-effects model. Comparator-arm randomisation: a stratified allocation. Tolerability: no attributable discontinuation. "


def test_english_without_english_function_words(spark):
    french = "La randomisation et la stratification des participants dans une population de validation pour la confirmation. "
    portuguese = "A companhia espera que o estudo e os dados da fase dois cheguem no fim do ano para as equipas. "
    texts = [TELEGRAPHIC * 6, "Dosing per cohort per protocol; endpoints met; randomisation stratified; met per prespecified modelling. " * 6, french * 6, portuguese * 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    worded = reading.with_words(docs)
    got = {r["doc_id"] for r in reading.features(worded, reading.word_ranks(worded)).collect()}
    assert got == {0, 1}, got


def test_coverage_ranks_by_brute_force(spark):
    docs, ratings = reading_frames(spark)
    worded = {r["doc_id"]: r["words"] for r in reading.with_words(docs.dropDuplicates()).collect()}
    counts: dict[str, int] = {}
    for ws in worded.values():
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
    rank = {w: sum(1 for m in counts.values() if m >= n) for w, n in counts.items()}
    ranks = reading.word_ranks(reading.with_words(docs.dropDuplicates()))
    assert {r["word"]: r["rank"] for r in ranks.collect()} == rank
    for r in reading.features(reading.with_words(docs.dropDuplicates()), ranks).collect():
        own = sorted(rank[w] for w in worded[r["doc_id"]])
        assert r["cover_90"] == pytest.approx(np.log(own[int(np.ceil(0.9 * len(own))) - 1]))


def test_held_out_ratings(spark):
    from larkspur.session import table

    sf = "/root/testdata/sf0.01"
    docs, ratings = table(spark, sf, "documents"), table(spark, sf, "reading_labels")
    agreed = ratings.where("reading_level is not null").groupBy("doc_id").agg(F.min("reading_level").alias("lo"), F.max("reading_level").alias("hi")).where("lo = hi")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    hits = n = 0
    for k in (0, 1):
        levels = reading.reading_levels(docs, ratings.where(fold != k)).select("doc_id", "reading_level")
        for r in levels.join(agreed.where(fold == k), "doc_id").collect():
            hits, n = hits + (r["reading_level"] == r["lo"]), n + 1
    assert n > 40 and hits / n >= 0.75
