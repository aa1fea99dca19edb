"""Names of other shapes than the usual ones, orders of many words, and common surnames."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from conftest import rows

from larkspur.llm import tries, variants
from larkspur.llm.names import edits, parse, well_written


@pytest.mark.parametrize("name", ["Genmab A/S", "Novo Nordisk A/S"])
def test_a_danish_company_is_no_person(name):
    assert parse(name)[0] == "" and parse(name)[2] == "aps" and well_written(name)


@pytest.mark.parametrize(
    ("name", "want"),
    [("Celgene Corporation", True), ("Biogen", True), ("BIOGEN", False), ("The Biogen Institute", False), ("Dana Cancer Inst", False), ("Biogen  Inc", False), (" Biogen", False), ("Ann B. Lee", True), ("Lee, Ann", False), ("", False)],
)
def test_well_written(name, want):
    assert well_written(name) is want


def pairs(spark, *names):
    return rows(variants.variant_pairs(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "lead_sponsor string, n int"), "lead_sponsor"))


def test_similar_well_written_organisations_stay_apart(spark):
    assert pairs(spark, "Celgene Corporation", "Calgene Corporation", "Biogen", "Biogem", "Amgen", "Angen") == []
    assert pairs(spark, "Celgene Corporation", "CALGENE CORP", "celgene corp.") == [("CALGENE CORP", "Celgene Corporation"), ("CALGENE CORP", "celgene corp."), ("Celgene Corporation", "celgene corp.")]


def test_long_names_in_any_order(spark):
    a, b = "Alpha Beta Gamma Delta Epsilon Institute", "Epsilon Zlpha Delta Beta Gamma Institute"
    assert pairs(spark, a, b, "Alpha Beta Gamma Delta Institute", "Zlpha Beta Delta Gamma Institute") == sorted([("Alpha Beta Gamma Delta Institute", "Zlpha Beta Delta Gamma Institute"), (a, b)], key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_any_order_equals_all_orders(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    index, queries = [" ".join(word() for _ in range(5)) for _ in range(40)], [" ".join(word() for _ in range(5)) for _ in range(15)]
    got = {(int(i), int(j)): int(d) for i, j, d in zip(*tries.any_order(index, queries, np.full(15, 2)), strict=True)}
    for i, q in enumerate(queries):
        for j, key in enumerate(index):
            best = min(sum(edits(x, y, 9) for x, y in zip(p, key.split(" "), strict=True)) for p in itertools.permutations(q.split(" ")))
            assert got.get((i, j), 3) == min(best, 3), (q, key)


def test_a_common_surname_does_not_pair_its_given_names(spark):
    given = [f"{a}{b}{c}ora" for a in "BCDFGHJK" for b in "aeiou" for c in "lmnr"]
    names = [f"{g.title()} Q. Wangson" for g in given]
    groups = variants.spellings(spark.createDataFrame([(n,) for n in [*names, "B. Wangson", "Wangson, Robert", "Bob Wangson"]], "lead_sponsor string"), "lead_sponsor")
    groups = groups.groupBy("group_id", *variants.KEY).agg({"n": "sum", "clean": "max", "careful": "max"}).withColumnsRenamed({"sum(n)": "n", "max(clean)": "clean", "max(careful)": "careful"})
    found = [(r["a_given"], r["b_given"]) for r in variants.candidates(groups).collect()]
    assert {x for x in found if "b" in x} == {y for g in given if g[0] == "B" for y in ((g.lower(), "b"), ("b", g.lower()))} | {("robert", "b"), ("b", "robert")}
    assert all("b" in x or x[0] == x[1] for x in found)


@pytest.mark.parametrize("most", [16, 1])
def test_large_shards_by_first_letters_equal_brute_force(spark, monkeypatch, most):
    for name, value in (("TRIE_ROWS", 10), ("QUERY_ROWS", 25), ("MOST_TRIES", most)):
        monkeypatch.setattr(tries, name, value)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(260)} | {"ab cdefg", "cdefg ab", "aa bb cc dd ee ff", "ff ee dd cc bb ax"})
    index = spark.createDataFrame([("s", w) for w in words] + [("t", "aaaaaa"), ("s", None)], "shard string, key string")
    limit = lambda n: 0 if n <= 3 else 1 if n <= 5 else 2
    want = {("s", q, k) for q in words for k in words if edits(q, k, 2) <= min(limit(len(q)), limit(len(k)))} | {("t", "aaaaaa", "aaaaaa")}
    want |= {("s", *p) for p in itertools.permutations(["ab cdefg", "cdefg ab"])} | {("s", *p) for p in itertools.permutations(["aa bb cc dd ee ff", "ff ee dd cc bb ax"])}
    assert {(r["shard"], r["query"], r["key"]) for r in tries.edit_join(index, index.withColumnRenamed("key", "query")).collect()} == want
    heads = tries.walk(["abcd", "abce", "zzzz"], ["abcdxy", "qabcd"], np.array([0, 1]), heads=True)
    assert set(zip(heads[0].tolist(), heads[1].tolist(), strict=True)) == {(0, 0), (1, 0)}
