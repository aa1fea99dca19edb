"""Names taken apart, the trie walk against plain edit distance, spelling clusters and record linkage."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import DATA, rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from larkspur.llm import linkage, tries, variants
from larkspur.llm.names import edits, given_agree, kind_of, parse


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Orvantil Therapeutics, Inc.", ("therapeutics", "orvantil", "inc", "", "", True)),
        ("Therapuetics, Orvantil", ("therapeutics", "orvantil", "", "", "", False)),
        ("ORVANTIL THERAPEUTICS INC. /QD/", ("therapeutics", "orvantil", "inc", "", "", False)),
        ("The Sawofon Tx Incorporated", ("therapeutics", "sawofon", "inc", "", "", False)),
        ("Bio-Tech, Suryaul, G.m.b.H.", ("biotechnologies", "suryaul", "gmbh", "", "", False)),
        ("Stëoleonis Biosciences L.L.C.", ("biosciences", "steoleonis", "llc", "", "", False)),
        ("MED HOSPTIAL OF MNEPOSR", ("hospital+medical", "mneposr", "", "", "", False)),
        ("Muklifil Med., Inc", ("medicines", "muklifil", "inc", "", "", False)),
        ("Children's  Hosptial, Mkalaurx", ("childrens+hospital", "mkalaurx", "", "", "", False)),
        ("The U. of Brobolx", ("university", "brobolx", "", "", "", False)),
        ("University of Brobolx", ("university", "brobolx", "", "", "", True)),
        ("Kodrudrinis Inc.", ("", "kodrudrinis", "inc", "", "", False)),
        ("Susan J. Gomagen", ("person", "gomagen", "", "susan", "j", True)),
        ("Gomagen, Sue", ("person", "gomagen", "", "susan", "", False)),
        ("Riairiro S J ", ("person", "riairiro", "", "s", "j", False)),
        ("BADEOMTAOR ROBERT", ("person", "badeomtaor", "", "robert", "", False)),
        ("William Yobanis, MD, PhD", ("person", "yobanis", "", "william", "", False)),
        ("", None), ("  ", None), (",.", None), (None, None),
    ],
)
def test_parse(name, want):
    assert parse(name) == want


def test_kinds_and_given_names():
    assert kind_of("labratories") == "laboratories" and kind_of("dx") == "diagnostics" and kind_of("orvantil") is None
    assert given_agree("alexander", "s") and given_agree("a", "alexander") and given_agree("", "x") and not given_agree("robert", "susan") and not given_agree("b", "susan")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc ", min_size=5, max_size=5), max_size=12), st.lists(st.tuples(st.text("abc ", max_size=8), st.integers(0, 2)), max_size=12))
def test_walk_equals_edit_distance(index, asked):
    queries = [q for q, _ in asked]
    got = tries.walk(index, queries, np.array([b for _, b in asked], int))
    want = {(i, j, edits(q, x, 9)) for i, (q, b) in enumerate(asked) for j, x in enumerate(index) if edits(q, x, 9) <= b}
    assert set(zip(*[x.tolist() for x in got], strict=True)) == want


def test_edit_join_splits_shards_and_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(150)] + ["ab cdefg", "cdefg ab"]
    index = spark.createDataFrame([("s", w) for w in words] + [("t", "aaaaaa"), ("s", None), ("s", ""), (None, "x")], "shard string, key string")
    queries = index.withColumnRenamed("key", "query")
    most = lambda n: 0 if n <= 3 else 1 if n <= 5 else 2
    distinct = sorted(set(words))
    want = {("s", q, k) for q in distinct for k in distinct if edits(q, k, 2) <= min(most(len(q)), most(len(k)))} | {("t", "aaaaaa", "aaaaaa"), ("s", "ab cdefg", "cdefg ab"), ("s", "cdefg ab", "ab cdefg")}
    for rows_per_trie in (20_000, 10):
        monkeypatch.setattr(tries, "TRIE_ROWS", rows_per_trie)
        monkeypatch.setattr(tries, "QUERY_ROWS", rows_per_trie)
        assert {(r["shard"], r["query"], r["key"]) for r in tries.edit_join(index, queries).collect()} == want
    assert tries.edit_join(index.limit(0), queries).count() == 0


def test_variant_pairs(spark):
    same = [
        ["Orvantil Therapeutics, Inc."] * 5 + ["Orvantl Therapeutics Inc", "ORVANTIL TX", "Therapeutics, Orvantil", "Orvanitl  Therapuetics, Inc. (USA)", " Orvantil Inc"],
        ["Orvantil Laboratories, Inc."], ["Seokau Genomics, Inc."] * 3 + ["SEOKAU GX"], ["Seokan Genomics, Inc."], ["University of Orvantil", "Orvantil Univ", "UNIVERSTY ORVANTIL"],
        ["Susan J. Gomagen", "Gomagen, Sue", "S.J. Gomagen", "Dr. Susan Gomagne"], ["Robert J. Gomagen"], ["Vemo Oncology Corp"], ["Vemo Oncology AG"],
    ]
    data = [(n, None, i) for group in same for i, n in enumerate(group)] + [(None, "x", 0), ("", "x", 0), ("  ", "x", 0)]
    got = variants.variant_pairs(spark.createDataFrame(data, "lead_sponsor string, name string, n int"), "lead_sponsor")
    # Without a kind, "Orvantil Inc" could be either company.
    apart = [[n for n in dict.fromkeys(g) if n != " Orvantil Inc"] for g in same]
    assert rows(got) == sorted(tuple(sorted((a, b))) for g in apart for i, a in enumerate(g) for b in g[:i])


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([(None,), ("",)], "lead_sponsor string")
    assert variants.variant_pairs(empty, "lead_sponsor").count() == 0 and variants.variant_pairs(empty.limit(0), "lead_sponsor").count() == 0


def test_estimate_recovers_what_agrees():
    rng = np.random.default_rng(0)
    counts: dict[tuple, int] = {}
    for _ in range(6000):
        match = rng.random() < 0.3
        pick = lambda p_match, p_not: int(rng.random() < (p_match if match else p_not))
        row = (5 if pick(0.9, 0.05) else 0, None if rng.random() < 0.5 else 2 * pick(0.95, 0.01), pick(0.8, 0.1), pick(0.9, 0.2), None)
        counts[row] = counts.get(row, 0) + 1
    patterns = [dict(zip(linkage.LEVELS, k, strict=True)) | {"n": n} for k, n in counts.items()]
    share, m, u = linkage.estimate(patterns)
    assert abs(share - 0.3) < 0.05 and m["name"][5] > 0.8 and u["name"][5] < 0.12 and m["number"][2] > 0.85 and u["number"][2] < 0.08


def test_link(spark):
    companies = spark.createDataFrame(
        [("AA", "0000000101", "ORVANTIL THERAPEUTICS INC /QD/", "Biologics"), ("BB", None, "Suryaul Genomics Corp", None), ("CC", "CIK0000000303", "Vemolix Oncology LLC", None), (None, "9", "x", None)],
        "ticker string, cik string, name string, sector string",
    ).withColumn("entity", F.lit("clash"))
    rng = random.Random(4)
    filler = [(f"T{i}", f"{7000 + 137 * i:010d}", "".join(rng.choice("abcdeiklmnorstuvz") for _ in range(9)).title() + " Genomics Corp", "Bio research") for i in range(60)]
    companies = companies.unionByName(spark.createDataFrame(filler, "ticker string, cik string, name string, sector string").withColumn("entity", F.lit("clash")))
    filers = spark.createDataFrame(
        [(1, 101, "Orvantil Therapeutics", None, "Ardmouth", "QA", "2836"), (1, 101, "Orvantil Therapeutics", None, "Ardmouth", "QA", "2836"), (2, 202, "SURYAUL GENOMICS", None, "Belquay", "QB", None),
         (3, 303, "Vemolix Oncology", "TRASSO BIOLOGICS", "Corvane", "QC", "2836"), (4, 404, "Orvantil Laboratories", None, "Corvane", "QD", None), (5, None, None, None, None, None, None)]
        + [(100 + i, 7000 + 137 * i, n, None, f"{n[:5]}ville", f"Q{n[1].upper()}", "8731") for i, (_, _, n, _) in enumerate(filler)],
        "filer_id long, cik_str long, title string, former_title string, city string, state_code string, sic string",
    )
    records = [
        (1, "Orvantil Therapuetics, Inc.", "Ardmouth", "QA", "cik:0000000101", "biologic drugs"), (2, "ORVANTL TX", "ARDMOUTH, QA", "QA", None, None), (2, "ORVANTL TX", "ARDMOUTH, QA", "QA", None, None),
        (3, "Suryaul Genomics Corp", "Belquay", "QB", None, None), (4, "Trasso Biologics", "Corvane", None, "...0303", None), (5, "University of Orvantil", "Eskfield", "QE", None, None),
        (6, "Orvantil Laboratories", "Corvane", "QD", None, None), (7, None, None, None, None, None), (None, "Orvantil Therapeutics", None, None, None, None), (8, "", "x", "y", "-", "z"),
    ] + [(100 + i, n, f"{n[:5]}ville", f"Q{n[1].upper()}", c if i % 3 else None, "research services") for i, (_, c, n, _) in enumerate(filler)]
    got = linkage.link(spark.createDataFrame(records, "record_id long, lead_sponsor string, city string, state_code string, cik_text string, focus string").withColumn("ticker", F.lit("clash")), companies, filers)
    found = {r["record_id"]: r["ticker"] for r in got.collect()}
    assert {k: v for k, v in found.items() if k < 100} == {1: "AA", 2: "AA", 3: "BB", 4: "CC"}
    assert all(found.get(100 + i) == t for i, (t, *_) in enumerate(filler))
    assert all(0.5 <= r["confidence"] <= 1 for r in got.collect())


def test_link_empty(spark):
    from larkspur.session import table

    r, c, f = (table(spark, DATA, t) for t in ("sponsor_records", "companies", "filer_records"))
    assert linkage.link(r.limit(0), c, f).count() == 0
    assert linkage.link(r, c.limit(0), f.limit(0)).count() == 0


def test_roots_follow_chains_of_any_length(spark):
    from larkspur.session import checkpoint_ready

    checkpoint_ready(spark)
    groups = spark.range(1, 42).withColumnRenamed("id", "group_id")
    parent = groups.where("group_id between 2 and 40").select("group_id", (F.col("group_id") - 1).alias("parent"))
    assert {r["group_id"]: r["root"] for r in variants.roots(groups, parent).collect()} == {k: 1 for k in range(1, 41)} | {41: 41}
