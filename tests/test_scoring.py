"""Claims, set scores and exact vector search."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from larkspur.operators import claims as C, scores, vectors as V


def one(spark, expr, *texts):
    names = [f"t{i}" for i in range(len(texts))]
    return spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names)).select(expr(*map(F.col, names))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("$7.675 billion or 7,675,000,000", [7675.0]), ("$5 bananas", [5000.0]), ("$,", []), ("", []), (None, None), ("about 12 million and $12M", [12.0]), ("$500,000", [0.5]), ("1,234,567 rows", [1.234567]), ("$3k", [0.003]),
    ],
)
def test_amounts(spark, text, want):
    assert one(spark, C.amounts, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("has 76 trials", [("76", "trials")]), ("more than 30 active trials", []), ("over 5 Trials", []), ("at least 3 studies, 4 programs", [("4", "programs")]), ("over the moon there are 12 active", [("12", "active")]),
        ("under a 1 trial", []), ("", []),
    ],
)
def test_counts_skip_thresholds(spark, text, want):
    assert [tuple(x) for x in one(spark, C.counts, text)] == want


def test_claims(spark):
    got = one(spark, C.claims, "NCT12 has 5 trials worth $100M, recruiting.", "NCT123 with 15 trials, ACTIVE_NOT_RECRUITING, $102 million")
    assert {tuple(x) for x in got} == {("money", "$100M", True), ("count", "5 trials", False), ("trial", "NCT12", True), ("status", "RECRUITING", True)}
    assert one(spark, C.claims, None, None) == []


def test_groundedness_is_one_without_claims(spark):
    df = spark.createDataFrame([("a", "5 trials", "5"), ("a", "6 trials", "5"), ("b", "nothing", ""), ("c", None, None)], "k string, x string, y string")
    assert rows(C.groundedness(df, "x", "y", ["k"])) == [("a", 2, 1, 0.5), ("b", 0, 0, 1.0), ("c", 0, 0, 1.0)]
    assert rows(C.groundedness(df.limit(0), "x", "y")) == [(0, 0, 1.0)]


def test_set_scores(spark):
    s = "question string, item string"
    system = spark.createDataFrame([("q1", "a"), ("q1", "a"), ("q1", "b"), ("q3", "x")], s)
    truth = spark.createDataFrame([("q1", "b"), ("q1", "c"), ("q2", "y")] + [("q5", f"i{k}") for k in range(9)], s)
    questions = spark.createDataFrame([(f"q{i}",) for i in range(1, 6)], "question string")
    got = {r["question"]: r for r in scores.set_scores(system, truth, questions).collect()}
    assert (got["q1"]["precision"], got["q1"]["recall"], got["q1"]["exact"], got["q1"]["missed"], got["q1"]["extra"]) == (0.5, 0.5, False, "c", "a")
    assert (got["q2"]["precision"], got["q2"]["recall"]) == (0.0, 0.0)
    assert (got["q3"]["precision"], got["q3"]["recall"]) == (0.0, 1.0)
    assert (got["q4"]["precision"], got["q4"]["recall"], got["q4"]["exact"]) == (1.0, 1.0, True)
    assert got["q5"]["missed"] == "i0,i1,i2,i3,i4,i5"
    assert scores.mean_scores(scores.set_scores(system, truth, questions)).first()["exact"] == pytest.approx(0.2)
    assert scores.refusal_rate(spark.createDataFrame([("refuse",), ("filter",), (None,), ("refuse",)], "intent string")).first()[0] == 0.5


def test_topk_floor_ties_and_unusable(spark):
    data = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.4, 0.916515138991168]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0]), (8, [float("nan"), 1.0])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    assert [r["id"] for r in V.topk(df, [3.0, 0.0], 8, 0.39).collect()] == [1, 3, 2]
    assert [r["id"] for r in V.topk(df, [3.0, 0.0], 2, 0.39).collect()] == [1, 3]
    assert V.topk(df, [0.0, 0.0], 8, 0.0).count() == 0 and V.topk(df, [-1.0, 0.0], 8, 0.4).count() == 0


def test_topk_per_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 40)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 8)).round(2)
    x[5] = x[6] = x[7]
    data = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    q = df.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]) for r in V.topk_per_query(df, q, 4, 0.3, 8).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = set()
    for i in range(0, 120, 5):
        s = np.round(u @ u[i], 9)
        want |= {(i, j) for j in sorted((j for j in range(120) if j != i and s[j] >= 0.3), key=lambda j: (-s[j], j))[:4]}
    assert got == want
    assert V.topk_per_query(df.limit(0), q, 4, 0.3, 8).count() == 0


def test_pending_and_embedding(spark):
    df = spark.createDataFrame([(1, "ab", None), (2, "", None), (3, None, None), (4, "x", [1.0])], "id long, t string, v array<float>")
    todo = V.pending(df, "t", "v")
    assert [r["id"] for r in todo.collect()] == [1]
    done = V.embedded(todo, lambda texts: np.array([[len(t), 1.0] for t in texts]), "id", "t")
    assert rows(done) == [(1, [2.0, 1.0])]
