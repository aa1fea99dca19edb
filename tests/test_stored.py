"""Stored tables that survive a lost pointer, versions of very long histories, the newest load first, and small pieces."""

from __future__ import annotations

import itertools
import os
import shutil

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F
from test_snapshots import at, frames

from larkspur.functions import display
from larkspur.operators import companies as C, scores, snapshots as S, vectors
from larkspur.sources import landing as L, warehouse

T = "company_ticker string, nct_id string, summary string, v array<float>"


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "company_ticker string")


def short(df):
    return rows(df.select("company_ticker", "nct_id"))


def test_a_lost_version_loses_no_row(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([("A", "1", "x", None), ("B", "2", "y", None)], T)
    warehouse.ingest(spark, root, "t", first, keys(spark, "A", "B"))
    warehouse.ingest(spark, root, "t", spark.createDataFrame([("A", "3", "x", None)], T), keys(spark, "A"))
    assert short(warehouse.current(spark, root, "t")) == [("A", "3"), ("B", "2")]
    # The newest version file is gone, as if its writer had died before the rename: the version before stands whole.
    for f in ("000000000002", ".000000000002.crc"):
        os.remove(tmp_path / "t/versions" / f)
    assert short(warehouse.current(spark, root, "t")) == [("A", "1"), ("B", "2")]
    warehouse.ingest(spark, root, "t", spark.createDataFrame([("A", "4", "x", None)], T), keys(spark, "A"))
    assert short(warehouse.current(spark, root, "t")) == [("A", "4"), ("B", "2")]
    # No version is left at all: that is an error and not an empty table.
    for f in (tmp_path / "t/versions").iterdir():
        f.unlink()
    with pytest.raises(RuntimeError):
        warehouse.ingest(spark, root, "t", first, keys(spark, "A"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    names = [f"C{i}" for i in range(40)]
    warehouse.ingest(spark, str(tmp_path), "t", spark.createDataFrame([(n, n, None, None) for n in names], T), keys(spark, *names))
    before = {p.name for p in (tmp_path / "t/data").iterdir()}
    warehouse.ingest(spark, str(tmp_path), "t", spark.createDataFrame([], T), keys(spark, "C3", None))
    new = [p for p in (tmp_path / "t/data").iterdir() if p.name not in before]
    assert len(new) == 1 and len([d for d in new[0].iterdir() if d.is_dir()]) <= 1
    assert short(warehouse.current(spark, str(tmp_path), "t")) == sorted(((n, n) for n in names if n != "C3"), key=repr)
    assert warehouse.vacuum(spark, str(tmp_path), "t", keep=1) == 0
    assert warehouse.current(spark, str(tmp_path), "t").count() == 39


def test_a_second_writer_of_one_version_fails(spark, tmp_path):
    warehouse.ingest(spark, str(tmp_path), "t", spark.createDataFrame([("A", "1", None, None)], T), keys(spark, "A"))
    version = {"key": "company_ticker", "buckets": 64, "schema": spark.createDataFrame([], T).schema.jsonValue(), "parts": {}}
    with pytest.raises(Exception, match="(?i)exist"):
        warehouse._publish(spark, str(tmp_path), "t", 1, version)
    assert warehouse.current(spark, str(tmp_path), "t").count() == 1


def test_vectors_are_carried_and_filled(spark, tmp_path):
    root = str(tmp_path)
    warehouse.ingest(spark, root, "t", spark.createDataFrame([("A", "1", "same", [1.0]), ("A", "2", "old", [2.0]), ("B", "3", None, None)], T), keys(spark, "A", "B"))
    new = spark.createDataFrame([("A", "1", "same", None), ("A", "2", "new", None)], T)
    warehouse.ingest(spark, root, "t", new, keys(spark, "A"), carry=("nct_id", "summary", "v"))
    assert rows(warehouse.current(spark, root, "t").select("nct_id", "v")) == [("1", [1.0]), ("2", None), ("3", None)]
    ids = lambda df: df.withColumn("id", F.col("nct_id").cast("long"))
    warehouse.ingest(spark, root, "u", ids(new), keys(spark, "A"))
    filled = warehouse.embed_stored(spark, root, "u", lambda x: np.array([[len(t)] for t in x]), "id", "summary", "v")
    assert rows(filled.select("nct_id", "v")) == [("1", [4.0]), ("2", [3.0])]
    shutil.rmtree(tmp_path / "u")
    with pytest.raises(ValueError, match="no table"):
        warehouse.embed_stored(spark, root, "u", lambda x: x, "id", "summary", "v")


def test_a_very_long_history_is_merged_in_bounded_memory():
    size, batches = 10_000, 200

    def stream():
        for k in range(batches):
            seq = np.arange(k * size, (k + 1) * size, dtype=np.int32)
            state = np.where(seq < 1_500_000, "a", "b")
            same = pa.array(state)
            yield pa.record_batch({"entity": pa.array(["A"] * size), "item": pa.array(["x"] * size), "load_seq": pa.array(seq), "__same": same, "status": same})

    before, out = pa.total_allocated_bytes(), []
    for batch in S.closed_versions(stream(), ["status"]):
        out += batch.to_pylist()
        assert pa.total_allocated_bytes() - before < 20_000_000
    assert [(r["__from"], r["__to"], r["status"]) for r in out] == [(0, 1_499_999, "a"), (1_500_000, 1_999_999, "b")]


@pytest.mark.parametrize("cut", [1, 2, 3, 7])
def test_versions_do_not_depend_on_batches(cut):
    data = [("A", "x", 1, "1"), ("A", "x", 2, "1"), ("A", "x", 4, "1"), ("A", "y", 4, "1"), ("B", "y", 5, "1"), ("B", "y", 6, "2"), ("B", "y", 7, "2")]
    columns = ["entity", "item", "load_seq", "__same"]
    batch = lambda part: pa.record_batch([pa.array(list(c), pa.int32() if n == "load_seq" else pa.string()) for n, c in zip(columns, zip(*part, strict=True), strict=True)], columns)
    parts = [batch(p) for p in itertools.batched(data, cut)]
    got = [(r["entity"], r["item"], r["__from"], r["__to"]) for b in S.closed_versions(iter([batch(data[:1]).slice(1), *parts]), []) for r in b.to_pylist()]
    assert got == [("A", "x", 1, 2), ("A", "x", 4, 4), ("A", "y", 4, 4), ("B", "y", 5, 5), ("B", "y", 6, 7)]


@pytest.mark.parametrize("failed", [[], [(4, "A")], [(3, "A"), (4, "A"), (4, "B")], [(1, "A"), (2, "A"), (3, "A"), (4, "A")]])
def test_newest_states_equal_the_last_of_all_states(spark, failed):
    data = [(i, f"N{i % 3}", "ABC"[i % 3 - i % 2], "xyz"[i % 3], at(i % 6, i % 5)) for i in range(40)] + [(90, None, "A", "x", at(4)), (91, "N1", None, "x", at(4)), (92, "N1", "A", "x", None)]
    t, loads, log = frames(spark, data, failed)
    args = ("registry", F.col("nct_id"), [F.col("status")])
    want = C.newest_load(S.states(t, loads, log, *args), loads)
    assert rows(S.newest_states(t, loads, log, *args)) == rows(want)
    assert rows(S.newest_states(t, loads, None, *args)) == rows(C.newest_load(S.states(t, loads, None, *args), loads))
    assert S.newest_states(t, loads.limit(0), log, *args).count() == 0


def test_the_newest_load_bounds_the_scan(spark):
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    df = C.pipeline_summary(C.current_trials(read("trials"), read("loads"), read("fetch_log")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    scans = [line for line in plan.splitlines() if "trials.parquet" in line]
    assert scans and all("GreaterThanOrEqual(fetched_at" in line or "fetched_at" in line.split("DataFilters")[1].split("Format")[0] for line in scans)


def test_states_are_found_without_nested_loops(spark):
    t, loads, log = frames(spark, [(1, "N1", "A", "x", at(1))])
    plan = S.changes(S.states(t, loads, log, "registry", F.col("nct_id"), [F.col("status")]), loads, ["status"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scores_with_nulls_and_repeated_rows(spark):
    s = "question string, item string"
    system = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "b"), (None, "a"), ("q", None)], s)
    truth = spark.createDataFrame([("q", "b"), ("q", "c"), ("r", "z")], s)
    got = rows(scores.set_scores(system, truth, spark.createDataFrame([("q",), ("r",), ("none",)], "question string")))
    assert got == [("none", 0, 0, 0, 1.0, 1.0, True, "", ""), ("q", 2, 2, 1, 0.5, 0.5, False, "c", "a"), ("r", 0, 1, 0, 0.0, 0.0, False, "z", "")]


def test_one_decimal_equals_exact_rounding(spark):
    rng = np.random.default_rng(3)
    values = [0.0, -0.04, 0.05, 0.15, 0.25, 0.35, 0.75, 2.5, 9.95, 9.949999999999999, 0.45, -1.25, 1e9 + 0.25, *(rng.integers(0, 4000, 300) / 40), *rng.uniform(0, 100, 300)]
    values = [float(v) for v in values]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", display.one_decimal(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [f"{v:.1f}".replace("-0.0", "0.0") for v in values]
    assert spark.range(1).select(display.one_decimal(F.lit(None).cast("double")).alias("t")).first()["t"] is None


def test_reasons_fallbacks_and_labels(spark):
    c = spark.createDataFrame([("A", "Alpha Inc"), ("B", "Beta Corp"), ("D", None)], "ticker string, name string")
    n = spark.createDataFrame([("A", "1"), ("B", "2"), ("D", None)], "ticker string, cik string")
    f = spark.createDataFrame([("A", 1, "cash", 2024, 5)], "ticker string, id long, metric string, fiscal_year int, value long")
    got = {r["ticker"]: r["financials"] for r in C.figures_with_reason(c, n, f).collect()}
    assert got["A"]["available"] and got["A"]["cash"]["value"] == 5 and got["A"]["rd_expense"] is None
    assert got["B"]["reason"] == "no figures" and got["D"]["reason"] == "no filer number"
    t = spark.createDataFrame([("A", 1, "N1", "PHASE1", None), ("A", 2, "N2", "PHASE1", "COMPLETED")], "ticker string, id long, nct_id string, phase string, status string")
    d = {r["ticker"]: r for r in C.company_detail(c, t, C.figures_with_reason(c, n, f)).collect()}
    assert d["A"]["pipeline"]["by_status"] == {"COMPLETED": 1, "UNKNOWN": 1} and len(d["A"]["trials"]) == 2
    assert d["B"]["pipeline"]["total"] == 0 and d["B"]["trials"] is None
    studies = spark.createDataFrame([("A", 1, "ALPHA labs"), ("B", 1, None), ("D", 1, "x")], "ticker string, position long, lead_sponsor string")
    assert rows(L.has_trials(c, studies).select("ticker")) == [("A",)]
    both = L.stored_else_landed(c.where("ticker = 'A'"), c, "ticker")
    assert rows(both.select("ticker", "from_store")) == [("A", True), ("B", False), ("D", False)]
    labels = spark.createDataFrame([("1",), ("9",), (None,)], "c string").select(display.labelled(F.col("c"), {"1": "one"}).alias("l"))
    assert rows(labels) == [("one",), (None,), (None,)] or rows(labels) == [(None,), (None,), ("one",)]
    assert rows(C.unlisted(spark.createDataFrame([("a",), ("b",), ("",), (None,)], "s string"), spark.createDataFrame([("a",), (None,)], "s string"), "s")) == [("b",)]


def test_missing_file_falls_back_and_blobs_round_trip(spark, tmp_path):
    fallback = spark.createDataFrame([("A", "a")], "ticker string, name string")
    assert rows(L.read_or(spark, str(tmp_path / "no.json"), "ticker string, name string", fallback)) == [("A", "a")]
    (tmp_path / "yes.json").write_text('{"ticker": "B", "name": "b"}\nnot json\n')
    assert rows(L.read_or(spark, str(tmp_path / "yes.json"), "ticker string, name string", fallback)) == [("B", "b")]
    v = spark.createDataFrame([([1.5, -2.0],), (None,), ([],)], "v array<float>").select(vectors.unpacked(vectors.packed("v")).alias("v"))
    assert sorted((r["v"] for r in v.collect()), key=repr) == [None, [1.5, -2.0], []] or sorted((r["v"] for r in v.collect()), key=repr) == sorted([None, [1.5, -2.0], []], key=repr)
    assert spark.createDataFrame([(b"abc",)], "b binary").select(vectors.unpacked("b").alias("v")).first()["v"] is None
