"""Flattening of landed records, picks and merges, stored tables and the stream over landed pages."""

from __future__ import annotations

import json

from conftest import rows
from pyspark.sql import functions as F

from larkspur.sources import landing as L, warehouse
from larkspur.streaming.landing import stream_studies


def page(ticker, *studies, error=None):
    return {"search_name": ticker, "company_ticker": ticker, "error": error, "studies": [{"protocolSection": s} for s in studies]}


def study(nct, **parts):
    return {"identificationModule": {"nctId": nct, "briefTitle": "t"}, **parts}


def landed(path, name, *pages):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(map(json.dumps, pages)))
    return str(path)


def test_flatten_studies(spark, tmp_path):
    full = study(
        "N1", designModule={"phases": ["PHASE2", "PHASE3"]}, statusModule={"overallStatus": "RECRUITING"}, sponsorCollaboratorsModule={"leadSponsor": {"name": "S"}},
        descriptionModule={"briefSummary": "sum"}, conditionsModule={"conditions": ["a", "b"]}, armsInterventionsModule={"interventions": [{"name": "x"}, {"name": ""}, {}, {"name": "y"}]},
        eligibilityModule={"eligibilityCriteria": "e" * 3000},
    )
    pages = L.read_pages(spark, landed(tmp_path / "p", "a.json", page("A", full, study("N2"), study("N3", designModule={"phases": []})), page("B", error="timeout"), page("C")))
    got = {r["nct_id"]: r for r in L.flatten_studies(pages).collect()}
    assert set(got) == {"N1", "N2", "N3"}
    assert got["N1"]["phase"] == "PHASE2, PHASE3" and got["N2"]["phase"] == got["N3"]["phase"] == "N/A"
    assert got["N1"]["summary"].startswith("sum\nConditions: a, b\nInterventions: x, y\neee") and len(got["N1"]["summary"]) == 2000
    assert got["N2"]["status"] is None and got["N2"]["summary"] == ""
    assert L.flatten_studies(pages.limit(0)).count() == 0


def test_annual_figures_pick_the_latest_year_and_the_first_of_ties(spark, tmp_path):
    e = lambda fy, val, fp="FY", form="10-K": {"fp": fp, "form": form, "fy": fy, "val": val}
    data = [
        ("1", "T1", None, {"USD": [e(2023, 1.0), e(2024, 2.0), e(2024, 3.0), e(2025, 9.0, fp="Q3"), e(2026, 9.0, form="10-Q")], "EUR": [e(2024, 8.0)]}),
        ("1", "T2", None, {"USD": [e(2024, 7.0)]}),
        ("2", "T1", None, {"USD": [e(2022, 1.0)]}), ("2", "T2", None, {"USD": [e(2024, 5.0, form="20-F/A")]}), ("3", "T1", "404", None), ("4", "T9", None, {"USD": [e(2024, 1.0)]}),
    ]
    (tmp_path / "c.json").write_text("\n".join(json.dumps(dict(zip(("cik", "tag", "error", "units"), d, strict=True))) for d in data))
    concepts = L.read_concepts(spark, str(tmp_path / "c.json"))
    assert rows(L.annual_figures(concepts, ["T1", "T2"])) == [("1", "T1", 2.0, 2024), ("2", "T2", 5.0, 2024)]
    assert rows(L.annual_figures(concepts.limit(0), ["T1"])) == []


def test_universe(spark):
    text = json.dumps({"0": {"cik_str": 1, "ticker": "aa", "title": "A one"}, "1": {"cik_str": 2, "ticker": "B", "title": "B"}, "2": {"cik_str": 1, "ticker": "AB", "title": "A two"}})
    tickers = L.ticker_map(spark.createDataFrame([(text,)], "value string"))
    pages = spark.createDataFrame([("Biologics", 0, "<cik>0000000001</cik>..<cik>0000000002</cik>"), ("Research", 1, "<cik>0000000001</cik><cik>0000000009</cik>")], "sector string, page int, body string")
    listing = L.listed_ids(pages, "body").withColumnRenamed("found", "cik").withColumn("position", F.col("page") * 1000 + F.col("position"))
    have_trials = spark.createDataFrame([("AB",), ("AB",), ("B",)], "ticker string")
    have_figures = spark.createDataFrame([("0000000001",)], "cik string")
    got = L.universe(listing, tickers, have_trials, have_figures)
    assert rows(got) == [("AB", "A two", "0000000001", "Biologics")]


def test_universe_file_round_trip(spark, tmp_path):
    u = spark.createDataFrame([("B", "b", "2", None), ("A", "a", "1", "s")], L.UNIVERSE)
    L.write_universe(u, str(tmp_path / "u"))
    assert rows(spark.read.schema(L.UNIVERSE).json(str(tmp_path / "u"))) == [("A", "a", "1", "s"), ("B", "b", "2", None)]
    (tmp_path / "one.json").write_text(json.dumps([{"ticker": "A", "name": "a"}]))
    assert rows(L.read_universe(spark, str(tmp_path / "one.json"))) == [("A", "a", None, None)]


def test_picks_and_overrides(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", None, "z"), ("b", None, "w")], "k string, o int, v string")
    assert rows(L.first_wins(df, "k", "o").select("k", "v")) == [("a", "y"), ("b", "w")]
    assert rows(L.last_wins(df, "k", "o").select("k", "v")) == [("a", "x"), ("b", "w")]
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    assert rows(L.overridden(base, spark.createDataFrame([("b", "9"), ("c", "8")], "k string, v string"), "k")) == [("a", "1"), ("b", "9"), ("c", "8")]


T = "company_ticker string, nct_id string"


def test_replaced_keeps_failed_keys_and_drops_vanished_rows(spark):
    old = spark.createDataFrame([("A", "1"), ("B", "2"), ("C", "3"), (None, "4")], T)
    new = spark.createDataFrame([("A", "5"), ("D", "6"), ("X", "7")], T)
    fetched = spark.createDataFrame([("A",), ("A",), ("C",), ("D",)], "company_ticker string")
    assert rows(warehouse.replaced(old, new, fetched, "company_ticker")) == sorted([("A", "5"), ("B", "2"), ("D", "6"), (None, "4")], key=repr)
    assert rows(warehouse.replaced(old.limit(0), new.limit(0), fetched, "company_ticker")) == []


def test_vectors_are_carried_over_by_text(spark):
    s = "nct_id string, summary string, v array<float>"
    old = spark.createDataFrame([("1", "same", [1.0]), ("1", "same", [1.0]), ("2", "old", [2.0]), ("3", None, [3.0])], s)
    new = spark.createDataFrame([("1", "same", None), ("2", "new", None), ("3", None, None), ("1", "same", [9.0])], s)
    assert rows(warehouse.carry_vectors(new, old, "summary", "v")) == sorted([("1", "same", [1.0]), ("2", "new", None), ("3", None, None), ("1", "same", [9.0])], key=repr)


def test_stream_replaces_companies_and_leaves_failed_ones(spark, tmp_path):
    root, check = str(tmp_path / "w"), str(tmp_path / "c")
    folder = landed(tmp_path / "in", "1.json", page("A", study("N1"), study("N2")), page("B", study("N3")))
    stream_studies(spark, folder, root, check).awaitTermination()
    assert rows(warehouse.current(spark, root, "trials").select("company_ticker", "nct_id")) == [("A", "N1"), ("A", "N2"), ("B", "N3")]
    landed(tmp_path / "in", "2.json", page("A", study("N9")), page("B", error="429"))
    stream_studies(spark, folder, root, check).awaitTermination()
    assert rows(warehouse.current(spark, root, "trials").select("company_ticker", "nct_id")) == [("A", "N9"), ("B", "N3")]
    assert warehouse.current(spark, root, "nothing") is None
