"""The company screen on hand-made rows: every rule on and around its boundary."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from larkspur.functions.display import escaped, grouped, linked, linked_ticker, millions, ratio, short_money, snippet
from larkspur.functions.names import core_name, first_core_word, padded_id, search_term, sponsor_matches
from larkspur.operators import companies as op
from larkspur.operators.companies import CompanyFilter
from larkspur.plans.screen import Plan, run_plan

TRIALS = "ticker string, nct_id string, phase string, status string"
FIGURES = "ticker string, id long, metric string, fiscal_year int, value double"


@pytest.fixture(scope="module")
def summary(spark):
    companies = spark.createDataFrame(
        [("A", "Alpha", "Biologics", "x"), ("B", "Beta", None, "x"), ("C", "Gamma", "biologics", "x"), ("D", "Delta", "", "x"), ("E", "Eps", "Bio research", "x")],
        "ticker string, name string, sector string, value string",
    )
    trials = spark.createDataFrame(
        [("A", "N1", "PHASE2, PHASE3", "RECRUITING"), ("A", "N2", "PHASE1", "TERMINATED"), ("C", "N3", None, None), ("C", "N4", "PHASE1", "RECRUITING"), ("E", "N5", "PHASE4", "COMPLETED")], TRIALS
    )
    figures = spark.createDataFrame(
        [
            ("A", 1, "cash", 2024, 9977.0), ("A", 2, "rd_expense", 2024, 10000.0), ("B", 3, "cash", 2024, 5.0), ("C", 4, "cash", 2024, 0.0), ("C", 5, "rd_expense", 2024, 100.0),
            ("D", 6, "cash", 2024, 100.0), ("D", 7, "rd_expense", 2024, 0.0), ("E", 8, "cash", 2023, 1.0), ("E", 9, "cash", 2024, None), ("E", 10, "rd_expense", None, 7.0),
        ], FIGURES,
    )
    return op.company_summary(companies, trials, figures).cache()


def tickers(df):
    return sorted(r["ticker"] for r in df.collect())


def test_companies_without_trials_or_figures_stay(summary):
    got = {r["ticker"]: r for r in summary.collect()}
    assert got["B"]["total_trials"] == 0 and got["B"]["has_phase3"] is False
    assert got["E"]["cash_value"] == 1.0 and got["E"]["rd_value"] is None
    assert got["C"]["runway"] == 0.0 and got["D"]["runway"] is None
    assert got["A"]["late_trials"] == 1 and got["A"]["active_trials"] == 1 and got["A"]["terminated_trials"] == 1


def test_bounds_are_inclusive_and_missing_figures_fail_them(summary):
    assert tickers(CompanyFilter(min_rd=0).apply(summary)) == ["A", "C", "D"]
    assert tickers(CompanyFilter(min_cash=5).apply(summary)) == ["A", "B", "D"]
    assert tickers(CompanyFilter(min_runway=1).apply(summary)) == []
    assert tickers(CompanyFilter(min_runway=0.9977).apply(summary)) == ["A"]
    assert tickers(CompanyFilter(min_active_trials=1).apply(summary)) == ["A", "C"]


def test_three_states_of_late_stage_and_case_of_sectors(summary):
    assert tickers(CompanyFilter(has_phase3=True).apply(summary)) == ["A", "E"]
    assert tickers(CompanyFilter(has_phase3=False).apply(summary)) == ["B", "C", "D"]
    assert tickers(CompanyFilter().apply(summary)) == ["A", "B", "C", "D", "E"]
    assert tickers(CompanyFilter(sector="BIOLOGICS").apply(summary)) == ["A", "C"]
    assert tickers(CompanyFilter(sector="").apply(summary)) == ["A", "B", "C", "D", "E"]


def test_sorting_puts_missing_values_last_and_breaks_ties_by_ticker(summary):
    order = lambda *a: [r["ticker"] for r in op.ranked(summary, *a).collect()]
    assert order("cash") == ["A", "D", "B", "E", "C"]
    assert order("rd") == ["A", "C", "D", "B", "E"]
    assert order("runway") == ["A", "C", "B", "D", "E"]
    assert order(None) == order("nonsense") == ["A", "B", "C", "D", "E"]
    assert order("cash", 0) == order("cash") and order("cash", 2) == ["A", "D"]


def test_plans(summary):
    filtered = run_plan(Plan.from_json('{"intent": "filter", "filters": {"min_cash": 5, "unknown": 1}, "sort_by": "cash", "limit": 2}'), summary)
    assert [(r["ticker"], r["matches"]) for r in filtered.collect()] == [("A", 3), ("D", 3)]
    assert tickers(run_plan(Plan.from_json('{"intent": "company", "ticker": "a"}'), summary)) == ["A"]
    assert tickers(run_plan(Plan.from_json('{"intent": "company", "ticker": "Alpha"}'), summary)) == []
    assert tickers(run_plan(Plan.from_json('{"intent": "greeting"}'), summary)) == []


def test_latest_and_repeated_figures(spark):
    f = spark.createDataFrame(
        [("A", 2, "cash", 2024, 2.0), ("A", 1, "cash", 2024, 1.0), ("A", 3, "cash", 2023, 9.0), ("A", 4, "cash", 2025, None), ("B", 5, "cash", None, 3.0), ("B", 6, "rd_expense", 2020, 4.0)], FIGURES
    )
    assert rows(op.latest_annual(f)) == [("A", "cash", 1.0, 2024), ("B", "rd_expense", 4.0, 2020)]
    assert rows(op.pick_by_id(f, True)) == [("A", None, 9.0), ("B", 4.0, 3.0)]
    assert rows(op.pick_by_id(f, False)) == [("A", None, 1.0), ("B", 4.0, 3.0)]


def test_newest_load_and_clashing_columns(spark):
    loads = spark.createDataFrame([(1, datetime(2025, 1, 1)), (2, datetime(2025, 2, 1))], "load_id int, started_at timestamp_ntz")
    log = spark.createDataFrame([(2, "B", "registry", "failed")], "load_id int, company_ticker string, feed string, outcome string")
    t = spark.createDataFrame(
        [(1, "N1", "A", "t", "phase 3", "Recruiting", "s", datetime(2025, 1, 2), 0), (2, "N2", "B", "t", None, None, None, datetime(2025, 1, 2), 0), (3, "N1", "A", "t", "n/a", "Completed", "s", datetime(2025, 2, 2), 0)],
        "id long, nct_id string, company_ticker string, title string, phase string, status string, lead_sponsor string, fetched_at timestamp_ntz, ticker int",
    )
    got = op.current_trials(t, loads, log).select("ticker", "nct_id", "id", "phase", "status")
    assert rows(got) == [("A", "N1", 3, "N/A", "COMPLETED"), ("B", "N2", 2, "", None)]
    assert rows(op.current_trials(t.limit(0), loads, log)) == []


def test_buckets_and_bars(spark):
    df = spark.createDataFrame([("PHASE2, PHASE3",), ("EARLY_PHASE1",), ("N/A",), (None,), ("PHASE4",)], "p string")
    assert [r[0] for r in df.select(op.phase_bucket(F.col("p"))).collect()] == ["3", "1", "none", "none", "4"]
    bars = op.bar_heights(spark.createDataFrame([("A", 4), ("A", 1), ("A", 0), ("B", 0)], "ticker string, n long"), "ticker", "n")
    assert rows(bars) == [("A", 0, 3), ("A", 1, 36), ("A", 4, 126), ("B", 0, 3)]


@pytest.mark.parametrize(
    ("name", "core", "term", "word"),
    [
        ("FATE THERAPEUTICS INC", "fate therapeutics", "FATE THERAPEUTICS", "fate"), ("Holdings Inc", "", "Holdings Inc", ""), ("Fate Inc", "fate", "Fate", "fate"),
        ("Schrödinger, Inc.", "schrdinger", "Schrdinger", "schrdinger"), ("Co Diagnostics, Inc.", "co diagnostics", "Co Diagnostics", "diagnostics"), ("", "", "", ""), (None, None, None, None),
    ],
)
def test_names(spark, name, core, term, word):
    r = spark.createDataFrame([(name,)], "n string").select(core_name(F.col("n")), search_term(F.col("n")), first_core_word(F.col("n"))).first()
    assert tuple(r) == (core, term, word)


def test_sponsor_match_and_ids(spark):
    df = spark.createDataFrame([("Fate Therapeutics", "FATE THERAPEUTICS INC"), ("Other", "Holdings Inc"), ("Fate", "Fate Therapeutics"), (None, "x")], "l string, n string")
    assert [r[0] for r in df.select(sponsor_matches(F.col("l"), F.col("n"))).collect()] == [True, True, False, None]
    ids = spark.createDataFrame([("123",), ("12345678901",), ("x",), (None,)], "c string")
    assert [r[0] for r in ids.select(padded_id(F.col("c"))).collect()] == ["0000000123", "12345678901", None, None]


def test_display(spark):
    df = spark.createDataFrame([(2_500_000, 2024), (3_500_000, None), (None, 2024), (1_250_000_000, 2024)], "v long, y int")
    assert [tuple(r) for r in df.select(millions(F.col("v"), F.col("y")), short_money(F.col("v")), grouped(F.col("v"))).collect()] == [
        ("$2M (FY2024)", "$3M", "2,500,000"), ("$4M (FY?)", "$4M", "3,500,000"), ("n/a", "n/a", None), ("$1250M (FY2024)", "$1.3B", "1,250,000,000"),
    ]
    t = spark.createDataFrame([("a\nb" + "x" * 400,), (None,)], "t string").select(snippet(F.col("t"), 5)).collect()
    assert [r[0] for r in t] == ["a bxx", ""]
    assert spark.createDataFrame([('<a & "b">',)], "t string").select(escaped(F.col("t"))).first()[0] == "&lt;a &amp; &quot;b&quot;&gt;"
    assert [r[0] for r in spark.createDataFrame([(0.0, 2.0), (1.0, 0.0), (1.0, None)], "a double, b double").select(ratio(F.col("a"), F.col("b"))).collect()] == [0.0, None, None]


def test_links(spark):
    df = spark.createDataFrame([("a b&c", "#/c/BRK.B-x"), (None, "#/d/X")], "v string, f string")
    assert [tuple(r) for r in df.select(linked("u?x=", F.col("v")), linked_ticker(F.col("f"))).collect()] == [("u?x=a%20b%26c", "BRK.B"), (None, "")]
