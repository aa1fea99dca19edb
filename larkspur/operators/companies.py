"""Companies with their pipelines and latest figures: aggregate, pivot, filter, sort and limit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from larkspur.functions.display import ratio
from larkspur.functions.tokens import ACTIVE, phase_text, token, whole
from larkspur.operators.snapshots import Calendar, load_calendar, newest_states


def newest_load(state: DataFrame, loads: DataFrame | Calendar) -> DataFrame:
    """The rows of ``state`` that hold in the last load."""
    calendar = load_calendar(loads)
    if calendar.starts is not None:
        return state.where(F.col("load_seq") == calendar.last_seq())
    return state.join(F.broadcast(calendar.rows.agg(F.max("seq").alias("load_seq"))), "load_seq", "left_semi")


def current_trials(trials: DataFrame, loads: DataFrame | Calendar, fetch_log: DataFrame | None) -> DataFrame:
    """``(ticker, nct_id, id, title, phase, status, lead_sponsor)``: one row per study and company in the newest load."""
    payload = [
        F.col("id"), F.col("title"), F.coalesce(phase_text(F.col("phase")), F.lit("")).alias("phase"), token(F.col("status")).alias("status"), F.col("lead_sponsor")
    ]
    newest = newest_states(trials, loads, fetch_log, "registry", F.col("nct_id"), payload)
    return newest.select(F.col("entity").alias("ticker"), F.col("item").alias("nct_id"), "id", "title", "phase", "status", "lead_sponsor")


def current_figures(financials: DataFrame, loads: DataFrame | Calendar, fetch_log: DataFrame | None) -> DataFrame:
    """``(ticker, id, metric, fiscal_year, value)``: one row per company, metric and year in the newest load; whole dollars."""
    key = F.struct("metric", "fiscal_year")
    payload = [F.col("id"), whole(F.col("value")).alias("value")]
    known = financials.where("metric is not null and fiscal_year is not null")
    rows = newest_states(known, loads, fetch_log, "filings", key, payload)
    return rows.select(F.col("entity").alias("ticker"), "id", F.col("item.metric").alias("metric"), F.col("item.fiscal_year").alias("fiscal_year"), "value")


def late_stage(phase: Column) -> Column:
    """A phase list that names phase 3 or 4; null counts as no phase."""
    text = F.coalesce(phase, F.lit(""))
    return F.contains(text, F.lit("PHASE3")) | F.contains(text, F.lit("PHASE4"))


def pipeline_summary(trials: DataFrame) -> DataFrame:
    """``(ticker, total_trials, active_trials, terminated_trials, late_trials)`` of companies with trials."""
    return trials.groupBy("ticker").agg(
        F.count("*").alias("total_trials"),
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active_trials"),
        F.count_if(F.col("status") == "TERMINATED").alias("terminated_trials"),
        F.count_if(late_stage(F.col("phase"))).alias("late_trials"),
    )


def latest_annual(figures: DataFrame) -> DataFrame:
    """``(ticker, metric, value, fiscal_year)``: the figure of the latest year; of several in one year the first by id.

    Rows without value or year don't count.
    """
    known = figures.where("value is not null and fiscal_year is not null")
    best = F.max_by(F.struct("value", "fiscal_year"), F.struct(F.col("fiscal_year"), -F.col("id")))
    return known.groupBy("ticker", "metric").agg(best.alias("f")).select("ticker", "metric", "f.value", "f.fiscal_year")


def pick_by_id(figures: DataFrame, last: bool) -> DataFrame:
    """``(ticker, rd_value, cash_value)``: of repeated metric rows the last (or first) by id; a metric without rows is null."""
    by = F.max_by if last else F.min_by
    pick = lambda m: by("value", F.when((F.col("metric") == m) & F.col("value").isNotNull(), F.col("id")))
    return figures.groupBy("ticker").agg(pick("rd_expense").alias("rd_value"), pick("cash").alias("cash_value"))


def company_summary(companies: DataFrame, trials: DataFrame, figures: DataFrame) -> DataFrame:
    """One row per company: ``ticker, name, sector``, trial counts, latest R&D and cash with their years, and runway.

    Companies without trials stay with counts of 0, without figures with nulls. runway is exact (cash over a year's R&D)
    and null where R&D is missing or 0. trials and figures are reduced to a row per company before the joins.
    """
    latest = latest_annual(figures)
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = latest.groupBy("ticker").agg(
        of("rd_expense", "value").alias("rd_value"), of("rd_expense", "fiscal_year").alias("rd_year"), of("cash", "value").alias("cash_value"), of("cash", "fiscal_year").alias("cash_year")
    )
    counts = ("total_trials", "active_trials", "terminated_trials", "late_trials")
    base = companies.select("ticker", "name", "sector").join(pipeline_summary(trials), "ticker", "left").join(wide, "ticker", "left")
    filled = base.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return filled.withColumns({"has_phase3": F.col("late_trials") > 0, "runway": ratio(F.col("cash_value"), F.col("rd_value"))})


@dataclass(frozen=True)
class CompanyFilter:
    """Bounds that all must hold; None means no bound. Bounds are inclusive, and a missing figure fails any bound."""

    min_rd: float | None = None
    min_cash: float | None = None
    min_active_trials: int | None = None
    has_phase3: bool | None = None
    sector: str | None = None
    min_runway: float | None = None

    def condition(self) -> Column:
        """All bounds as one predicate; a comparison with a missing figure is null, which no filter lets through."""
        terms = [F.lit(True)]
        for column, least in (("rd_value", self.min_rd), ("cash_value", self.min_cash), ("active_trials", self.min_active_trials), ("runway", self.min_runway)):
            if least is not None:
                terms.append(F.col(column) >= F.lit(least))
        if self.has_phase3 is not None:
            terms.append(F.col("has_phase3") == self.has_phase3)
        if self.sector:
            terms.append(F.lower(F.coalesce("sector", F.lit(""))) == self.sector.lower())
        return reduce(lambda a, b: a & b, terms)

    def apply(self, summary: DataFrame) -> DataFrame:
        return summary.where(self.condition())


SORTS = {"rd": "rd_value", "cash": "cash_value", "active_trials": "active_trials", "total_trials": "total_trials", "runway": "runway"}


def ranked(summary: DataFrame, sort_by: str | None = None, limit: int | None = None) -> DataFrame:
    """Highest first by one of ``SORTS``, a missing value as -1, runway as shown (two places); by ticker otherwise and
    among equals. ``limit`` 0 or None keeps all."""
    key = F.bround("runway", 2) if sort_by == "runway" else F.col(SORTS[sort_by]) if sort_by in SORTS else None
    order = [F.col("ticker")] if key is None else [F.coalesce(key, F.lit(-1)).desc(), F.col("ticker")]
    rows = summary.orderBy(*order)
    return rows.limit(limit) if limit else rows


def phase_bucket(phase: Column) -> Column:
    """The highest phase that a list names: ``4 3 2 1`` or ``none``; early phase 1 counts as 1."""
    text = F.coalesce(phase, F.lit(""))
    return F.coalesce(*[F.when(F.contains(text, F.lit(f"PHASE{n}")), F.lit(str(n))) for n in (4, 3, 2, 1)], F.lit("none"))


def bar_heights(counts: DataFrame, by: str, n: str) -> DataFrame:
    """Add ``height``: 6 to 126 in proportion to the highest count of the same ``by``; 3 for a count of 0."""
    top = counts.groupBy(by).agg(F.greatest(F.lit(1), F.max(n)).alias("__top"))
    bar = F.when(F.col(n) == 0, 3).otherwise(F.floor(F.col(n) * 120 / F.col("__top") + 0.5) + 6)
    return counts.join(top, by).withColumn("height", bar.cast("int")).drop("__top")


def figures_with_reason(companies: DataFrame, numbers: DataFrame, figures: DataFrame) -> DataFrame:
    """``(ticker, financials)`` of every company: ``financials`` is ``(available, reason, rd_expense, cash)``.

    numbers: ``(ticker, cik)``, the known filer numbers. A company without a number, or without any figure, is not
    available and has the reason; one figure of the two is enough. Each figure is ``(value, fiscal_year)`` or null.
    """
    latest = latest_annual(figures)
    of = lambda m: F.max(F.when(F.col("metric") == m, F.struct("value", "fiscal_year")))
    wide = latest.groupBy("ticker").agg(of("rd_expense").alias("rd_expense"), of("cash").alias("cash"))
    known = numbers.where("cik is not null").groupBy("ticker").agg(F.min("cik").alias("__cik"))
    both = companies.select("ticker").join(known, "ticker", "left").join(wide, "ticker", "left")
    none = F.col("rd_expense").isNull() & F.col("cash").isNull()
    reason = F.when(F.col("__cik").isNull(), "no filer number").when(none, "no figures")
    shown = lambda c: F.when(reason.isNull(), F.col(c)).alias(c)
    return both.select("ticker", F.struct(reason.isNull().alias("available"), reason.alias("reason"), shown("rd_expense"), shown("cash")).alias("financials"))


def company_detail(companies: DataFrame, trials: DataFrame, financials: DataFrame, first: int = 20) -> DataFrame:
    """One nested row per company: ``ticker, name, pipeline (total, active, terminated, by_phase, by_status), financials,
    trials``, the ``first`` studies by id.

    Counts are maps from phase or status to a number; a null status is the key ``UNKNOWN``. Maps and studies are gathered
    after they are reduced, so that a company with very many studies is no large group.
    """
    def by(column: str, name: str) -> DataFrame:
        counts = trials.groupBy("ticker", F.coalesce(column, F.lit("UNKNOWN")).alias("k")).agg(F.count("*").alias("n"))
        return counts.groupBy("ticker").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    place = F.row_number().over(W.partitionBy("ticker").orderBy("id"))
    few = trials.select("ticker", "id", "nct_id", "phase", "status").withColumn("__place", place).where(F.col("__place") <= first)
    few = few.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("id", "nct_id", "phase", "status"))).alias("trials"))
    base = companies.select("ticker", "name").join(pipeline_summary(trials), "ticker", "left").join(by("phase", "by_phase"), "ticker", "left")
    base = base.join(by("status", "by_status"), "ticker", "left").join(few, "ticker", "left").join(financials, "ticker", "left")
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    pipeline = F.struct(zero("total_trials", "total"), zero("active_trials", "active"), zero("terminated_trials", "terminated"), "by_phase", "by_status")
    return base.select("ticker", "name", pipeline.alias("pipeline"), "financials", "trials")


def unlisted(rows: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` that are not among those listed; nulls and empty texts are none."""
    return rows.where(F.col(column) != "").select(column).distinct().join(listed.select(column), column, "left_anti")
