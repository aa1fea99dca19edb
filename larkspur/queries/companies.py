"""Registered queries over companies, trials and figures of the newest load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from larkspur.functions.display import millions, short_money
from larkspur.operators import companies as op
from larkspur.operators.companies import CompanyFilter
from larkspur.operators.snapshots import Calendar, load_calendar
from larkspur.plans.screen import Plan, run_plan
from larkspur.queries.history import _PHASES, _TOKEN, _states_sql
from larkspur.session import table


def _trials(spark: SparkSession, sf: str, calendar: Calendar | None = None) -> DataFrame:
    return op.current_trials(table(spark, sf, "trials"), calendar or table(spark, sf, "loads"), table(spark, sf, "fetch_log"))


def _figures(spark: SparkSession, sf: str, calendar: Calendar | None = None) -> DataFrame:
    return op.current_figures(table(spark, sf, "financials"), calendar or table(spark, sf, "loads"), table(spark, sf, "fetch_log"))


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    calendar = load_calendar(table(spark, sf, "loads"))
    return op.company_summary(table(spark, sf, "companies"), _trials(spark, sf, calendar), _figures(spark, sf, calendar))


def _raw_figures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "financials").where("company_ticker is not null").withColumnRenamed("company_ticker", "ticker")


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("runway", F.round("runway", 6))


def _screen(flt: CompanyFilter):
    return lambda spark, sf: _shown(flt.apply(_summary(spark, sf)))


def _ranked(sort_by: str | None, limit: int | None):
    return lambda spark, sf: _shown(op.ranked(_summary(spark, sf), sort_by, limit))


def count_beside_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The ten companies with most active trials of those with a late-stage trial, and how many there are in all."""
    hits = CompanyFilter(has_phase3=True).apply(_summary(spark, sf))
    total = hits.agg(F.count("*").alias("matches"))
    return op.ranked(hits, "active_trials", 10).withColumn("matches", total.scalar()).select("ticker", "active_trials", "matches")


def pipeline_by(column: str):
    return lambda spark, sf: _trials(spark, sf).groupBy("ticker", column).agg(F.count("*").alias("n"))


def _buckets(spark: SparkSession, sf: str) -> DataFrame:
    b = _trials(spark, sf).withColumn("bucket", op.phase_bucket(F.col("phase")))
    return b.groupBy("ticker").agg(*[F.count_if(F.col("bucket") == x).alias(f"phase_{x}") for x in ("4", "3", "2", "1", "none")])


def bar_scale(spark: SparkSession, sf: str) -> DataFrame:
    wide = _buckets(spark, sf)
    names = [c for c in wide.columns if c != "ticker"]
    return op.bar_heights(wide.unpivot("ticker", names, "bucket", "n"), "ticker", "n")


def latest_annual_first_tie(spark: SparkSession, sf: str) -> DataFrame:
    """Over all rows ever loaded: the first row of the latest year."""
    return op.latest_annual(_raw_figures(spark, sf)).withColumn("value", F.round("value", 6))


def _picked(last: bool):
    return lambda spark, sf: op.pick_by_id(_raw_figures(spark, sf), last)


def company_facts(spark: SparkSession, sf: str) -> DataFrame:
    """One line of facts per company."""
    s = _summary(spark, sf)
    line = F.concat(
        F.col("ticker"), F.lit(" | "), F.col("name"), F.lit(" | "), F.coalesce("sector", F.lit("")), F.lit(" | "), F.col("total_trials").cast("string"), F.lit(" trials ("),
        F.col("active_trials").cast("string"), F.lit(" active) | R&D "), millions(F.col("rd_value"), F.col("rd_year")), F.lit(" | cash "), millions(F.col("cash_value"), F.col("cash_year")),
    )
    return s.select("ticker", line.alias("line"), short_money(F.col("cash_value")).alias("cash_short"), F.count("*").over(W.partitionBy(F.coalesce("sector", F.lit("")))).alias("in_sector"))


def plan_filter_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """A structured plan, as a planner would hand it over: at most 25 rows and the total."""
    plan = Plan.from_json('{"intent": "filter", "filters": {"has_phase3": true, "min_active_trials": 2}, "sort_by": "active_trials", "limit": 0}')
    return run_plan(plan, _summary(spark, sf)).select("ticker", "active_trials", "total_trials", "matches")


def universe_semi_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Companies with at least one current trial and one R&D figure."""
    c = table(spark, sf, "companies").select("ticker", "name")
    with_trials = c.join(_trials(spark, sf).select("ticker"), "ticker", "left_semi")
    return with_trials.join(_figures(spark, sf).where("metric = 'rd_expense' and value is not null").select("ticker"), "ticker", "left_semi")


def first_trials(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty current trials of each company in the order of their ids, and how many it has."""
    w = W.partitionBy("ticker").orderBy("id")
    t = _trials(spark, sf)
    first = t.withColumn("place", F.row_number().over(w)).where("place <= 20")
    return first.join(op.pipeline_summary(t).select("ticker", "total_trials"), "ticker").select("ticker", "place", "nct_id", "phase", "status", "total_trials")


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One company by its ticker in any case."""
    first = table(spark, sf, "companies").agg(F.min("ticker").alias("wanted"))
    return _shown(_summary(spark, sf).join(F.broadcast(first), F.col("ticker") == F.upper(F.lower("wanted"))).drop("wanted"))


def distinct_sectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "companies").where("sector <> ''").select("sector").distinct()


def sector_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "companies").groupBy("sector").agg(F.count("*").alias("n"), F.min("ticker").alias("first_ticker"))


def ordered_distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Per sponsor, its companies in the order of their first trial (by id), each once; fifteen shown and the rest counted."""
    first = table(spark, sf, "trials").where("company_ticker <> '' and lead_sponsor is not null").groupBy("lead_sponsor", "company_ticker").agg(F.min("id").alias("at"))
    lists = first.groupBy("lead_sponsor").agg(F.array_sort(F.collect_list(F.struct("at", "company_ticker"))).alias("l"))
    names = F.transform("l", lambda x: x["company_ticker"])
    return lists.select("lead_sponsor", F.array_join(F.slice(names, 1, 15), ",").alias("sources"), F.greatest(F.size("l") - 15, F.lit(0)).alias("more"))


QUERIES = {
    "company_screen": _screen(CompanyFilter()),
    "filter_has_late": _screen(CompanyFilter(has_phase3=True)),
    "filter_no_late": _screen(CompanyFilter(has_phase3=False)),
    "filter_sector_ci": _screen(CompanyFilter(sector="bio RESEARCH")),
    "filter_min_active": _screen(CompanyFilter(min_active_trials=3)),
    "filter_min_rd": _screen(CompanyFilter(min_rd=0)),
    "filter_min_cash": _screen(CompanyFilter(min_cash=1e8)),
    "filter_min_runway": _screen(CompanyFilter(min_runway=1.0)),
    "filter_all_bounds": _screen(CompanyFilter(min_rd=1e6, min_cash=1e6, min_active_trials=1, has_phase3=True, sector="Biologics", min_runway=0.5)),
    "sort_rd_missing_last": _ranked("rd", 25),
    "top_active_companies": _ranked("active_trials", 25),
    "top_runway_companies": _ranked("runway", 25),
    "count_beside_limit": count_beside_limit,
    "pipeline_by_phase": pipeline_by("phase"),
    "pipeline_by_status": pipeline_by("status"),
    "phase_buckets": _buckets,
    "bar_scale": bar_scale,
    "latest_annual_first_tie": latest_annual_first_tie,
    "metric_last_wins": _picked(True),
    "metric_first_wins": _picked(False),
    "company_facts": company_facts,
    "plan_filter_dispatch": plan_filter_dispatch,
    "universe_semi_joins": universe_semi_joins,
    "first_trials": first_trials,
    "point_lookup": point_lookup,
    "distinct_sectors": distinct_sectors,
    "sector_counts": sector_counts,
    "ordered_distinct_sources": ordered_distinct_sources,
}

_PHASE_TEXT = (
    f"coalesce(array_to_string(list_transform({_PHASES.format('phase')}, lambda x: CASE WHEN x = 'NA' THEN 'N/A' ELSE regexp_replace(x, '^EARLY', 'EARLY_') END), ', '), '')"
)
_T = _states_sql("t", "trials", "nct_id", {"tid": "id", "title": "title", "phase": _PHASE_TEXT, "status": _TOKEN.format("status"), "lead_sponsor": "lead_sponsor"}, "registry")
_F = _states_sql("f", "financials", "metric || ':' || fiscal_year", {"fid": "id", "metric": "metric", "fiscal_year": "fiscal_year", "value": "trunc(value)::BIGINT"}, "filings")
CURRENT = f"""WITH {_T}, {_F.split("FROM loads),", 1)[1].strip()},
cur AS (SELECT company_ticker AS ticker, item AS nct_id, tid AS id, title, phase, status, lead_sponsor FROM t_st WHERE seq = (SELECT max(seq) FROM cal)),
fig AS (SELECT company_ticker AS ticker, fid AS id, metric, fiscal_year, value FROM f_st WHERE seq = (SELECT max(seq) FROM cal)),
lat AS (SELECT ticker, metric, arg_max(value, fiscal_year) AS value, max(fiscal_year) AS fiscal_year FROM fig WHERE value IS NOT NULL GROUP BY ALL),
bucketed AS (SELECT ticker, CASE WHEN phase LIKE '%PHASE4%' THEN '4' WHEN phase LIKE '%PHASE3%' THEN '3' WHEN phase LIKE '%PHASE2%' THEN '2' WHEN phase LIKE '%PHASE1%' THEN '1' ELSE 'none' END AS bucket FROM cur),
summary AS (
  SELECT c.ticker, c.name, c.sector, coalesce(total, 0) AS total_trials, coalesce(active, 0) AS active_trials, coalesce(term, 0) AS terminated_trials, coalesce(late, 0) AS late_trials,
    coalesce(late, 0) > 0 AS has_phase3, rd.value AS rd_value, rd.fiscal_year AS rd_year, ca.value AS cash_value, ca.fiscal_year AS cash_year,
    CASE WHEN rd.value > 0 THEN ca.value::DOUBLE / rd.value END AS exact_runway
  FROM companies c LEFT JOIN (
    SELECT ticker, count(*) AS total, count(*) FILTER (status IN ('RECRUITING', 'ACTIVE_NOT_RECRUITING', 'ENROLLING_BY_INVITATION')) AS active,
      count(*) FILTER (status = 'TERMINATED') AS term, count(*) FILTER (phase LIKE '%PHASE3%' OR phase LIKE '%PHASE4%') AS late FROM cur GROUP BY 1) p ON p.ticker = c.ticker
  LEFT JOIN (SELECT * FROM lat WHERE metric = 'rd_expense') rd ON rd.ticker = c.ticker LEFT JOIN (SELECT * FROM lat WHERE metric = 'cash') ca ON ca.ticker = c.ticker)
"""
_ROW = "SELECT * EXCLUDE (exact_runway), round(exact_runway, 6) AS runway FROM summary"
_BUCKETS = "SELECT ticker, " + ", ".join(f"count(*) FILTER (bucket = '{b}') AS phase_{b}" for b in ("4", "3", "2", "1", "none")) + " FROM bucketed GROUP BY 1"
_MONEY = "CASE WHEN {0}_value IS NULL THEN 'n/a' ELSE '$' || round_even({0}_value / 1e6, 0)::BIGINT || 'M (FY' || {0}_year || ')' END"

SQL = {
    "company_screen": f"{CURRENT} {_ROW}",
    "filter_has_late": f"{CURRENT} {_ROW} WHERE has_phase3",
    "filter_no_late": f"{CURRENT} {_ROW} WHERE NOT has_phase3",
    "filter_sector_ci": f"{CURRENT} {_ROW} WHERE lower(sector) = 'bio research'",
    "filter_min_active": f"{CURRENT} {_ROW} WHERE active_trials >= 3",
    "filter_min_rd": f"{CURRENT} {_ROW} WHERE rd_value >= 0",
    "filter_min_cash": f"{CURRENT} {_ROW} WHERE cash_value >= 1e8",
    "filter_min_runway": f"{CURRENT} {_ROW} WHERE exact_runway >= 1",
    "filter_all_bounds": f"{CURRENT} {_ROW} WHERE rd_value >= 1e6 AND cash_value >= 1e6 AND active_trials >= 1 AND has_phase3 AND lower(sector) = 'biologics' AND exact_runway >= 0.5",
    "sort_rd_missing_last": f"{CURRENT} {_ROW} ORDER BY coalesce(rd_value, -1) DESC, ticker LIMIT 25",
    "top_active_companies": f"{CURRENT} {_ROW} ORDER BY active_trials DESC, ticker LIMIT 25",
    "top_runway_companies": f"{CURRENT} {_ROW} ORDER BY coalesce(round_even(exact_runway, 2), -1) DESC, ticker LIMIT 25",
    "count_beside_limit": f"{CURRENT} SELECT ticker, active_trials, count(*) OVER () AS matches FROM summary WHERE has_phase3 ORDER BY active_trials DESC, ticker LIMIT 10",
    "pipeline_by_phase": f"{CURRENT} SELECT ticker, phase, count(*) AS n FROM cur GROUP BY ALL",
    "pipeline_by_status": f"{CURRENT} SELECT ticker, status, count(*) AS n FROM cur GROUP BY ALL",
    "phase_buckets": f"{CURRENT} {_BUCKETS}",
    "bar_scale": f"{CURRENT}, w AS ({_BUCKETS}), l AS (UNPIVOT w ON COLUMNS(* EXCLUDE ticker) INTO NAME bucket VALUE n) "
    "SELECT ticker, bucket, n, (CASE WHEN n = 0 THEN 3 ELSE floor(n * 120 / greatest(1, max(n) OVER (PARTITION BY ticker)) + 0.5) + 6 END)::INT AS height FROM l",
    "latest_annual_first_tie": "SELECT company_ticker AS ticker, metric, round(arg_min(value, id), 6) AS value, fiscal_year FROM (SELECT *, max(fiscal_year) OVER (PARTITION BY company_ticker, metric) AS y "
    "FROM financials WHERE company_ticker IS NOT NULL AND value IS NOT NULL AND fiscal_year IS NOT NULL) WHERE fiscal_year = y GROUP BY ALL",
    "metric_last_wins": "SELECT company_ticker AS ticker, arg_max(value, id) FILTER (metric = 'rd_expense' AND value IS NOT NULL) AS rd_value, arg_max(value, id) FILTER (metric = 'cash' AND value IS NOT NULL) AS cash_value "
    "FROM financials WHERE company_ticker IS NOT NULL GROUP BY 1",
    "metric_first_wins": "SELECT company_ticker AS ticker, arg_min(value, id) FILTER (metric = 'rd_expense' AND value IS NOT NULL) AS rd_value, arg_min(value, id) FILTER (metric = 'cash' AND value IS NOT NULL) AS cash_value "
    "FROM financials WHERE company_ticker IS NOT NULL GROUP BY 1",
    "company_facts": f"{CURRENT} SELECT ticker, ticker || ' | ' || name || ' | ' || coalesce(sector, '') || ' | ' || total_trials || ' trials (' || active_trials || ' active) | R&D ' || {_MONEY.format('rd')} || ' | cash ' || {_MONEY.format('cash')} AS line, "
    "CASE WHEN cash_value IS NULL THEN 'n/a' WHEN cash_value >= 1e9 THEN '$' || (floor(round(cash_value / 1e8, 6) + 0.5)::BIGINT // 10) || '.' || (floor(round(cash_value / 1e8, 6) + 0.5)::BIGINT % 10) || 'B' "
    "ELSE '$' || floor(cash_value / 1e6 + 0.5)::BIGINT || 'M' END AS cash_short, count(*) OVER (PARTITION BY coalesce(sector, '')) AS in_sector FROM summary",
    "plan_filter_dispatch": f"{CURRENT} SELECT ticker, active_trials, total_trials, count(*) OVER () AS matches FROM summary WHERE has_phase3 AND active_trials >= 2 ORDER BY active_trials DESC, ticker LIMIT 25",
    "universe_semi_joins": f"{CURRENT} SELECT ticker, name FROM companies WHERE ticker IN (SELECT ticker FROM cur) AND ticker IN (SELECT ticker FROM fig WHERE metric = 'rd_expense' AND value IS NOT NULL)",
    "first_trials": f"{CURRENT} SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY id)::INT AS place, nct_id, phase, status, count(*) OVER (PARTITION BY ticker) AS total_trials FROM cur QUALIFY place <= 20",
    "point_lookup": f"{CURRENT} {_ROW} WHERE ticker = (SELECT min(ticker) FROM companies)",
    "distinct_sectors": "SELECT DISTINCT sector FROM companies WHERE sector <> ''",
    "sector_counts": "SELECT sector, count(*) AS n, min(ticker) AS first_ticker FROM companies GROUP BY 1",
    "ordered_distinct_sources": "SELECT lead_sponsor, array_to_string(list(company_ticker ORDER BY first_id, company_ticker)[1:15], ',') AS sources, greatest(count(*) - 15, 0)::INT AS more FROM "
    "(SELECT lead_sponsor, company_ticker, min(id) AS first_id FROM trials WHERE company_ticker <> '' AND lead_sponsor IS NOT NULL GROUP BY ALL) GROUP BY 1",
}
