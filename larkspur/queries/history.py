"""p2: changes between consecutive loads. p4: the history of a study's status and phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.functions.tokens import phase_set, token, whole
from larkspur.operators.snapshots import Calendar, changes, load_calendar, states, versions
from larkspur.session import table


def _trial_states(spark: SparkSession, sf: str, calendar: Calendar, phases: bool) -> DataFrame:
    payload = [token(F.col("status")).alias("status")] + ([phase_set(F.col("phase")).alias("phases")] if phases else [])
    return states(table(spark, sf, "trials"), calendar, table(spark, sf, "fetch_log"), "registry", F.col("nct_id"), payload)


def _figure_states(spark: SparkSession, sf: str, calendar: Calendar) -> DataFrame:
    key = F.concat("metric", F.lit(":"), F.col("fiscal_year").cast("string"))
    return states(table(spark, sf, "financials"), calendar, table(spark, sf, "fetch_log"), "filings", key, [whole(F.col("value")).alias("value")])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    calendar = load_calendar(table(spark, sf, "loads"))
    named = lambda df, name: df.select(F.lit(name).alias("record_set"), "load_id", F.col("entity").alias("company_ticker"), F.col("item").alias("item_key"), "change_type")
    trials = changes(_trial_states(spark, sf, calendar, False), calendar, ["status"])
    figures = changes(_figure_states(spark, sf, calendar), calendar, ["value"])
    return named(trials, "trials").unionByName(named(figures, "financials"))


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Changes per record set, load and kind."""
    return p2_found(spark, sf).groupBy("record_set", "load_id", "change_type").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    calendar = load_calendar(table(spark, sf, "loads"))
    v = versions(_trial_states(spark, sf, calendar, True), calendar, ["status", "phases"])
    return v.select(F.col("entity").alias("company_ticker"), F.col("item").alias("nct_id"), "from_load", "to_load")


def p4_figures(spark: SparkSession, sf: str) -> DataFrame:
    """The same history for whole-dollar figures, with the value that held."""
    calendar = load_calendar(table(spark, sf, "loads"))
    v = versions(_figure_states(spark, sf, calendar), calendar, ["value"])
    return v.select(F.col("entity").alias("company_ticker"), F.col("item").alias("item_key"), "from_load", "to_load", "value")


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p4_found": p4_found, "p4_figures": p4_figures}

_TOKEN = "regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_PHASES = (
    "list_sort(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(upper({0}), '\\bN\\s*/\\s*A\\b', 'NA', 'g'), '[,/;|+&]'), "
    "lambda x: regexp_replace(x, '[^A-Z0-9]+', '', 'g')), lambda x: x <> '')))"
)

#: States per load, written independently of the engine: every load of a key is filled by walking back over failed ones.
_STATES = """
cal AS (SELECT load_id, started_at, row_number() OVER (ORDER BY started_at) AS seq, lead(started_at) OVER (ORDER BY started_at) AS ends_at FROM loads),
{p}_raw AS (
  SELECT company_ticker, item, seq, arg_max(struct_pack({pack}), (fetched_at, id)) AS s
  FROM (SELECT company_ticker, {item} AS item, {cols}, fetched_at, id FROM {table} WHERE company_ticker IS NOT NULL) r
  JOIN cal ON r.fetched_at >= started_at AND (ends_at IS NULL OR r.fetched_at < ends_at)
  WHERE item IS NOT NULL GROUP BY ALL),
{p}_good AS (
  SELECT t.company_ticker, cal.seq, (SELECT max(c2.seq) FROM cal c2 WHERE c2.seq <= cal.seq AND NOT EXISTS (
      SELECT 1 FROM fetch_log f WHERE f.feed = '{feed}' AND f.outcome = 'failed' AND f.company_ticker = t.company_ticker AND f.load_id = c2.load_id)) AS good
  FROM (SELECT DISTINCT company_ticker FROM {p}_raw) t CROSS JOIN cal),
{p}_st AS (SELECT g.company_ticker, r.item, g.seq, {unpack} FROM {p}_good g JOIN {p}_raw r ON r.company_ticker = g.company_ticker AND r.seq = g.good)
"""


def _states_sql(p: str, table_: str, item: str, cols: dict[str, str], feed: str) -> str:
    return _STATES.format(
        p=p, table=table_, item=item, feed=feed,
        cols=", ".join(f"{e} AS {n}" for n, e in cols.items()),
        pack=", ".join(f"{n} := {n}" for n in cols),
        unpack=", ".join(f"r.s.{n} AS {n}" for n in cols),
    ).strip()


_TRIALS = _states_sql("t", "trials", "nct_id", {"status": _TOKEN.format("status")}, "registry")
_TRIALS_P = _states_sql("t", "trials", "nct_id", {"status": _TOKEN.format("status"), "phases": _PHASES.format("phase")}, "registry")
_FIGURES = _states_sql("f", "financials", "metric || ':' || fiscal_year", {"value": "trunc(value)::BIGINT"}, "filings")
_FIGURES_ONLY = _FIGURES
_FIGURES_ALSO = _FIGURES.split("FROM loads),", 1)[1].strip()

_DIFF = """
SELECT '{name}' AS record_set, (SELECT load_id FROM cal WHERE cal.seq = k) AS load_id, company_ticker, item AS item_key, change_type FROM (
  SELECT coalesce(a.company_ticker, b.company_ticker) AS company_ticker, coalesce(a.item, b.item) AS item, coalesce(a.seq, b.seq + 1) AS k,
    CASE WHEN b.item IS NULL THEN 'added' WHEN a.item IS NULL THEN 'removed' WHEN a.{v} IS DISTINCT FROM b.{v} THEN 'changed' END AS change_type
  FROM (SELECT * FROM {p}_st WHERE seq > 1) a FULL JOIN (SELECT * FROM {p}_st WHERE seq < (SELECT max(seq) FROM cal)) b
    ON a.company_ticker = b.company_ticker AND a.item = b.item AND a.seq = b.seq + 1) WHERE change_type IS NOT NULL
"""
_P2 = f"WITH {_TRIALS}, {_FIGURES_ALSO}, d AS ({_DIFF.format(name='trials', p='t', v='status')} UNION ALL {_DIFF.format(name='financials', p='f', v='value')})"

_RUNS = """
, m AS (SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND {same} THEN 0 ELSE 1 END AS opens FROM {p}_st WINDOW w AS (PARTITION BY company_ticker, item ORDER BY seq)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY company_ticker, item ORDER BY seq) AS v FROM m)
SELECT company_ticker, item AS {item}, (SELECT load_id FROM cal WHERE cal.seq = lo) AS from_load, (SELECT load_id FROM cal WHERE cal.seq = hi) AS to_load{more}
FROM (SELECT company_ticker, item, v, min(seq) AS lo, max(seq) AS hi{agg} FROM g GROUP BY company_ticker, item, v)
"""

SQL = {
    "p2_found": _P2 + " SELECT * FROM d",
    "p2_counts": _P2 + " SELECT record_set, load_id, change_type, count(*) AS n FROM d GROUP BY ALL",
    "p4_found": f"WITH {_TRIALS_P}" + _RUNS.format(p="t", item="nct_id", same="lag(status) OVER w IS NOT DISTINCT FROM status AND lag(phases) OVER w IS NOT DISTINCT FROM phases", more="", agg=""),
    "p4_figures": f"WITH {_FIGURES_ONLY}" + _RUNS.format(p="f", item="item_key", same="lag(value) OVER w IS NOT DISTINCT FROM value", more=", value", agg=", any_value(value) AS value"),
}
