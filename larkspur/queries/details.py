"""Registered queries of company details, landed files, stored tables and the pieces they are made of."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from larkspur.functions import display, names
from larkspur.operators import companies as op, scores, vectors
from larkspur.operators.companies import CompanyFilter
from larkspur.operators.snapshots import load_calendar
from larkspur.plans.screen import Plan, run_plan
from larkspur.queries.companies import CURRENT, _figures, _summary, _trials
from larkspur.session import shared_folder, table
from larkspur.sources import landing, warehouse


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    """``(ticker, cik)``: the company's own number, or else the one under which a filer has its name."""
    c = table(spark, sf, "companies").select("ticker", "name", F.when(F.col("cik").rlike("^[0-9]{10}$"), F.col("cik")).alias("own"))
    f = table(spark, sf, "filer_records").where("cik_str is not null").groupBy("title").agg(F.max(names.padded_id(F.col("cik_str").cast("string"))).alias("other"))
    return c.join(f, F.col("name") == F.col("title"), "left").select("ticker", display.first_given(F.col("own"), F.col("other")).alias("cik"))


def filer_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _numbers(spark, sf)


def figure_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each company's figures are there, why not, and which they are."""
    f = op.figures_with_reason(table(spark, sf, "companies"), _numbers(spark, sf), _figures(spark, sf))
    return f.select(
        "ticker", "financials.available", "financials.reason", F.col("financials.rd_expense.value").alias("rd_value"), F.col("financials.rd_expense.fiscal_year").alias("rd_year"),
        F.col("financials.cash.value").alias("cash_value"), F.col("financials.cash.fiscal_year").alias("cash_year"),
    )


def company_detail(spark: SparkSession, sf: str) -> DataFrame:
    """The nested facts of each company, with maps and lists written out."""
    c = table(spark, sf, "companies")
    d = op.company_detail(c, _trials(spark, sf), op.figures_with_reason(c, _numbers(spark, sf), _figures(spark, sf)))
    written = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")
    studies = F.array_join(F.transform("trials", lambda t: F.concat(t["nct_id"], F.lit(":"), F.coalesce(t["status"], F.lit("")))), ";")
    return d.select(
        "ticker", "name", "pipeline.total", "pipeline.active", "pipeline.terminated", F.coalesce(written("pipeline.by_phase"), F.lit("")).alias("by_phase"),
        F.coalesce(written("pipeline.by_status"), F.lit("")).alias("by_status"), "financials.available", F.coalesce(studies, F.lit("")).alias("studies"),
    )


def fact_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """A header, a label and bullets per company."""
    s = _summary(spark, sf)
    bullets = F.array(
        F.concat(F.col("total_trials").cast("string"), F.lit(" trials, "), F.col("active_trials").cast("string"), F.lit(" active")),
        F.when(F.col("cash_value").isNotNull(), F.concat(F.lit("cash "), display.millions(F.col("cash_value"), F.col("cash_year")))),
        F.when(F.col("runway").isNotNull(), F.concat(F.lit("cash over R&D "), display.one_decimal(F.col("runway")))),
    )
    return s.select("ticker", display.fact_sheet(F.concat(F.col("name"), F.lit(" ("), F.col("ticker"), F.lit(")")), F.col("sector"), bullets).alias("sheet"))


def filter_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """One line per company with a late-stage trial, with the header of the whole answer."""
    hits = CompanyFilter(has_phase3=True).apply(_summary(spark, sf))
    total = hits.agg(F.count("*").alias("n"))
    line = F.concat(F.lit("- "), F.col("ticker"), F.lit(": "), F.col("active_trials").cast("string"), F.lit(" active of "), F.col("total_trials").cast("string"))
    header = F.concat(F.lit("Total companies matching: "), F.col("n").cast("string"), F.when(F.col("n") > 25, " (25 shown)").otherwise(""))
    return op.ranked(hits, "active_trials", 25).withColumn("n", total.scalar()).select("ticker", line.alias("line"), header.alias("header"))


def one_decimal_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", display.one_decimal(F.col("l_extendedprice") / 8).alias("shown"))


def industry_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Filers with the label of their industry code."""
    labels = {"2834": "Pharma preparations", "2836": "Biologics", "8731": "Bio research"}
    return table(spark, sf, "filer_records").select("filer_id", display.labelled(F.col("sic"), labels).alias("label"))


def unlisted_sectors(spark: SparkSession, sf: str) -> DataFrame:
    """Sectors as companies write them that no label of an industry code equals."""
    return op.unlisted(table(spark, sf, "companies"), industry_labels(spark, sf).withColumnRenamed("label", "sector"), "sector")


def has_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Companies that are named by the lead sponsor of one of their first twenty rows."""
    t = table(spark, sf, "trials").where("company_ticker is not null").select(F.col("company_ticker").alias("ticker"), F.col("id").alias("position"), "lead_sponsor")
    return landing.has_trials(table(spark, sf, "companies").select("ticker", "name"), t)


def stored_else_landed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per company from its last good load, or from all loads where the last one has none."""
    stored = _trials(spark, sf).select("ticker", "id")
    landed = table(spark, sf, "trials").where("company_ticker is not null").select(F.col("company_ticker").alias("ticker"), "id")
    return landing.stored_else_landed(stored, landed, "ticker").groupBy("ticker", "from_store").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def known_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names by company: a filer's title over the company's own name over the stored names, which fall back on those with a number."""
    c = table(spark, sf, "companies")
    stored = landing.read_or(spark, f"{sf}/company_names.json", "ticker STRING, name STRING", c.where("cik is not null").select("ticker", "name"))
    titles = table(spark, sf, "filer_records").where("title is not null").groupBy(names.padded_id(F.col("cik_str").cast("string")).alias("cik")).agg(F.max("title").alias("title"))
    both = c.select("ticker", "cik", "name").join(titles, "cik", "left").join(stored.withColumnRenamed("name", "stored"), "ticker", "left")
    return both.select("ticker", F.coalesce("title", "name", "stored", "ticker").alias("search_name"))


def ticker_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Companies written as entries of a ticker file, read back as a dimension; of several tickers of a number the last stays."""
    c = table(spark, sf, "companies").where("cik rlike '^[0-9]{10}$'")
    entry = F.struct(F.col("cik").cast("bigint").alias("cik_str"), F.lower("ticker").alias("ticker"), F.col("name").alias("title"))
    raw = c.select("created_at", F.to_json(F.create_map(F.col("ticker"), entry)).alias("value"))
    rows = landing.ticker_map(raw).withColumn("position", F.col("ticker"))
    return landing.last_wins(rows, "cik", "position").select("cik", "ticker", "title")


def annual_over_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Figures written as filing concepts under two tags in order, read back: the latest year of either, equal years to the first."""
    f = table(spark, sf, "financials").where("company_ticker is not null and metric is not null and value is not null and fiscal_year is not null")
    years = f.groupBy("company_ticker", "metric", "fiscal_year").agg(F.max("value").alias("val"))
    one = F.struct(F.lit("FY").alias("fp"), F.when(F.col("fiscal_year") % 2 == 0, "10-K").otherwise("20-F").alias("form"), F.col("fiscal_year").alias("fy"), "val")
    lists = years.groupBy("company_ticker", "metric").agg(F.array_sort(F.collect_list(F.struct("fiscal_year", one.alias("e")))).alias("l"))
    entries = F.transform("l", lambda x: x["e"])
    text = F.to_json(F.struct(F.col("company_ticker").alias("cik"), F.col("metric").alias("tag"), F.create_map(F.lit("USD"), entries).alias("units")))
    concepts = lists.select(F.from_json(text, landing.CONCEPT).alias("c")).select("c.*")
    return landing.annual_figures(concepts, ["rd_expense", "cash"]).select("cik", "tag", F.round("value", 6).alias("value"), "fiscal_year")


def fetch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Landed pages per load, with and without an error; only good ones give rows."""
    log = table(spark, sf, "fetch_log").where("feed = 'registry'")
    error = F.when(F.col("outcome") == "failed", F.coalesce("error_text", F.lit("unknown")))
    pages = log.select("load_id", F.col("company_ticker"), error.alias("error"), F.array().cast(f"array<{landing.STUDY}>").alias("studies"))
    return pages.groupBy("load_id", "error").agg(F.count("*").alias("pages"))


def study_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The text blob of each study of the newest load: how often a text occurs and how long it is."""
    t = _trials(spark, sf)
    one = lambda name, value: F.struct(value.alias(name))
    listed = lambda c: F.when(F.col(c) != "", F.array(c))
    ps = F.struct(
        one("briefSummary", F.col("title")).alias("descriptionModule"), one("conditions", listed("phase")).alias("conditionsModule"),
        one("interventions", F.array(one("name", F.col("lead_sponsor")), one("name", F.lit("")))).alias("armsInterventionsModule"),
        one("eligibilityCriteria", F.col("status")).alias("eligibilityModule"),
    )
    return t.select(F.col("ticker"), "nct_id", landing.study_text(ps).alias("text")).select("ticker", "nct_id", F.md5("text").alias("text_md5"), F.length("text").alias("characters"))


def universe_file(spark: SparkSession, sf: str) -> DataFrame:
    """The universe built from listings by industry code, ticker file, studies and figures; written, and read back."""
    f = table(spark, sf, "filer_records").where("sic is not null and cik_str is not null")
    listing = f.select(names.padded_id(F.col("cik_str").cast("string")).alias("cik"), F.col("sic").alias("sector"), F.col("filer_id").alias("position"))
    tickers = ticker_dimension(spark, sf).withColumn("position", F.col("ticker"))
    with_figures = _figures(spark, sf).where("metric = 'rd_expense' and value is not null").select("ticker").distinct()
    have = tickers.join(with_figures, "ticker").select("cik")
    path = shared_folder(spark, "universe")
    landing.write_universe(landing.universe(listing, tickers, _trials(spark, sf).select("ticker"), have), path)
    return spark.read.schema(landing.UNIVERSE).json(path)


def refusal_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Share of fetches that were turned away, by the measure for refused questions."""
    plans = table(spark, sf, "fetch_log").select(F.when(F.col("outcome") == "failed", "refuse").otherwise("filter").alias("intent"))
    return scores.refusal_rate(plans).select(F.round("rate", 6).alias("rate"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """A link per company by its name, and the ticker read back from a deep link."""
    c = table(spark, sf, "companies").where("name is not null")
    return c.select("ticker", display.linked("https://example.org/?q=", F.col("name")).alias("link"), display.linked_ticker(F.concat(F.lit("#/c/"), "ticker", F.lit("/x"))).alias("linked_ticker"))


def load_stamp(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per company as one load stamps them: all of one time."""
    s = landing.stamped(table(spark, sf, "trials").select("company_ticker"))
    return s.groupBy("company_ticker").agg(F.count("*").alias("n"), (F.min("fetched_at") == F.max("fetched_at")).alias("one_time"))


def vector_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as bytes and read back."""
    e = table(spark, sf, "embeddings").select("vec_id", vectors.unpacked(vectors.packed("embedding")).alias("v"))
    return e.select("vec_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


def kept_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A kept index of unit vectors, searched by every hundredth of them."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = vectors.kept_index(e, 64, shared_folder(spark, "index"))
    q = index.where(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")
    return vectors.topk_per_query(index, q, 8, 0.30, 64).select("query_id", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


def plan_search_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """A search plan, with the vector of the smallest id standing for the embedded query."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    first = e.agg(F.min_by("v", "id")).first()[0] or [0.0]
    hits = run_plan(Plan.from_json('{"intent": "search", "query": "like the first", "limit": 5}'), table(spark, sf, "companies"), e, lambda _: list(first))
    return hits.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "matches")


def ingest_two_loads(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table after the last two loads, one after the other: rows, last id and studies with a text per company."""
    t, log = table(spark, sf, "trials").where("company_ticker is not null"), table(spark, sf, "fetch_log").where("feed = 'registry' and outcome = 'ok'")
    last = load_calendar(table(spark, sf, "loads")).rows.orderBy(F.desc("seq")).limit(2).collect()
    root, kept = shared_folder(spark, "stored"), None
    for r in reversed(last):
        begun = F.col("fetched_at") >= F.lit(r["started_at"]).cast("timestamp_ntz")
        rows = t.where(begun & (F.col("fetched_at") < F.lit(r["ends_at"]).cast("timestamp_ntz")) if r["ends_at"] else begun)
        rows = rows.select("company_ticker", "id", "nct_id", "summary", F.lit(None).cast("array<float>").alias("v"))
        kept = warehouse.ingest(spark, root, "trials", rows, log.where(F.col("load_id") == r["load_id"]).select("company_ticker"), carry=("nct_id", "summary", "v"))
        kept = warehouse.embed_stored(spark, root, "trials", _lengths, "id", "summary", "v")
    if kept is None:
        kept = t.limit(0).select("company_ticker", "id", F.lit(None).cast("array<float>").alias("v"))
    return kept.groupBy("company_ticker").agg(F.count("*").alias("n"), F.max("id").alias("last_id"), F.count("v").alias("embedded"), F.sum(F.get("v", F.lit(0))).cast("bigint").alias("characters"))


def _lengths(texts: list[str]) -> np.ndarray:
    """A stand-in for an embedder: a text's length as a vector of one number."""
    return np.array([[len(x)] for x in texts], np.float32)


QUERIES = {
    f.__name__: f
    for f in (
        filer_numbers, figure_availability, company_detail, fact_sheets, filter_sheet, one_decimal_text, industry_labels, unlisted_sectors, has_trials, stored_else_landed,
        known_names, ticker_dimension, annual_over_tags, fetch_outcomes, study_texts, universe_file, refusal_rate, links, load_stamp, vector_blobs, kept_index_topk,
        plan_search_dispatch, ingest_two_loads,
    )
}

_NUM = """num AS (SELECT ticker, coalesce(CASE WHEN regexp_full_match(cik, '[0-9]{10}') THEN cik END, other) AS cik FROM companies
  LEFT JOIN (SELECT title, max(format('{:010d}', cik_str)) AS other FROM filer_records WHERE cik_str IS NOT NULL GROUP BY 1) ON name = title)"""
_AVAILABLE = f"""{_NUM}, wide AS (SELECT ticker, max(value) FILTER (metric = 'rd_expense') AS rd_value, max(fiscal_year) FILTER (metric = 'rd_expense') AS rd_year,
  max(value) FILTER (metric = 'cash') AS cash_value, max(fiscal_year) FILTER (metric = 'cash') AS cash_year FROM lat GROUP BY 1),
av AS (SELECT c.ticker, CASE WHEN cik IS NULL THEN 'no filer number' WHEN rd_year IS NULL AND cash_year IS NULL THEN 'no figures' END AS reason, rd_value, rd_year, cash_value, cash_year
  FROM (SELECT ticker FROM companies) c LEFT JOIN num USING (ticker) LEFT JOIN wide USING (ticker))"""
_LABEL = "CASE sic WHEN '2834' THEN 'Pharma preparations' WHEN '2836' THEN 'Biologics' WHEN '8731' THEN 'Bio research' END"
_DIM = "SELECT cik, ticker, name AS title FROM companies WHERE regexp_full_match(cik, '[0-9]{10}') QUALIFY row_number() OVER (PARTITION BY cik ORDER BY ticker DESC, name) = 1"

SQL = {
    "filer_numbers": f"WITH {_NUM} SELECT * FROM num",
    "figure_availability": f"{CURRENT}, {_AVAILABLE} SELECT ticker, reason IS NULL AS available, reason, {', '.join(f'CASE WHEN reason IS NULL THEN {c} END AS {c}' for c in ('rd_value', 'rd_year', 'cash_value', 'cash_year'))} FROM av",
    "company_detail": f"""{CURRENT}, {_AVAILABLE},
ph AS (SELECT ticker, string_agg(phase || ':' || n, ';' ORDER BY phase) AS by_phase FROM (SELECT ticker, phase, count(*) AS n FROM cur GROUP BY ALL) GROUP BY 1),
st AS (SELECT ticker, string_agg(status || ':' || n, ';' ORDER BY status) AS by_status FROM (SELECT ticker, coalesce(status, 'UNKNOWN') AS status, count(*) AS n FROM cur GROUP BY ALL) GROUP BY 1),
tr AS (SELECT ticker, string_agg(nct_id || ':' || coalesce(status, ''), ';' ORDER BY id, nct_id) AS studies FROM (SELECT * FROM cur QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY id) <= 20) GROUP BY 1)
SELECT s.ticker, name, total_trials AS total, active_trials AS active, terminated_trials AS terminated, coalesce(by_phase, '') AS by_phase, coalesce(by_status, '') AS by_status, reason IS NULL AS available, coalesce(studies, '') AS studies
FROM summary s LEFT JOIN ph USING (ticker) LEFT JOIN st USING (ticker) LEFT JOIN tr USING (ticker) LEFT JOIN av USING (ticker)""",
    "fact_sheets": f"""{CURRENT} SELECT ticker, concat_ws(chr(10), name || ' (' || ticker || ')', sector, '  - ' || total_trials || ' trials, ' || active_trials || ' active',
'  - cash ' || CASE WHEN cash_value IS NOT NULL THEN '$' || round_even(cash_value / 1e6, 0)::BIGINT || 'M (FY' || cash_year || ')' END, '  - cash over R&D ' || format('{{:.1f}}', exact_runway)) AS sheet FROM summary""",
    "filter_sheet": f"{CURRENT} SELECT ticker, '- ' || ticker || ': ' || active_trials || ' active of ' || total_trials AS line, 'Total companies matching: ' || count(*) OVER () || CASE WHEN count(*) OVER () > 25 THEN ' (25 shown)' ELSE '' END AS header "
    "FROM summary WHERE has_phase3 ORDER BY active_trials DESC, ticker LIMIT 25",
    "one_decimal_text": "SELECT l_orderkey, l_linenumber, format('{:.1f}', l_extendedprice::DOUBLE / 8) AS shown FROM lineitem",
    "industry_labels": f"SELECT filer_id, {_LABEL} AS label FROM filer_records",
    "unlisted_sectors": f"SELECT DISTINCT sector FROM companies WHERE sector <> '' AND sector NOT IN (SELECT {_LABEL} FROM filer_records WHERE {_LABEL} IS NOT NULL)",
    "has_trials": f"""WITH w AS (SELECT ticker, name, coalesce(list_filter(list_transform(string_split_regex(lower(name), '[\\s\\p{{Z}}]+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')),
lambda w: w <> '' AND w NOT IN ({', '.join(repr(s) for s in names.SUFFIXES)}))[1], '') AS word FROM companies WHERE name IS NOT NULL),
p AS (SELECT company_ticker, lead_sponsor FROM trials WHERE company_ticker IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_ticker ORDER BY id) <= 20)
SELECT ticker, name FROM w WHERE EXISTS (SELECT 1 FROM p WHERE company_ticker = ticker AND contains(lower(lead_sponsor), word))""",
    "stored_else_landed": f"""{CURRENT} SELECT ticker, true AS from_store, count(*) AS n, max(id) AS last_id FROM cur GROUP BY 1 UNION ALL
SELECT company_ticker, false, count(*), max(id) FROM trials WHERE company_ticker IS NOT NULL AND company_ticker NOT IN (SELECT ticker FROM cur) GROUP BY 1""",
    "known_names": "WITH t AS (SELECT format('{:010d}', cik_str) AS cik, max(title) AS title FROM filer_records WHERE title IS NOT NULL GROUP BY 1) SELECT ticker, coalesce(title, name, ticker) AS search_name FROM companies LEFT JOIN t USING (cik)",
    "ticker_dimension": _DIM,
    "annual_over_tags": """WITH y AS (SELECT company_ticker AS cik, metric AS tag, fiscal_year, max(value) AS value FROM financials WHERE company_ticker IS NOT NULL AND metric IS NOT NULL AND value IS NOT NULL AND fiscal_year IS NOT NULL GROUP BY ALL)
SELECT cik, tag, round(value, 6) AS value, fiscal_year FROM y QUALIFY row_number() OVER (PARTITION BY cik ORDER BY fiscal_year DESC, tag = 'cash') = 1""",
    "fetch_outcomes": "SELECT load_id, CASE WHEN outcome = 'failed' THEN coalesce(error_text, 'unknown') END AS error, count(*) AS pages FROM fetch_log WHERE feed = 'registry' GROUP BY ALL",
    "study_texts": f"""{CURRENT}, x AS (SELECT ticker, nct_id, substr(concat_ws(chr(10), nullif(title, ''), 'Conditions: ' || nullif(phase, ''), 'Interventions: ' || nullif(lead_sponsor, ''), nullif(status, '')), 1, 2000) AS text FROM cur)
SELECT ticker, nct_id, md5(text) AS text_md5, length(text)::INT AS characters FROM x""",
    "universe_file": f"""{CURRENT}, dim AS ({_DIM}), l AS (SELECT format('{{:010d}}', cik_str) AS cik, sic FROM filer_records WHERE sic IS NOT NULL AND cik_str IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik_str ORDER BY filer_id, sic) = 1)
SELECT ticker, title AS name, cik, sic AS sector FROM dim JOIN l USING (cik) WHERE ticker IN (SELECT ticker FROM cur) AND ticker IN (SELECT ticker FROM fig WHERE metric = 'rd_expense' AND value IS NOT NULL)""",
    "refusal_rate": "SELECT round(avg((outcome = 'failed')::INT), 6) AS rate FROM fetch_log",
    "links": "SELECT ticker, 'https://example.org/?q=' || url_encode(name) AS link, regexp_extract(ticker, '^[A-Za-z.]+') AS linked_ticker FROM companies WHERE name IS NOT NULL",
    "load_stamp": "SELECT company_ticker, count(*) AS n, true AS one_time FROM trials GROUP BY 1",
    "vector_blobs": "SELECT vec_id, len(embedding)::INT AS size, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings",
    "kept_index_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, list_cosine_similarity(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(score, 5) AS score FROM s WHERE score >= 0.30 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) <= 8""",
    "plan_search_dispatch": "WITH q AS (SELECT arg_min(embedding::DOUBLE[], vec_id) AS q FROM embeddings), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 5) "
    "SELECT vec_id, round(s, 6) AS score, count(*) OVER () AS matches FROM s WHERE s >= 0.40",
    "ingest_two_loads": """WITH l AS (SELECT load_id, started_at, row_number() OVER (ORDER BY started_at DESC) AS k FROM loads), s AS (SELECT (SELECT started_at FROM l WHERE k = 1) AS b, (SELECT started_at FROM l WHERE k = 2) AS a),
g AS (SELECT DISTINCT k, company_ticker FROM fetch_log JOIN l USING (load_id) WHERE feed = 'registry' AND outcome = 'ok'),
r AS (SELECT t.*, CASE WHEN fetched_at >= b THEN 1 WHEN fetched_at >= a THEN 2 END AS k FROM trials t, s), w AS (SELECT company_ticker, min(k) AS k FROM g WHERE k <= 2 GROUP BY 1)
SELECT company_ticker, count(*) AS n, max(id) AS last_id, count(*) FILTER (summary <> '') AS embedded, sum(length(summary)) FILTER (summary <> '')::BIGINT AS characters FROM r JOIN w USING (company_ticker, k) GROUP BY 1""",
}
