"""Registered queries of the extract and load side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from larkspur.functions import names
from larkspur.functions.display import escaped, grouped, snippet
from larkspur.operators import snapshots
from larkspur.sources import landing, warehouse
from larkspur.session import table


def core_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "companies").select("ticker", names.core_name(F.col("name")).alias("core"))


def search_term(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "filer_records").select("filer_id", names.search_term(F.col("title")).alias("term"))


def first_core_word(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sponsor_records").select("record_id", names.first_core_word(F.col("lead_sponsor")).alias("word"))


def padded_cik(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "filer_records").select("filer_id", names.padded_id(F.col("cik_str").cast("string")).alias("cik"))


def sponsor_match(spark: SparkSession, sf: str) -> DataFrame:
    """Trials fetched for a company whose lead sponsor contains the company's core name, counted per company."""
    t = table(spark, sf, "trials").select("company_ticker", "lead_sponsor")
    both = t.join(table(spark, sf, "companies").select(F.col("ticker").alias("company_ticker"), "name"), "company_ticker")
    match = F.coalesce(names.sponsor_matches(F.col("lead_sponsor"), F.col("name")), F.lit(False))
    return both.groupBy("company_ticker").agg(F.count("*").alias("fetched"), F.count_if(match).alias("matching"))


def flatten_studies(spark: SparkSession, sf: str) -> DataFrame:
    """Every trial written as a registry study, then read back and flattened."""
    t = table(spark, sf, "trials")
    phases = F.when(F.col("phase").isNotNull() & (F.col("phase") != "N/A"), F.split("phase", ", ")).otherwise(F.array().cast("array<string>"))
    one = lambda name, value: F.struct(value.alias(name))
    study = F.struct(
        F.struct(
            F.struct(F.col("nct_id").alias("nctId"), F.col("title").alias("briefTitle")).alias("identificationModule"),
            one("overallStatus", F.col("status")).alias("statusModule"),
            one("phases", phases).alias("designModule"),
            one("leadSponsor", one("name", F.col("lead_sponsor"))).alias("sponsorCollaboratorsModule"),
            one("briefSummary", F.col("summary")).alias("descriptionModule"),
        ).alias("protocolSection")
    )
    pages = t.select("company_ticker", F.to_json(F.struct(F.array(study).alias("studies"))).alias("j")).select(
        "company_ticker", F.lit(None).cast("string").alias("error"), F.from_json("j", f"studies ARRAY<{landing.STUDY}>")["studies"].alias("studies")
    )
    return landing.flatten_studies(pages).groupBy("company_ticker", "phase", "status").agg(
        F.count("*").alias("n"), F.countDistinct("nct_id").alias("studies"), F.sum(F.length("summary")).alias("characters"), F.countDistinct("lead_sponsor").alias("sponsors")
    )


def first_title_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Per filer number, the title of the record with the smallest id."""
    f = table(spark, sf, "filer_records").where("cik_str is not null").select("cik_str", "filer_id", "title")
    return landing.first_wins(f, "cik_str", "filer_id")


def last_title_wins(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "filer_records").where("cik_str is not null").select("cik_str", "filer_id", "title")
    return landing.last_wins(f, "cik_str", "filer_id")


def override_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Companies by number, the filer's own title in place of the company's name where there is one."""
    number = F.regexp_replace("cik", "[^0-9]", "").try_cast("bigint")
    c = table(spark, sf, "companies").select(number.alias("cik_str"), "name").where("cik_str is not null")
    f = last_title_wins(spark, sf).where("title is not null").select("cik_str", F.col("title").alias("name"))
    return landing.overridden(c, f, "cik_str")


def listed_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Product codes in documents, each with where it comes among the document's codes."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return landing.listed_ids(d, "text", r"\b([A-Z]{3}-\d{3})\b").groupBy("found").agg(F.count("*").alias("n"), F.min("position").alias("first_position"), F.countDistinct("doc_id").alias("documents"))


def snapshot_replace(spark: SparkSession, sf: str) -> DataFrame:
    """The newest load replaces, in the load before, the rows of the companies it fetched; rows per company.

    This is the last step alone. The stored table after each load, with all steps before it, is ``snapshot_replay``.
    """
    t, log = table(spark, sf, "trials"), table(spark, sf, "fetch_log")
    bounds = table(spark, sf, "loads").orderBy(F.desc("started_at")).select("load_id", "started_at").limit(2).collect()
    (last, start), (_, before) = [*map(tuple, bounds), (None, None), (None, None)][:2]
    cols = ["company_ticker", "nct_id", "id"]
    old = t.where((F.col("fetched_at") >= F.lit(before)) & (F.col("fetched_at") < F.lit(start))).select(*cols)
    new = t.where(F.col("fetched_at") >= F.lit(start)).select(*cols)
    fetched = log.where((F.col("load_id") == last) & (F.col("feed") == "registry") & (F.col("outcome") == "ok")).select("company_ticker")
    return warehouse.replaced(old, new, fetched, "company_ticker").groupBy("company_ticker").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def snapshot_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The stored table after each load: per company the rows of its last load so far whose fetch was ok.

    Rows without a company are fetched for none, so they are never stored. A company whose last good load has no rows
    has no row here.
    """
    t, loads = table(spark, sf, "trials"), table(spark, sf, "loads")
    loads = snapshots.load_calendar(loads)
    calendar = loads.rows
    rows = snapshots.assign_load(t.select("company_ticker", "id", "fetched_at"), loads).groupBy("company_ticker", F.col("load_seq").alias("seq"))
    rows = rows.agg(F.count("*").alias("n"), F.max("id").alias("last_id"))
    ok = table(spark, sf, "fetch_log").where((F.col("feed") == "registry") & (F.col("outcome") == "ok") & F.col("company_ticker").isNotNull())
    ok = ok.join(calendar.select("load_id", "seq"), "load_id").select("company_ticker", "seq").distinct()
    after = F.lead("seq").over(W.partitionBy("company_ticker").orderBy("seq"))
    newest = F.lit(len(loads.starts) if loads.starts is not None else calendar.agg(F.max("seq")).first()[0])
    stored = ok.withColumn("after", after).join(rows, ["company_ticker", "seq"]).withColumn("seq", F.explode(F.sequence("seq", F.coalesce(F.col("after") - 1, newest))))
    return stored.join(calendar.select("load_id", "seq"), "seq").select("load_id", "company_ticker", "n", "last_id")


def pending_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that have a text but no vector yet, per load day."""
    t = table(spark, sf, "trials").where("summary is not null and summary <> '' and embedding is null")
    return t.groupBy(F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"))


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", escaped(snippet(F.col("text"))).alias("snippet"), grouped(F.col("n_chars")).alias("length"))


def json_field(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total_k"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        core_name, search_term, first_core_word, padded_cik, sponsor_match, flatten_studies, first_title_wins, last_title_wins, override_merge, listed_codes,
        snapshot_replace, snapshot_replay, pending_embedding, snippets, json_field,
    )
}

_SUFFIX = f"(?:(?:^| )(?:{'|'.join(names.SUFFIXES)}))+$"
_CORE = "regexp_replace(array_to_string(list_filter(list_transform(string_split_regex(lower({0}), '[\\s\\p{{Z}}]+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> ''), ' '), '" + _SUFFIX.replace("{", "{{").replace("}", "}}") + "', '')"
_TERM = "regexp_replace(array_to_string(list_filter(list_transform(string_split_regex({0}, '[\\s\\p{{Z}}]+'), lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g')), lambda w: w <> ''), ' '), '" + _SUFFIX.replace("{", "{{").replace("}", "}}") + "', '', 'i')"
_ESCAPED = "replace(replace(replace(replace(substr(replace(coalesce(text, ''), chr(10), ' '), 1, 320), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"

SQL = {
    "core_name": f"SELECT ticker, {_CORE.format('name')} AS core FROM companies",
    "search_term": f"SELECT filer_id, coalesce(nullif({_TERM.format('title')}, ''), title) AS term FROM filer_records",
    "first_core_word": "SELECT record_id, CASE WHEN lead_sponsor IS NOT NULL THEN coalesce(list_filter(list_transform(string_split_regex(lower(lead_sponsor), '[\\s\\p{Z}]+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), "
    f"lambda w: w <> '' AND w NOT IN ({', '.join(repr(s) for s in names.SUFFIXES)}))[1], '') END AS word FROM sponsor_records",
    "padded_cik": "SELECT filer_id, format('{:010d}', cik_str) AS cik FROM filer_records",
    "sponsor_match": f"SELECT company_ticker, count(*) AS fetched, count(*) FILTER (contains({_CORE.format('lead_sponsor')}, {_CORE.format('name')})) AS matching "
    "FROM trials JOIN companies ON ticker = company_ticker GROUP BY 1",
    "flatten_studies": "SELECT company_ticker, coalesce(nullif(phase, ''), 'N/A') AS phase, status, count(*) AS n, count(DISTINCT nct_id) AS studies, sum(length(substr(coalesce(summary, ''), 1, 2000)))::BIGINT AS characters, "
    "count(DISTINCT lead_sponsor) AS sponsors FROM trials GROUP BY ALL",
    "first_title_wins": "SELECT cik_str, filer_id, title FROM filer_records WHERE cik_str IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik_str ORDER BY filer_id, title) = 1",
    "last_title_wins": "SELECT cik_str, filer_id, title FROM filer_records WHERE cik_str IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik_str ORDER BY filer_id DESC, title) = 1",
    "override_merge": "WITH f AS (SELECT cik_str, title FROM filer_records WHERE cik_str IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik_str ORDER BY filer_id DESC, title) = 1), "
    "g AS (SELECT cik_str, title AS name FROM f WHERE title IS NOT NULL), c AS (SELECT try_cast(regexp_replace(cik, '[^0-9]', '', 'g') AS BIGINT) AS cik_str, name FROM companies) "
    "SELECT cik_str, name FROM c WHERE cik_str IS NOT NULL AND cik_str NOT IN (SELECT cik_str FROM g) UNION ALL SELECT cik_str, name FROM g",
    "listed_codes": "SELECT found, count(*) AS n, min(position) AS first_position, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(m) AS found, (generate_subscripts(m, 1) - 1)::INT AS position "
    "FROM (SELECT doc_id, regexp_extract_all(text, '\\b([A-Z]{3}-\\d{3})\\b', 1) AS m FROM documents)) GROUP BY 1",
    "snapshot_replace": "WITH l AS (SELECT load_id, started_at, row_number() OVER (ORDER BY started_at DESC) AS k FROM loads), s AS (SELECT (SELECT started_at FROM l WHERE k = 1) AS b, (SELECT started_at FROM l WHERE k = 2) AS a), "
    "ok AS (SELECT company_ticker FROM fetch_log WHERE load_id = (SELECT load_id FROM l WHERE k = 1) AND feed = 'registry' AND outcome = 'ok') "
    "SELECT company_ticker, count(*) AS n, max(id) AS last_id FROM trials, s WHERE (fetched_at >= b AND company_ticker IN (FROM ok)) OR (fetched_at >= a AND fetched_at < b AND (company_ticker IS NULL OR company_ticker NOT IN (FROM ok))) GROUP BY 1",
    "snapshot_replay": "WITH l AS (SELECT load_id, started_at, row_number() OVER (ORDER BY started_at) AS k, lead(started_at) OVER (ORDER BY started_at) AS e FROM (SELECT started_at, max(load_id) AS load_id FROM loads WHERE started_at IS NOT NULL GROUP BY 1)), "
    "r AS (SELECT k, company_ticker, count(*) AS n, max(id) AS last_id FROM trials JOIN l ON fetched_at >= started_at AND (e IS NULL OR fetched_at < e) GROUP BY ALL), "
    "ok AS (SELECT DISTINCT k, company_ticker FROM fetch_log JOIN l USING (load_id) WHERE feed = 'registry' AND outcome = 'ok'), "
    "s AS (SELECT l.load_id, company_ticker, max(ok.k) AS k FROM l JOIN ok ON ok.k <= l.k GROUP BY ALL) SELECT load_id, company_ticker, n, last_id FROM s JOIN r USING (k, company_ticker)",
    "pending_embedding": "SELECT fetched_at::DATE AS day, count(*) AS n FROM trials WHERE summary <> '' AND embedding IS NULL GROUP BY 1",
    "snippets": f"SELECT doc_id, {_ESCAPED} AS snippet, format('{{:,}}', n_chars) AS length FROM documents",
    "json_field": "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total_k, count(*) AS n FROM events GROUP BY 1",
}
