"""Landed registry and filing records, flattened into typed rows.

Fetching (paging, rate limits, retries) happens before the files land; a record that could not be fetched lands with an
``error``. Readers here are lazy and take the declared schemas, so nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from larkspur.functions.names import first_core_word, padded_id

STUDY = (
    "STRUCT<protocolSection: STRUCT<identificationModule: STRUCT<nctId: STRING, briefTitle: STRING>, statusModule: STRUCT<overallStatus: STRING>, "
    "designModule: STRUCT<phases: ARRAY<STRING>>, sponsorCollaboratorsModule: STRUCT<leadSponsor: STRUCT<name: STRING>>, descriptionModule: STRUCT<briefSummary: STRING>, "
    "conditionsModule: STRUCT<conditions: ARRAY<STRING>>, armsInterventionsModule: STRUCT<interventions: ARRAY<STRUCT<name: STRING>>>, "
    "eligibilityModule: STRUCT<eligibilityCriteria: STRING>>>"
)
PAGE = f"search_name STRING, company_ticker STRING, error STRING, studies ARRAY<{STUDY}>"
CONCEPT = "cik STRING, tag STRING, error STRING, units MAP<STRING, ARRAY<STRUCT<fp: STRING, form: STRING, fy: INT, val: DOUBLE>>>"
TICKER = "STRUCT<cik_str: BIGINT, ticker: STRING, title: STRING>"
UNIVERSE = "ticker STRING, name STRING, cik STRING, sector STRING"
# Forms that hold a year's figures, and the longest text kept of a study.
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A")
TEXT_LENGTH = 2000


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed study pages, one JSON object per line; soft failures keep their ``error`` and no studies."""
    return spark.read.schema(PAGE).json(path)


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONCEPT).json(path)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """The universe file: one JSON array."""
    return spark.read.schema(UNIVERSE).json(path, multiLine=True)


def read_or(spark: SparkSession, path: str, schema: str, fallback: DataFrame) -> DataFrame:
    """The JSON file at ``path``, or ``fallback`` where there is none; rows that don't parse are left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return fallback
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_universe(universe: DataFrame, path: str) -> None:
    """JSON lines in the order of tickers."""
    universe.select("ticker", "name", "cik", "sector").orderBy("ticker").write.mode("overwrite").json(path)


def flatten_studies(pages: DataFrame) -> DataFrame:
    """``(company_ticker, nct_id, title, phase, status, lead_sponsor, summary)``: one row per study of each good page.

    Missing parts of a record give nulls; a study without phases has phase ``N/A``; summary is ``study_text``. Pages
    with an error or without studies give no rows.
    """
    ps = F.col("s.protocolSection")
    phases = F.array_join(ps["designModule"]["phases"], ", ")
    return pages.where("error is null").select("company_ticker", F.explode("studies").alias("s")).select(
        "company_ticker",
        ps["identificationModule"]["nctId"].alias("nct_id"),
        ps["identificationModule"]["briefTitle"].alias("title"),
        F.coalesce(F.nullif(phases, F.lit("")), F.lit("N/A")).alias("phase"),
        ps["statusModule"]["overallStatus"].alias("status"),
        ps["sponsorCollaboratorsModule"]["leadSponsor"]["name"].alias("lead_sponsor"),
        study_text(ps).alias("summary"),
    )


def study_text(ps: Column) -> Column:
    """Summary, conditions, interventions and eligibility, those there are, on lines; the first 2,000 characters."""
    filled = lambda c: F.when(c != "", c)
    listed = lambda label, arr: F.when(F.size(arr) > 0, F.concat(F.lit(label), F.array_join(arr, ", ")))
    names = F.filter(F.transform(ps["armsInterventionsModule"]["interventions"], lambda i: i["name"]), lambda n: n != "")
    parts = (
        filled(ps["descriptionModule"]["briefSummary"]),
        listed("Conditions: ", ps["conditionsModule"]["conditions"]),
        listed("Interventions: ", names),
        filled(ps["eligibilityModule"]["eligibilityCriteria"]),
    )
    return F.substring(F.concat_ws("\n", *parts), 1, TEXT_LENGTH)


def annual_figures(concepts: DataFrame, tags: list[str]) -> DataFrame:
    """``(cik, tag, value, fiscal_year)``: the figure of the latest year over all ``tags`` of a company.

    Equal years go to the first tag, then unit, then entry. Only full-year entries of annual forms count, in any unit.
    """
    rows = concepts.where(F.col("error").isNull() & F.col("tag").isin(tags)).select("cik", "tag", F.posexplode(F.map_entries("units")).alias("unit_at", "u"))
    entries = rows.select("cik", "tag", "unit_at", F.posexplode("u.value").alias("at", "e")).where((F.col("e.fp") == "FY") & F.col("e.form").isin(*ANNUAL_FORMS) & F.col("e.fy").isNotNull())
    tag_at = F.array_position(F.lit(tags), F.col("tag"))
    best = F.max_by(F.struct("tag", F.col("e.val").alias("value"), F.col("e.fy").alias("fiscal_year")), F.struct(F.col("e.fy"), -tag_at, -F.col("unit_at"), -F.col("at")))
    return entries.groupBy("cik").agg(best.alias("b")).select("cik", "b.*")


def ticker_map(raw: DataFrame, column: str = "value") -> DataFrame:
    """``(position, cik, ticker, title)`` from a text column holding a JSON map of entries, in file order."""
    entries = F.map_entries(F.from_json(F.col(column), f"MAP<STRING, {TICKER}>"))
    rows = raw.select(F.posexplode(entries).alias("position", "e"))
    return rows.select("position", padded_id(F.col("e.value.cik_str")).alias("cik"), F.upper("e.value.ticker").alias("ticker"), F.col("e.value.title").alias("title"))


def listed_ids(pages: DataFrame, text: str, pattern: str = r"<cik>(\d+)</cik>") -> DataFrame:
    """Every match of a pattern's first group, with its place in the text; other columns are kept."""
    others = [c for c in pages.columns if c != text]
    return pages.select(*others, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("position", "found"))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one that comes first in ``order``; nulls in ``order`` come last."""
    w = W.partitionBy(key).orderBy(F.col(order).asc_nulls_last(), *[c for c in rows.columns if c not in (key, order)])
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one that comes last in ``order``."""
    w = W.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), *[c for c in rows.columns if c not in (key, order)])
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def overridden(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``overrides`` in place of rows of the same key, and added where there is none."""
    return rows.join(overrides.select(key), key, "left_anti").unionByName(overrides, allowMissingColumns=True)


def universe(listing: DataFrame, tickers: DataFrame, with_trials: DataFrame, with_figures: DataFrame) -> DataFrame:
    """``(ticker, name, cik, sector)`` of listed companies that have a ticker, studies and figures.

    listing: ``cik, sector, position``; a company listed under several codes keeps the first. tickers: ``ticker_map``;
    of several tickers of one company the last stays.
    """
    sectors = first_wins(listing.select("cik", "sector", "position"), "cik", "position").select("cik", "sector")
    named = last_wins(tickers, "cik", "position").select("cik", "ticker", F.col("title").alias("name"))
    both = named.join(sectors, "cik").join(with_trials.select("ticker"), "ticker", "left_semi").join(with_figures.select("cik"), "cik", "left_semi")
    return both.select("ticker", "name", "cik", "sector")


def stamped(rows: DataFrame, column: str = "fetched_at") -> DataFrame:
    """Add the time of the load; all rows of one run get the same."""
    return rows.withColumn(column, F.to_timestamp_ntz(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def stored_else_landed(stored: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """The stored rows, and the landed rows of keys that have none stored; ``from_store`` tells them apart."""
    missed = landed.join(stored.select(key).distinct(), key, "left_anti")
    return stored.withColumn("from_store", F.lit(True)).unionByName(missed.withColumn("from_store", F.lit(False)), allowMissingColumns=True)


def has_trials(companies: DataFrame, studies: DataFrame, first: int = 20) -> DataFrame:
    """Companies ``(ticker, name)`` whose name's first core word is in the lead sponsor of one of their first studies.

    studies: ``(ticker, position, lead_sponsor)``; only the ``first`` by position are looked at. A name without a core
    word is in every lead sponsor; a null name, or null sponsors only, match nothing.
    """
    place = F.row_number().over(W.partitionBy("ticker").orderBy("position"))
    page = studies.select("ticker", "position", "lead_sponsor").withColumn("__place", place).where(F.col("__place") <= first)
    words = companies.select("ticker", first_core_word(F.col("name")).alias("__word"))
    hit = page.join(words, "ticker").where(F.contains(F.lower("lead_sponsor"), F.col("__word"))).select("ticker").distinct()
    return companies.join(hit, "ticker", "left_semi")
