"""Registered queries of the vector search and the evaluation side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.functions.tokens import ACTIVE
from larkspur.operators import claims, scores, vectors
from larkspur.operators.companies import CompanyFilter, company_summary
from larkspur.queries.companies import CURRENT, _figures, _summary, _trials
from larkspur.session import table


def vector_topk_floor(spark: SparkSession, sf: str) -> DataFrame:
    """The eight vectors most similar to one of the table, then those with a cosine of at least 0.40."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    query = e.where("id = 234").select("v").first()
    hits = vectors.topk(e, list(query["v"]) if query else [0.0], 8, 0.40)
    return hits.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def vector_topk_per_query(spark: SparkSession, sf: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 20, against all vectors."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    return vectors.topk_per_query(e, q, 8, 0.30, 64).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def trial_topk_per_query(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the newest load's trials."""
    t = table(spark, sf, "trials").select("id", F.col("embedding").alias("v"))
    q = t.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    return vectors.topk_per_query(t, q, 8, 0.40, 64).select("query_id", "id", F.round("score", 6).alias("score"))


ASKED = {
    "late stage": CompanyFilter(has_phase3=True),
    "cash above R&D": CompanyFilter(min_runway=1.0),
    "bio research": CompanyFilter(sector="Bio research"),
    "cash above 2e9": CompanyFilter(min_cash=2e9),
    "R&D above 1e8": CompanyFilter(min_rd=1e8),
    "more than 20 active": CompanyFilter(min_active_trials=20),
}


def _true_of(t: DataFrame, f: DataFrame, c: DataFrame) -> DataFrame:
    """Companies with what is true of them, ``(ticker, true)``, computed from study and figure rows apart from the summary:
    one row per company, ``true`` an array of questions."""
    newest = f.where("value is not null").groupBy("ticker", "metric").agg(F.max_by("value", "fiscal_year").alias("value"))
    money = newest.groupBy("ticker").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(n) for m, n in (("cash", "cash"), ("rd_expense", "rd"))])
    seen = t.groupBy("ticker").agg(F.bool_or(F.expr("phase like '%PHASE3%' or phase like '%PHASE4%'")).alias("late"), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))
    truths = {
        "late stage": F.col("late"),
        "cash above R&D": F.expr("cash > rd and rd > 0"),
        "bio research": F.expr("sector = 'Bio research'"),
        "cash above 2e9": F.expr("cash > 2e9"),
        "R&D above 1e8": F.expr("rd > 1e8"),
        "more than 20 active": F.expr("active > 20"),
    }
    return c.join(money, "ticker", "left").join(seen, "ticker", "left").select("ticker", F.array_compact(F.array(*[F.when(x, q) for q, x in truths.items()])).alias("true"))


def _marks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Six questions: the engine's filters beside truths from the rows themselves, ``(question, item, s, t)``, and the questions.

    Both answers are columns of one row per company, so the two sides need no join of their items.
    """
    t, f, c = _trials(spark, sf), _figures(spark, sf), table(spark, sf, "companies")
    told = company_summary(c, t, f).select("ticker", F.array_compact(F.array(*[F.when(x.condition(), q) for q, x in ASKED.items()])).alias("told"))
    both = told.join(_true_of(t, f, c.select("ticker", "sector")), "ticker")
    marks = both.select(F.explode(F.array_union("told", "true")).alias("question"), F.col("ticker").alias("item"), "told", "true")
    marks = marks.select("question", "item", F.array_contains("told", F.col("question")).alias("s"), F.array_contains("true", F.col("question")).alias("t"))
    return marks, spark.createDataFrame([(q,) for q in ASKED], "question string")


def precision_recall_exact(spark: SparkSession, sf: str) -> DataFrame:
    r = scores.marked_scores(*_marks(spark, sf))
    return r.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


def mean_scores(spark: SparkSession, sf: str) -> DataFrame:
    m = scores.mean_scores(scores.marked_scores(*_marks(spark, sf)))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def true_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The true companies of each question, from study and figure rows, and how many they are."""
    rows = _true_of(_trials(spark, sf), _figures(spark, sf), table(spark, sf, "companies").select("ticker", "sector"))
    return rows.select(F.explode("true").alias("question"), "ticker").groupBy("question").agg(F.count("*").alias("n"), F.min("ticker").alias("first_ticker"), F.max("ticker").alias("last_ticker"))


def money_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct amounts that documents name, in millions."""
    d = table(spark, sf, "documents").where("doc_id is not null").select("doc_id", F.posexplode(claims.amounts(F.col("text"))).alias("at", "v"))
    return d.groupBy(F.round("v", 6).alias("millions")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def status_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of each kind that a document makes, held against the current status, phase and number of its study."""
    t = _trials(spark, sf).groupBy("nct_id").agg(F.max(F.concat_ws(" ", "nct_id", "status", "phase")).alias("facts"))
    d = table(spark, sf, "documents").select("doc_id", "nct_id", "text").join(t, "nct_id", "left")
    c = d.select("doc_id", F.explode(claims.claims(F.col("text"), F.col("facts"))).alias("c")).select("doc_id", "c.*").where("type in ('status', 'trial')")
    return c.groupBy("type", "text").agg(F.count("*").alias("n"), F.count_if("supported").alias("supported"))


def groundedness_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Per company: sentences written from all trials ever loaded, held against the facts of the newest load."""
    old = table(spark, sf, "trials").where("company_ticker is not null").groupBy(F.col("company_ticker").alias("ticker")).agg(F.countDistinct("nct_id").alias("n"))
    s = _summary(spark, sf).select("ticker", "total_trials", "active_trials", "cash_value")
    money = F.coalesce(F.concat(F.lit(" $"), F.floor(F.col("cash_value") / 1e6).cast("string"), F.lit(" million")), F.lit(""))
    both = s.join(old, "ticker").select(
        "ticker",
        F.concat(F.lit("has "), F.col("n").cast("string"), F.lit(" trials, "), F.col("active_trials").cast("string"), F.lit(" active, more than 3 studies,"), money).alias("answer"),
        F.concat(F.col("total_trials").cast("string"), F.lit(" trials; "), F.col("active_trials").cast("string"), F.lit(" active;"), money).alias("facts"),
    )
    return claims.groundedness(both, "answer", "facts", ["ticker"]).withColumn("rate", F.round("rate", 6))


QUERIES = {
    f.__name__: f
    for f in (vector_topk_floor, vector_topk_per_query, trial_topk_per_query, precision_recall_exact, mean_scores, true_answers, money_claims, status_claims, groundedness_rate)
}

_ANSWERS = f"""{CURRENT}, system AS (
  SELECT 'late stage' AS question, ticker AS item FROM summary WHERE has_phase3 UNION ALL SELECT 'cash above R&D', ticker FROM summary WHERE exact_runway >= 1
  UNION ALL SELECT 'bio research', ticker FROM summary WHERE lower(sector) = 'bio research' UNION ALL SELECT 'cash above 2e9', ticker FROM summary WHERE cash_value >= 2e9
  UNION ALL SELECT 'R&D above 1e8', ticker FROM summary WHERE rd_value >= 1e8 UNION ALL SELECT 'more than 20 active', ticker FROM summary WHERE active_trials >= 20),
truth AS (
  SELECT 'late stage' AS question, ticker AS item FROM summary WHERE late_trials > 0 UNION ALL SELECT 'cash above R&D', ticker FROM summary WHERE cash_value > rd_value AND rd_value > 0
  UNION ALL SELECT 'bio research', ticker FROM summary WHERE sector = 'Bio research' UNION ALL SELECT 'cash above 2e9', ticker FROM summary WHERE cash_value > 2e9
  UNION ALL SELECT 'R&D above 1e8', ticker FROM summary WHERE rd_value > 1e8 UNION ALL SELECT 'more than 20 active', ticker FROM summary WHERE active_trials > 20),
questions AS (SELECT unnest(['late stage', 'cash above R&D', 'bio research', 'cash above 2e9', 'R&D above 1e8', 'more than 20 active']) AS question),
j AS (SELECT coalesce(s.question, t.question) AS question, coalesce(s.item, t.item) AS item, s.item AS s, t.item AS t FROM system s FULL JOIN truth t ON s.question = t.question AND s.item = t.item),
a AS (SELECT question, count(s) AS answered, count(t) AS wanted, count(*) FILTER (s IS NOT NULL AND t IS NOT NULL) AS hits,
  array_to_string(coalesce(list(item ORDER BY item) FILTER (s IS NULL), [])[1:6], ',') AS missed, array_to_string(coalesce(list(item ORDER BY item) FILTER (t IS NULL), [])[1:6], ',') AS extra FROM j GROUP BY 1),
r AS (SELECT q.question, coalesce(answered, 0) AS answered, coalesce(wanted, 0) AS wanted, coalesce(hits, 0) AS hits, coalesce(missed, '') AS missed, coalesce(extra, '') AS extra FROM questions q LEFT JOIN a USING (question)),
sc AS (SELECT question, answered, wanted, hits, CASE WHEN answered = 0 THEN (wanted = 0)::INT::DOUBLE ELSE hits / answered END AS precision, CASE WHEN wanted = 0 THEN 1.0 ELSE hits / wanted END AS recall,
  answered = wanted AND hits = wanted AS exact, missed, extra FROM r)
"""
_AMOUNTS = """WITH m AS (
  SELECT doc_id, 1 AS k, unnest(regexp_extract_all(text, '\\$\\s?([\\d,]+(?:\\.\\d+)?)\\s*(billion|million|thousand|b|m|k)?', 1, 'i')) AS n, unnest(regexp_extract_all(text, '\\$\\s?([\\d,]+(?:\\.\\d+)?)\\s*(billion|million|thousand|b|m|k)?', 2, 'i')) AS u,
    generate_subscripts(regexp_extract_all(text, '\\$\\s?([\\d,]+(?:\\.\\d+)?)\\s*(billion|million|thousand|b|m|k)?', 1, 'i'), 1) AS pos FROM documents
  UNION ALL SELECT doc_id, 2, unnest(regexp_extract_all(text, '\\b([\\d,]+(?:\\.\\d+)?)\\s*(billion|million)\\b', 1, 'i')), unnest(regexp_extract_all(text, '\\b([\\d,]+(?:\\.\\d+)?)\\s*(billion|million)\\b', 2, 'i')),
    generate_subscripts(regexp_extract_all(text, '\\b([\\d,]+(?:\\.\\d+)?)\\s*(billion|million)\\b', 1, 'i'), 1) FROM documents
  UNION ALL SELECT doc_id, 3, unnest(regexp_extract_all(text, '\\b(\\d{1,3}(?:,\\d{3}){2,})\\b', 1)), '', generate_subscripts(regexp_extract_all(text, '\\b(\\d{1,3}(?:,\\d{3}){2,})\\b', 1), 1) FROM documents),
v AS (SELECT doc_id, k, pos, try_cast(replace(n, ',', '') AS DOUBLE) * CASE WHEN lower(u) IN ('billion', 'b') THEN 1000 WHEN lower(u) IN ('million', 'm') THEN 1 WHEN lower(u) IN ('thousand', 'k') THEN 0.001 ELSE 0.000001 END AS v FROM m),
d AS (SELECT doc_id, v FROM v WHERE v IS NOT NULL AND doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, round_even(v, 1) ORDER BY k, pos) = 1)
SELECT round(v, 6) AS millions, count(*) AS n, count(DISTINCT doc_id) AS documents FROM d GROUP BY 1"""
_STATED = ", ".join(f"'{s}'" for s in claims.STATUSES)
_NEAREST = """WITH e AS (SELECT {id} AS id, embedding::DOUBLE[] AS v FROM {table} WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.id AS query_id, e.id AS id, list_cosine_similarity(q.v, e.v) AS score FROM e q JOIN e ON q.id <> e.id WHERE q.id % 20 = 0)
SELECT query_id, id AS {id}, round(score, 6) AS score FROM s WHERE score >= {floor} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 8"""

SQL = {
    "vector_topk_floor": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 234), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 8) "
    "SELECT vec_id, round(s, 6) AS score FROM s WHERE s >= 0.40",
    "vector_topk_per_query": _NEAREST.format(id="vec_id", table="embeddings", floor=0.30),
    "trial_topk_per_query": _NEAREST.format(id="id", table="trials", floor=0.40).replace("id AS id,", "id,").replace("id AS id ", "id "),
    "precision_recall_exact": f"{_ANSWERS} SELECT question, answered, wanted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, exact, missed, extra FROM sc",
    "mean_scores": f"{_ANSWERS} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(exact::INT), 6) AS exact FROM sc",
    "true_answers": f"""{CURRENT}, money AS (SELECT ticker, arg_max(value, fiscal_year) FILTER (metric = 'cash' AND value IS NOT NULL) AS cash, arg_max(value, fiscal_year) FILTER (metric = 'rd_expense' AND value IS NOT NULL) AS rd FROM fig GROUP BY 1),
seen AS (SELECT ticker, bool_or(regexp_matches(phase, 'PHASE[34]')) AS late, count(*) FILTER (status IN ('RECRUITING', 'ACTIVE_NOT_RECRUITING', 'ENROLLING_BY_INVITATION')) AS active FROM cur GROUP BY 1),
a AS (SELECT 'late stage' AS question, ticker FROM companies JOIN seen USING (ticker) WHERE late UNION ALL SELECT 'more than 20 active', ticker FROM companies JOIN seen USING (ticker) WHERE active > 20
  UNION ALL SELECT 'cash above R&D', ticker FROM companies JOIN money USING (ticker) WHERE cash > rd AND rd > 0 UNION ALL SELECT 'cash above 2e9', ticker FROM companies JOIN money USING (ticker) WHERE cash > 2e9
  UNION ALL SELECT 'R&D above 1e8', ticker FROM companies JOIN money USING (ticker) WHERE rd > 1e8 UNION ALL SELECT 'bio research', ticker FROM companies WHERE sector = 'Bio research')
SELECT question, count(*) AS n, min(ticker) AS first_ticker, max(ticker) AS last_ticker FROM a GROUP BY 1""",
    "money_claims": _AMOUNTS,
    "status_claims": f"""{CURRENT}, f AS (SELECT nct_id, max(concat_ws(' ', nct_id, status, phase)) AS facts FROM cur GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS a, coalesce(facts, '') AS r FROM documents LEFT JOIN f USING (nct_id)),
c AS (SELECT 'trial' AS type, text, contains(r, text) AS ok FROM (SELECT unnest(regexp_extract_all(a, 'NCT\\d+')) AS text, r FROM d)
  UNION ALL SELECT 'status', s, contains(lower(r), lower(s)) OR contains(lower(r), replace(lower(s), '_', ' ')) FROM d, (SELECT unnest([{_STATED}]) AS s) WHERE contains(lower(a), lower(s)) OR contains(lower(a), replace(lower(s), '_', ' ')))
SELECT type, text, count(*) AS n, count(*) FILTER (ok) AS supported FROM c GROUP BY ALL""",
    "groundedness_rate": f"""{CURRENT}, o AS (SELECT company_ticker AS ticker, count(DISTINCT nct_id) AS n FROM trials WHERE company_ticker IS NOT NULL GROUP BY 1),
b AS (SELECT ticker, n, total_trials AS t, active_trials AS a, floor(cash_value / 1e6)::BIGINT AS c FROM summary JOIN o USING (ticker)),
k AS (SELECT ticker, 2 + (c IS NOT NULL)::INT AS claims, (n IN (t, a) OR coalesce(n = c, false))::INT + 1 + (c IS NOT NULL)::INT AS supported FROM b)
SELECT ticker, claims::BIGINT AS claims, supported::BIGINT AS supported, round(supported / claims, 6) AS rate FROM k""",
}
