"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm import leakage, linkage, mixing, neighbours, reading, variants
from larkspur.session import spread, table


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.link(table(spark, sf, "sponsor_records"), table(spark, sf, "companies"), table(spark, sf, "filer_records"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("record_id", "ticker")


def p1_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Each linked record with its confidence."""
    return _links(spark, sf).select("record_id", "ticker", F.round("confidence", 6).alias("confidence"))


def p1_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """What the pass of equal numbers blocks together: records and companies under one whole filer number."""
    number = lambda t, key, c: table(spark, sf, t).where(f"{key} is not null").select(key, linkage.number_of(F.col(c))[0].alias("number")).distinct()
    return number("sponsor_records", "record_id", "cik_text").join(number("companies", "ticker", "cik"), "number")


def p7_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a text by source, in one way of writing, and the largest weight and cap wanted of it."""
    docs = table(spark, sf, "documents").where("doc_id is not null and text <> ''").groupBy(mixing.source_key(F.col("source")).alias("source")).agg(F.count("*").alias("documents"))
    wanted = table(spark, sf, "mix_targets").where("target_weight > 0 and max_repeats > 0").groupBy(mixing.source_key(F.col("source")).alias("source"))
    return docs.join(wanted.agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats")), "source", "full_outer")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return variants.variant_pairs(table(spark, sf, "trials"), "lead_sponsor")


def p3_sponsors(spark: SparkSession, sf: str) -> DataFrame:
    """Each spelling with the number of its sponsor, and how many spellings that sponsor has."""
    c = variants.clusters(table(spark, sf, "trials"), "lead_sponsor")
    return c.join(c.groupBy("cluster").agg(F.count("*").alias("spellings")), "cluster").select("name", "cluster", "spellings")


def _newest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors from the newest load's start on; the bound is read first, so that it reaches the scan."""
    last = table(spark, sf, "loads").agg(F.max("started_at")).first()[0]
    return table(spark, sf, "trials").where(F.col("fetched_at") >= F.lit(last).cast("timestamp_ntz")).select("id", F.col("embedding").alias("v"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(_newest_vectors(spark, sf), k=5, floor=0.85, length=64)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p6_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps of at least eight equal words with single substitutions between them, and how far they reach."""
    return leakage.overlaps(table(spark, sf, "documents"), table(spark, sf, "eval_items")).where("matched >= 8")


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return p6_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))


def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with how often it is drawn."""
    return _mix(spark, sf).draws


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The actual share of each source beside its target."""
    return _mix(spark, sf).shares()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels")).select("doc_id", "reading_level")


def p8_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the documents with its frequency rank, the size of the smallest vocabulary that holds it."""
    return reading.word_ranks(reading.with_words(spread(table(spark, sf, "documents"))))


def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, words and mean sentence length per level."""
    levels = reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))
    return levels.groupBy("reading_level").agg(
        F.count("*").alias("documents"), F.sum("n_words").alias("words"), F.exp(F.avg("sentence")).alias("words_per_sentence"), F.exp(F.avg("cover_90")).alias("vocabulary_90")
    )


QUERIES = {
    "p1_found": p1_found, "p1_confidence": p1_confidence, "p1_numbers": p1_numbers,
    "p3_found": p3_found, "p3_sponsors": p3_sponsors,
    "p5_found": p5_found,
    "p6_found": p6_found, "p6_overlaps": p6_overlaps, "p6_items": p6_items,
    "p7_draws": p7_draws, "p7_shares": p7_shares, "p7_sources": p7_sources,
    "p8_found": p8_found, "p8_ranks": p8_ranks, "p8_profile": p8_profile,
}
_INLINE = r"</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|var)(?:\s[^<>]*)?/?>"
_PLAIN = (
    f"regexp_replace(regexp_replace(regexp_replace(text, '{_INLINE}', '', 'gi'), '<[/!?]?[A-Za-z][^<>]*>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g')"
)
_BARE = rf"regexp_replace(strip_accents(replace(replace({_PLAIN}, chr(64257), 'fi'), chr(64258), 'fl')), '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}*_~`]+', '', 'g')"


def _grams(key: str, name: str) -> str:
    words = rf"SELECT {key} AS id, regexp_extract_all(lower({_BARE}), '[\p{{L}}\p{{N}}]+') AS w FROM {name} WHERE text IS NOT NULL"
    return f"SELECT DISTINCT id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM ({words}))"


_LEAKS = f"WITH d AS ({_grams('doc_id', 'documents')}), t AS ({_grams('item_id', 'eval_items')}), l AS (SELECT DISTINCT d.id AS doc_id, t.id AS item_id FROM d JOIN t USING (gram))"

_LISTED = "SELECT {key} AS id, regexp_extract_all(lower(" + _BARE.replace("{", "{{").replace("}", "}}") + "), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL"
_MASKED = " UNION ALL ".join(
    f"SELECT id, i, {m} AS mask, array_to_string([{', '.join(f'w[i + {k}]' for k, c in enumerate(seed) if c == '1')}], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM {{name}})"
    for m, seed in enumerate(leakage.SEEDS)
)
_OVERLAPS = f"""WITH d AS ({_LISTED.format(key='doc_id', table='documents')}), t AS ({_LISTED.format(key='item_id', table='eval_items')}),
dm AS ({_MASKED.format(name='d')}), tm AS ({_MASKED.format(name='t')}),
p AS (SELECT DISTINCT dm.id AS doc_id, tm.id AS item_id, dm.i - tm.i AS s FROM dm JOIN tm USING (mask, gram)),
o AS (SELECT doc_id, item_id, s, unnest(range(greatest(1, 1 - s), least(len(t.w), len(d.w) - s) + 1)) AS k, d.w AS dw, t.w AS tw FROM p JOIN d ON d.id = doc_id JOIN t ON t.id = item_id),
e AS (SELECT doc_id, item_id, s, k, dw[k + s] = tw[k] AS same FROM o),
c AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE -2 END) OVER w AS total, sum((NOT same)::INT) OVER w AS island FROM e WINDOW w AS (PARTITION BY doc_id, item_id, s ORDER BY k)),
g AS (SELECT *, total - CASE WHEN same THEN 1 ELSE -2 END AS prior FROM c),
m AS (SELECT *, min(prior) OVER (PARTITION BY doc_id, item_id, s ORDER BY k) AS lowest FROM g),
b AS (SELECT doc_id, item_id, s, arg_min(k, (-(total - lowest), k)) AS stop, arg_min(lowest, (-(total - lowest), k)) AS low FROM m GROUP BY ALL),
st AS (SELECT m.doc_id, m.item_id, m.s, stop, max(k) AS start FROM m JOIN b USING (doc_id, item_id, s) WHERE k <= stop AND prior = low GROUP BY ALL),
x AS (SELECT doc_id, item_id, s, count(*) FILTER (same) AS matched, count(*) AS span FROM m JOIN st USING (doc_id, item_id, s) WHERE k BETWEEN start AND stop GROUP BY ALL),
r AS (SELECT doc_id, item_id, max(n) AS run FROM (SELECT doc_id, item_id, s, island, count(*) AS n FROM g WHERE same GROUP BY ALL) GROUP BY ALL),
y AS (SELECT doc_id, item_id, max(struct_pack(matched, span)) AS b FROM x GROUP BY ALL)
SELECT doc_id, item_id, run::INT AS run, b.matched::INT AS matched, b.span::INT AS span FROM y JOIN r USING (doc_id, item_id) WHERE b.matched >= 8"""

_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_NUMBER = f"CASE WHEN NOT regexp_matches({{0}}, '\\.\\.|…|\\*|x{{{{2,}}}}') AND length({_DIGITS}) BETWEEN 5 AND 12 THEN nullif(try_cast({_DIGITS} AS BIGINT), 0) END"
_SOURCE = "nullif(regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"

SQL: dict[str, str] = {
    "p6_overlaps": _OVERLAPS,
    "p1_numbers": f"WITH r AS (SELECT DISTINCT record_id, {_NUMBER.format('cik_text')} AS number FROM sponsor_records), c AS (SELECT DISTINCT ticker, {_NUMBER.format('cik')} AS number FROM companies) "
    "SELECT number, record_id, ticker FROM r JOIN c USING (number) WHERE record_id IS NOT NULL AND ticker IS NOT NULL",
    "p7_sources": f"WITH d AS (SELECT {_SOURCE} AS source, count(*) AS documents FROM documents WHERE doc_id IS NOT NULL AND text <> '' GROUP BY 1), "
    f"w AS (SELECT {_SOURCE} AS source, max(target_weight) AS target_weight, max(max_repeats) AS max_repeats FROM mix_targets WHERE target_weight > 0 AND max_repeats > 0 GROUP BY 1) "
    "SELECT coalesce(d.source, w.source) AS source, documents, target_weight, max_repeats FROM d FULL JOIN w ON d.source = w.source",
    "p8_ranks": r"""WITH t AS (SELECT regexp_replace(regexp_replace(text, '<[/!?]?\p{L}[^<>]*>', ' ', 'g'), '&([a-zA-Z]+|#\d+);', ' ', 'g') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(t), '\p{L}+(?:[''’]\p{L}+)*')) AS word FROM t) GROUP BY 1)
SELECT word, sum(count(*)) OVER (ORDER BY n DESC RANGE UNBOUNDED PRECEDING)::BIGINT AS rank FROM c GROUP BY word, n""".replace("\\\\", "\\"),
    "p6_found": f"{_LEAKS} SELECT * FROM l",
    "p6_items": f"{_LEAKS} SELECT item_id, count(*) AS documents FROM l GROUP BY 1",
    "p5_found": """
WITH u AS (SELECT id, embedding::DOUBLE[] AS v FROM trials WHERE fetched_at >= (SELECT max(started_at) FROM loads) AND len(embedding) = 64
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id),
n AS (SELECT a, b FROM s WHERE c >= 0.85 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM n
""",
}
