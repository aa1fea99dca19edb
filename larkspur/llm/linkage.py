"""Records of two sources without a common key, by probabilistic record linkage.

Several blocking passes give candidate pairs; each field of a pair is compared on a few agreement levels; the counts of
level patterns are enough to estimate, by expectation-maximisation and without labels, how often matches and non-matches
show each level; the posterior is the confidence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from larkspur.llm.names import KINDS, parsed
from larkspur.llm.tries import edit_join
from larkspur.session import checkpoint_ready

#: Field -> number of agreement levels, the lowest first; null means that a side is missing and says nothing.
LEVELS = {"name": 6, "number": 3, "city": 2, "state": 2, "line": 2}
# How filers and the registry name a line of business, and the industry codes of the same three.
LINES = {
    "biologics": r"biolog|antibod|cell product|^2836",
    "pharma": r"pharma|drug|molecule|^2834",
    "research": r"research|lab\b|^8731",
}


def line_of(c: Column) -> Column:
    """One of ``LINES``, or null."""
    text = F.lower(c)
    return F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in LINES.items()])


def place(c: Column) -> Column:
    """City in lower case, without a state behind a comma; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.substring_index(c, ",", 1)), "[^\\p{L} ]+", "")), F.lit(""))


def number_of(c: Column) -> tuple[Column, Column]:
    """``(whole number, its last four digits if only a part is given)``; other texts give nulls."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    part = c.rlike(r"\.\.|…|\*|x{2,}") | (F.length(digits) < 5)
    whole = F.when(~part & F.length(digits).between(5, 12), digits.try_cast("bigint"))
    return F.nullif(whole, F.lit(0)), F.when(part & (F.length(digits) >= 4), F.substring(digits, -4, 4))


def entities(companies: DataFrame, filers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entity, ticker, number, city, state, line)`` and ``(entity, class, core, legal)``, one row per name it has or had.

    A filer belongs to the company with its number or, where either lacks one, with its exact name. Filers that are no company
    stay as entities without ticker, so that records can match them rather than a company with a similar name. Repeated
    rows count once; null names are no names.
    """
    c = companies.where("ticker is not null").select("ticker", number_of(F.col("cik"))[0].alias("number"), "name", line_of(F.col("sector")).alias("line"))
    f = filers.select(
        F.col("filer_id").cast("string").alias("filer"), F.nullif(F.col("cik_str").cast("bigint"), F.lit(0)).alias("f_number"), "title", "former_title",
        place(F.col("city")).alias("city"), F.upper(F.trim("state_code")).alias("state"), line_of(F.col("sic")).alias("f_line"),
    )
    known = c.where("name is not null").select("name").union(f.select("title")).union(f.select("former_title")).where("name is not null").distinct()
    names = known.repartition(F.xxhash64("name")).withColumn("p", parsed("name")).select("name", "p.class", "p.core", "p.legal").where("core is not null")
    key = F.concat_ws("|", "class", "core")
    named = c.join(names, "name", "left").select("ticker", "number", "line", key.alias("key"))
    by_name = named.where("key <> ''").groupBy("key").agg(F.min("ticker").alias("n_ticker"), F.max("number").alias("n_number"), F.countDistinct("ticker").alias("tickers")).where("tickers = 1")
    by_number = named.where("number is not null").groupBy("number").agg(F.min("ticker").alias("c_ticker"))
    f = f.join(names.select(F.col("name").alias("title"), key.alias("t_key")), "title", "left")
    f = f.join(by_number, F.col("f_number") == F.col("number"), "left").drop("number")
    f = f.join(by_name.select("key", "n_ticker", "n_number"), (F.col("t_key") == F.col("key")) & (F.col("f_number").isNull() | F.col("n_number").isNull()), "left")
    f = f.withColumn("ticker", F.coalesce("c_ticker", "n_ticker"))
    f = f.withColumn("entity", F.coalesce(F.concat(F.lit("t:"), "ticker"), F.concat(F.lit("n:"), F.col("f_number").cast("string")), F.concat(F.lit("f:"), "filer")))
    own = named.select(F.concat(F.lit("t:"), "ticker").alias("entity"), "ticker", "number", F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("state"), "line")
    rows = own.unionByName(f.select("entity", "ticker", F.col("f_number").alias("number"), "city", "state", F.col("f_line").alias("line")))
    attributes = rows.groupBy("entity").agg(
        F.min("ticker").alias("ticker"), *[F.max_by(x, F.struct(F.col(x).isNotNull(), x)).alias(x) for x in ("number", "city", "state", "line")]
    )
    called = c.select(F.concat(F.lit("t:"), "ticker").alias("entity"), "name").union(f.select("entity", "title")).union(f.select("entity", "former_title"))
    return attributes, called.join(names, "name").select("entity", "class", "core", "legal").distinct()


def profiles(records: DataFrame) -> DataFrame:
    """``(profile, record_ids...)``: records with the same compared fields are compared once.

    Returns ``(record_id, profile, class, core, legal, number, tail, city, state, line)``.
    """
    names = records.where("lead_sponsor is not null").select("lead_sponsor").distinct()
    names = names.repartition(F.xxhash64("lead_sponsor")).withColumn("p", parsed("lead_sponsor")).select("lead_sponsor", "p.class", "p.core", "p.legal")
    whole, tail = number_of(F.col("cik_text"))
    r = records.join(names, "lead_sponsor", "left").select(
        "record_id", F.coalesce("class", F.lit("")).alias("class"), "core", "legal", whole.alias("number"), tail.alias("tail"),
        place(F.col("city")).alias("city"), F.upper(F.trim("state_code")).alias("state"), line_of(F.col("focus")).alias("line"),
    )
    fields = ["class", "core", "legal", "number", "tail", "city", "state", "line"]
    return r.withColumn("profile", F.xxhash64(*[x for c in fields for x in (F.col(c).isNull(), F.col(c))])).select("record_id", "profile", *fields)


def _besides(state: str, city: str, core: str) -> Column:
    """What else two sides may agree in: the state, the head of the city, the head of the name."""
    parts = (F.concat(F.lit("s"), state), F.concat(F.lit("c"), F.substring(city, 1, 4)), F.concat(F.lit("n"), F.substring(core, 1, 2)))
    return F.array_compact(F.array(*parts))


def blocked(sides: DataFrame, attributes: DataFrame, called: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate ``(profile, entity)`` pairs of all passes, and the name pass's ``(shard, query, key, edits)``.

    Passes: the same number; the same last four digits and kind of house, with the same state, beginning of the city or
    beginning of the name, so that the few last digits there are make no large groups; own words within the edit bound and
    one kind; the same own words whatever the kind.
    """
    index = called.where("core is not null").select(F.col("class").alias("shard"), F.col("core").alias("key")).distinct()
    asked = sides.where("core is not null").select("class", "core").distinct()
    bare = asked.where("class = ''").select(F.explode(F.array(*map(F.lit, KINDS))).alias("shard"), F.col("core").alias("query"))
    near = edit_join(index, asked.select(F.col("class").alias("shard"), F.col("core").alias("query")).unionByName(bare)).checkpoint()
    p = sides.select("profile", "class", "core", "number", "tail", _besides("state", "city", "core").alias("besides")).alias("p")
    by_number = p.where("number is not null").join(attributes.select("entity", "number"), "number").select("profile", "entity")
    tails = attributes.where("number is not null").select("entity", F.substring(F.lpad(F.col("number").cast("string"), 10, "0"), -4, 4).alias("tail"), "state", "city")
    tails = tails.join(called.select("entity", "class", "core").distinct(), "entity").select("entity", "tail", "class", F.explode(_besides("state", "city", "core")).alias("beside")).distinct()
    asking = p.where("tail is not null").select("profile", "tail", "class", F.explode("besides").alias("beside"))
    by_tail = asking.join(tails, ["tail", "class", "beside"]).select("profile", "entity").distinct()
    hit = near.join(called.select("entity", F.col("class").alias("shard"), F.col("core").alias("key")), ["shard", "key"]).select("shard", "query", "entity").distinct()
    by_name = p.join(hit, (F.col("core") == F.col("query")) & ((F.col("class") == F.col("shard")) | (F.col("class") == ""))).select("profile", "entity")
    by_core = p.where("core is not null").join(called.select("entity", "core").distinct(), "core").select("profile", "entity")
    return by_number.unionByName(by_tail).unionByName(by_name).unionByName(by_core).distinct(), near


def compared(pairs: DataFrame, near: DataFrame, sides: DataFrame, attributes: DataFrame, called: DataFrame) -> DataFrame:
    """``(profile, entity, ticker, <a level per field>)``; of an entity's names the best agreeing one counts.

    name: 5 the same words, 4 one edit, 3 two edits (kinds equal, legal forms equal or missing); 2 a missing kind; 1 a
    kind or legal form that differs; 0 other words. number: 2 equal, 1 the known part or one digit off, 0 differs. city:
    1 within two letters. All but the name are null where a side is missing.
    """
    a = attributes.select("entity", "ticker", *[F.col(c).alias(f"e_{c}") for c in ("number", "city", "state", "line")])
    n = called.select("entity", *[F.col(c).alias(f"e_{c}") for c in ("class", "core", "legal")])
    joined = pairs.join(sides, "profile").join(n, "entity", "left").join(
        near.select(F.col("shard").alias("e_class"), F.col("query").alias("core"), F.col("key").alias("e_core"), "edits"), ["e_class", "core", "e_core"], "left"
    )
    words = F.coalesce("edits", F.when(F.col("core") == F.col("e_core"), 0))
    legal = (F.coalesce("legal", F.lit("")) == "") | (F.coalesce("e_legal", F.lit("")) == "") | (F.col("legal") == F.col("e_legal"))
    full = (F.col("class") == F.col("e_class")) & legal
    bare = ((F.col("class") == "") | (F.col("e_class") == "")) & legal
    name = F.when(words.isNull(), 0).when(full, 5 - words).when(bare, 2).otherwise(1)
    best = joined.groupBy("profile", "entity").agg(F.max(name).alias("name"), *[F.first(c).alias(c) for c in ("number", "tail", "city", "state", "line")])
    j = best.join(a, "entity")
    number = (
        F.when(F.col("e_number").isNull(), None)
        .when(F.col("number").isNotNull(), F.when(F.col("number") == F.col("e_number"), 2).when(F.levenshtein(F.col("number").cast("string"), F.col("e_number").cast("string")) <= 1, 1).otherwise(0))
        .when(F.col("tail").isNotNull(), F.col("e_number").cast("string").endswith(F.col("tail")).cast("int"))
    )
    city = F.when(F.col("city").isNull() | F.col("e_city").isNull(), None).otherwise((F.levenshtein("city", "e_city") <= 2).cast("int"))
    return j.select(
        "profile", "entity", "ticker", F.col("name").cast("int").alias("name"), number.cast("int").alias("number"), city.alias("city"),
        (F.col("state") == F.col("e_state")).cast("int").alias("state"), (F.col("line") == F.col("e_line")).cast("int").alias("line"),
    )


def estimate(patterns: Sequence[Row], rounds: int = 200) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Share of matches, and per field the probability of each level among matches and among non-matches.

    patterns: one row per combination of levels with its count ``n``; there are at most a few hundred, whatever the data.
    """
    n = np.array([r["n"] for r in patterns], float)
    at = {f: np.array([-1 if r[f] is None else r[f] for r in patterns], int) for f in LEVELS}
    share = 0.5
    m = {f: np.array([2.0**k for k in range(size)]) / sum(2.0**k for k in range(size)) for f, size in LEVELS.items()}
    u = {f: v[::-1].copy() for f, v in m.items()}
    for _ in range(rounds):
        odds = _log_odds(at, share, m, u)
        w = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        share = float(np.clip((n * w).sum() / max(n.sum(), 1e-9), 1e-4, 1 - 1e-4))
        for f, size in LEVELS.items():
            for p, weight in ((m, n * w), (u, n * (1 - w))):
                seen = np.array([weight[at[f] == k].sum() for k in range(size)]) + 0.5
                p[f] = seen / seen.sum()
    return share, m, u


def _log_odds(at: dict[str, np.ndarray], share: float, m: dict[str, np.ndarray], u: dict[str, np.ndarray]) -> np.ndarray:
    total = np.full(len(next(iter(at.values()))), np.log(share / (1 - share)))
    for f in LEVELS:
        known = at[f] >= 0
        total[known] += np.log(m[f][at[f][known]] / u[f][at[f][known]])
    return total


def link(records: DataFrame, companies: DataFrame, filers: DataFrame, least: float = 0.5) -> DataFrame:
    """``(record_id, ticker, confidence)``: the company that each record is, under its present or a former name.

    A record matches at most one entity, so the odds of its candidates compete: the confidence is an entity's odds over
    one plus those of all candidates, and the best must reach ``least`` and have a ticker. Records without any name and
    number match nothing; repeated records get the same answer each; null ids give nothing. Names, candidates and levels
    are joined in Spark; only the counts of level patterns reach the driver.
    """
    checkpoint_ready(records.sparkSession)
    records = records.where("record_id is not null").select("record_id", "lead_sponsor", "cik_text", "city", "state_code", "focus").distinct()
    attributes, called = entities(companies, filers)
    attributes, called, rows = attributes.checkpoint(), called.checkpoint(), profiles(records).checkpoint()
    sides = rows.drop("record_id").dropDuplicates(["profile"])
    pairs, near = blocked(sides, attributes, called)
    levels = compared(pairs, near, sides, attributes, called).checkpoint()
    patterns = levels.groupBy(*LEVELS).agg(F.count("*").alias("n")).collect()
    share, m, u = estimate(patterns)
    of = lambda f: reduce(lambda c, k: c.when(F.col(f) == k, float(np.log(m[f][k] / u[f][k]))), range(LEVELS[f]), F.when(F.col(f).isNull(), 0.0))
    odds = F.exp(reduce(lambda s, f: s + of(f), LEVELS, F.lit(float(np.log(share / (1 - share))))))
    w = W.partitionBy("profile")
    scored = levels.withColumn("odds", odds).withColumn("confidence", F.col("odds") / (1 + F.sum("odds").over(w)))
    best = scored.withColumn("place", F.row_number().over(w.orderBy(F.desc("confidence"), "entity"))).where((F.col("place") == 1) & (F.col("confidence") >= least))
    return rows.select("record_id", "profile").join(best.where("ticker is not null"), "profile").groupBy("record_id").agg(
        F.max_by("ticker", F.struct("confidence", "ticker")).alias("ticker"), F.max("confidence").alias("confidence")
    )
