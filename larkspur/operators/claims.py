"""Claims that a text makes (amounts, counts, study numbers, statuses) and whether retrieved text supports them.

All extraction is by built-in expressions on the row that holds both texts; nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Patterns of amounts and counts, status tokens, and phrases before a number that make it a threshold.
DOLLARS = r"(?i)\$\s?([\d,]+(?:\.\d+)?)\s*(billion|million|thousand|b|m|k)?"
WORDED = r"(?i)\b([\d,]+(?:\.\d+)?)\s*(billion|million)\b"
GROUPED = r"\b(\d{1,3}(?:,\d{3}){2,})\b"
COUNTED = r"\b(\d+)\s+(trials?|active|terminated|programs?|companies|studies)"
STATUSES = ("RECRUITING", "ACTIVE_NOT_RECRUITING", "ENROLLING_BY_INVITATION", "COMPLETED", "TERMINATED", "WITHDRAWN", "SUSPENDED", "NOT_YET_RECRUITING")
THRESHOLDS = ("more than", "over ", "at least", "fewer than", "less than", "greater than", "than ", "under ")
#: How far an amount may be off, as a share of the larger.
TOLERANCE = 0.03


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _in_millions(number: Column, unit: Column) -> Column:
    n = F.replace(number, F.lit(","), F.lit("")).try_cast("double")
    u = F.lower(unit)
    return F.when(u.isin("billion", "b"), n * 1000).when(u.isin("million", "m"), n).when(u.isin("thousand", "k"), n / 1000).otherwise(n / 1e6)


def amounts(text: Column) -> Column:
    """All amounts in millions, in order of pattern and place; of those equal to a tenth only the first. A number of
    commas alone is dropped."""
    pairs = [F.zip_with(_all(text, p, 1), _all(text, p, 2), _in_millions) for p in (DOLLARS, WORDED)]
    plain = F.transform(_all(text, GROUPED, 1), lambda n: _in_millions(n, F.lit("")))
    values = F.filter(F.concat(*pairs, plain), lambda v: v.isNotNull())
    keyed = F.transform(values, lambda v: F.struct(F.bround(v, 1).alias("k"), v.alias("v")))
    seen = F.transform(keyed, lambda x: x["k"])
    return F.transform(F.filter(keyed, lambda x, i: F.array_position(seen, x["k"]) == i + 1), lambda x: x["v"])


def amount_supported(v: Column, found: Column) -> Column:
    return F.exists(found, lambda r: F.abs(v - r) <= F.lit(TOLERANCE) * F.greatest(v, r, F.lit(1.0)))


def counts(text: Column) -> Column:
    """``{number, noun}`` of each count that is not a threshold repeated: no such phrase lies in the 16 characters before."""
    before = "".join(f"(?<!{w}[\\s\\S]{{0,{16 - len(w)}}})" for w in THRESHOLDS)
    pattern = f"(?i){before}{COUNTED}"
    return F.zip_with(_all(text, pattern, 1), _all(text, pattern, 2), lambda n, w: F.struct(n.alias("number"), w.alias("noun")))


def claims(answer: Column, retrieved: Column) -> Column:
    """``array<struct<type, text, supported>>``. A null text counts as empty.

    money: within 3 % of a retrieved amount. count: the number stands by itself in the retrieved text. trial: the study
    number is part of it. status: the token, or its words, occur in both, in any case.
    """
    a, r = F.coalesce(answer, F.lit("")), F.coalesce(retrieved, F.lit(""))
    claim = lambda kind, text, ok: F.struct(F.lit(kind).alias("type"), text.alias("text"), ok.alias("supported"))
    found, numbers = amounts(r), _all(r, r"(?<!\d)\d+(?!\d)", 0)
    shown = lambda v: F.when(v < 1000, F.concat(F.lit("$"), F.bround(v, 0).cast("bigint").cast("string"), F.lit("M"))).otherwise(F.format_string("$%.2fB", v / 1000))
    says = lambda text, s: F.contains(F.lower(text), F.lower(s)) | F.contains(F.lower(text), F.lower(F.replace(s, F.lit("_"), F.lit(" "))))
    stated = F.filter(F.array(*map(F.lit, STATUSES)), lambda s: says(a, s))
    return F.concat(
        F.transform(amounts(a), lambda v: claim("money", shown(v), amount_supported(v, found))),
        F.transform(counts(a), lambda c: claim("count", F.concat(c["number"], F.lit(" "), c["noun"]), F.array_contains(numbers, c["number"]))),
        F.transform(_all(a, r"NCT\d+", 0), lambda n: claim("trial", n, F.contains(r, n))),
        F.transform(stated, lambda s: claim("status", s, says(r, s))),
    )


def groundedness(rows: DataFrame, answer: str, retrieved: str, by: list[str] | None = None) -> DataFrame:
    """``(<by>, claims, supported, rate)``: supported claims over all claims; 1.0 where no claim is made."""
    c = rows.withColumn("__c", claims(F.col(answer), F.col(retrieved)))
    each = c.withColumns({"__n": F.size("__c"), "__s": F.size(F.filter("__c", lambda x: x["supported"]))})
    sums = each.groupBy(*(by or [])).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("claims"), F.coalesce(F.sum("__s"), F.lit(0)).alias("supported"))
    return sums.withColumn("rate", F.coalesce(F.try_divide(F.col("supported").cast("double"), F.col("claims")), F.lit(1.0)))
