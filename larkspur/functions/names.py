"""Company names without punctuation and trailing legal forms, as Column expressions.

Splitting is by any Unicode white space. Null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Trailing legal forms that are not part of a name.
SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "llc", "ltd", "limited", "plc", "ag", "sa", "nv", "holdings")
_TRAILING = rf"(?i)(?:(?:^| )(?:{'|'.join(SUFFIXES)}))+$"


def _words(name: Column, keep: str) -> Column:
    parts = F.transform(F.split(name, r"(?U)\s+"), lambda w: F.regexp_replace(w, f"[^{keep}]", ""))
    return F.filter(parts, lambda w: w != "")


def core_name(name: Column) -> Column:
    """Lower-case words of letters and digits without trailing legal forms; ``Holdings Inc`` gives an empty text."""
    return F.regexp_replace(F.array_join(_words(F.lower(name), "a-z0-9"), " "), _TRAILING, "")


def search_term(name: Column) -> Column:
    """As ``core_name`` with its case kept; the name itself where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.array_join(_words(name, "A-Za-z0-9"), " "), _TRAILING, ""), F.lit("")), name)


def first_core_word(name: Column) -> Column:
    """The first word that is no legal form (leading ones are skipped too), or an empty text."""
    words = F.filter(_words(F.lower(name), "a-z0-9"), lambda w: ~w.isin(*SUFFIXES))
    return F.when(name.isNotNull(), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")))


def sponsor_matches(lead: Column, name: Column) -> Column:
    """The name's core is part of the lead sponsor's; an empty core is part of every name. Null where a side is null."""
    return F.contains(core_name(lead), core_name(name))


def padded_id(number: Column) -> Column:
    """Ten digits with leading zeros; longer numbers are not cut. Texts that are no number give null."""
    n = number.try_cast("bigint")
    return F.when(n.isNotNull(), F.format_string("%010d", n))
