"""Registry tokens (status, phase) and figures in one way of writing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ACTIVE = ("RECRUITING", "ACTIVE_NOT_RECRUITING", "ENROLLING_BY_INVITATION")


def token(c: Column) -> Column:
    """Upper case, every run of other characters one underscore: ``Active, not recruiting`` -> ``ACTIVE_NOT_RECRUITING``.

    Null stays null; a text without letters and digits becomes the empty string.
    """
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def phase_set(c: Column) -> Column:
    """The phases named in a text as a sorted array without repeats: ``Phase 2/Phase 1`` -> ``[PHASE1, PHASE2]``.

    ``N/A`` in any writing is the one-element set ``[NA]``. Null stays null, an empty text is the empty set.
    """
    plain = F.regexp_replace(F.upper(c), r"\bN\s*/\s*A\b", "NA")
    parts = F.transform(F.split(plain, "[,/;|+&]"), lambda x: F.regexp_replace(x, "[^A-Z0-9]+", ""))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def phase_text(c: Column) -> Column:
    """A phase set as the registry writes it: ``PHASE1, PHASE2``, ``EARLY_PHASE1``, ``N/A``; null stays null."""
    named = F.transform(phase_set(c), lambda x: F.when(x == "NA", "N/A").otherwise(F.regexp_replace(x, "^EARLY", "EARLY_")))
    return F.array_join(named, ", ")


def whole(c: Column) -> Column:
    """A figure with its fraction cut off, toward zero; null, NaN and figures beyond 64 bits give null."""
    return F.when(F.abs(c) < F.lit(9.0e18), c).try_cast("bigint")
