"""Figures and texts as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def millions(value: Column, year: Column) -> Column:
    """``$<millions>M (FY<year>)``, halves to the even million; ``n/a`` where the value is missing."""
    shown = F.bround(value.cast("double") / 1e6, 0).cast("bigint").cast("string")
    return F.when(value.isNull(), "n/a").otherwise(F.concat(F.lit("$"), shown, F.lit("M (FY"), F.coalesce(year.cast("string"), F.lit("?")), F.lit(")")))


def short_money(value: Column) -> Column:
    """``$x.xB`` from 1,000 million on, else whole millions with halves upward; ``n/a`` where missing."""
    m = value.cast("double") / 1e6
    tenths = F.floor(F.round(m / 100, 6) + 0.5)
    billions = F.concat(F.lit("$"), (F.floor(tenths / 10)).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("B"))
    return F.when(value.isNull(), "n/a").when(m >= 1000, billions).otherwise(F.concat(F.lit("$"), F.floor(m + 0.5).cast("string"), F.lit("M")))


def grouped(value: Column) -> Column:
    """Whole numbers with commas between thousands."""
    return F.format_number(value.cast("bigint"), 0)


def snippet(text: Column, length: int = 320) -> Column:
    """The first characters on one line; a missing text is empty."""
    return F.substring(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), 1, length)


def escaped(text: Column) -> Column:
    """``& < > "`` as entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else null; a zero a gives 0."""
    return F.when(b > 0, a / b)


def linked(base: str, value: Column) -> Column:
    """``base`` followed by the percent-encoded value; a space becomes ``%20``. Null gives null."""
    return F.concat(F.lit(base), F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")))


def linked_ticker(fragment: Column) -> Column:
    """The ticker in a ``#/c/<letters and dots>`` link, or an empty text."""
    return F.regexp_extract(fragment, r"^#/c/([A-Za-z.]+)", 1)


def one_decimal(x: Column) -> Column:
    """One decimal place of the exact binary value, ties to even, as text: 0.25 gives ``0.2``, 0.35 (a little less) ``0.3``.

    The fraction is taken apart into two pieces whose tenfold is exact, so that a tie is told from its neighbours.
    """
    size = F.abs(x)
    fraction = size - F.floor(size)
    high = F.floor(fraction * 2**26) / 2**26
    tenths = F.floor(high * 10)
    over = (high * 10 - tenths - 0.5) + (fraction - high) * 10
    up = (over > 0) | ((over == 0) & (tenths % 2 == 1))
    all_tenths = F.floor(size) * 10 + tenths + up.cast("bigint")
    sign = F.when((x < 0) & (all_tenths > 0), "-").otherwise("")
    return F.concat(sign, F.floor(all_tenths / 10).cast("string"), F.lit("."), (all_tenths % 10).cast("string"))


def fact_sheet(header: Column, label: Column, evidence: Column) -> Column:
    """Header, label and one bullet per evidence text on lines; missing parts are left out."""
    bullets = F.transform(F.filter(evidence, lambda e: e.isNotNull()), lambda e: F.concat(F.lit("  - "), e))
    return F.concat_ws("\n", header, label, bullets)


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code; an unknown or missing code has none."""
    return F.coalesce(*[F.when(code == k, v) for k, v in labels.items()], F.lit(None).cast("string"))


def first_given(*ids: Column) -> Column:
    """The first identifier that is neither null nor empty."""
    return F.coalesce(*[F.nullif(i, F.lit("")) for i in ids])
