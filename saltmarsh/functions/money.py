"""Money, percentages and dates as column expressions. Money is DECIMAL; unknown (null) is never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: VAT rates. Fixed values.
VAT_RATE, REDUCED_VAT_RATE = "0.10", "0.08"


def money(x: Column) -> Column:
    return x.cast("decimal(18,2)")


def round_step(amount: Column, step: int = 1000) -> Column:
    """Nearest multiple of ``step``, halves away from zero, as a whole number."""
    return (F.round(amount.cast("decimal(28,6)") / F.lit(step), 0) * step).cast("long")


def round_money(amount: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.round(amount.cast("decimal(28,6)"), 0).cast("long")


def pct(part: Column, whole: Column) -> Column:
    """part as a percentage of whole with 2 decimals; null where whole is zero or either is unknown."""
    ratio = part.cast("decimal(28,6)") / F.nullif(whole.cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
    return F.round(ratio * 100, 2).cast("double")


def vat(base: Column, reduced: Column) -> tuple[Column, Column]:
    """Tax and total of a base amount; the tax is rounded from the base as it is, the total adds rounded parts."""
    rate = F.when(reduced, F.lit(REDUCED_VAT_RATE).cast("decimal(4,2)")).otherwise(F.lit(VAT_RATE).cast("decimal(4,2)"))
    tax = round_money(base.cast("decimal(28,6)") * rate)
    return tax, round_money(base) + tax


def parse_day(text: Column) -> Column:
    """The date of an ISO text's first ten characters; null where it is none."""
    return F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def period_key(day: Column, granularity: str) -> Column:
    """Label of the month (2026-07), quarter (2026-Q3), half (2026-H2) or year (2026) of a date."""
    year = F.date_format(day, "yyyy")
    if granularity == "month":
        return F.date_format(day, "yyyy-MM")
    if granularity == "quarter":
        return F.concat(year, F.lit("-Q"), F.quarter(day).cast("string"))
    if granularity == "half":
        return F.concat(year, F.when(F.month(day) <= 6, F.lit("-H1")).otherwise(F.lit("-H2")))
    if granularity == "year":
        return year
    raise ValueError(f"granularity {granularity!r} isn't month, quarter, half or year")
