"""Dates: typed numbers and texts to dates, blocks of weeks, month ordinals, regimes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Monday that blocks of one, two and four weeks are counted from.
ORIGIN = "2019-12-30"


def day_of(number: Column) -> Column:
    """A date from digits yyyymmdd (more digits after them are ignored); null if they are no real date."""
    digits = F.regexp_replace(F.regexp_replace(number.cast("string"), r"\.0+$", ""), r"[^0-9]", "")
    return F.to_date(F.try_to_timestamp(F.when(F.length(digits) >= 8, F.substring(digits, 1, 8)), F.lit("yyyyMMdd")))


def moment_of(number: Column) -> Column:
    """A time from digits yyyymmddhhmmss; null if they are no real time."""
    digits = F.regexp_replace(number.cast("string"), r"[^0-9]", "")
    return F.try_to_timestamp(F.when(F.length(digits) == 14, digits), F.lit("yyyyMMddHHmmss"))


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def block_start(day: Column, weeks: int) -> Column:
    """First day of the block of ``weeks`` weeks that holds a day, also before the origin."""
    width = 7 * weeks
    return F.date_add(F.lit(ORIGIN).cast("date"), (F.floor(F.datediff(day, F.lit(ORIGIN).cast("date")) / width) * width).cast("int"))


def month_ordinal(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def years_from(day: Column, origin: str) -> Column:
    return F.datediff(day, F.lit(origin).cast("date")) / 365.25
