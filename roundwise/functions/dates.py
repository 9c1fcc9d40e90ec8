"""Days are DOUBLE days since 1970-01-01, since a mean visit day has a fraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


ISO = "yyyy-MM-dd"


def parse_day(text: Column, pattern: str = ISO) -> Column:
    """Day number of a date text, NULL where it does not parse.

    ISO dates take the cast, which is several times faster than a pattern; the length
    rules out the bare years and months the cast would also accept.
    """
    if pattern == ISO:
        date = F.when(F.length(text) >= 8, text.try_cast("date"))
    else:
        date = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
    return F.unix_date(date).cast("double")


def day_of(date: Column) -> Column:
    return F.unix_date(date.cast("date")).cast("double")


def date_of(day: Column) -> Column:
    return F.date_from_unix_date(F.floor(day).cast("int"))


def year_of(day: Column) -> Column:
    return F.year(date_of(day))


def years_between(later: Column, earlier: Column) -> Column:
    return (later - earlier) / F.lit(DAYS_PER_YEAR)


def age_at(day: Column, birth_day: Column, reported: Column) -> Column:
    """Completed years at the visit; the reported age where it cannot be computed."""
    return F.coalesce(F.floor(years_between(day, birth_day)).cast("int"), reported)
