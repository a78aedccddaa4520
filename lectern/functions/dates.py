"""Dates from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """The date in the first ten characters; null if they aren't a full valid date."""
    return _try_date(F.substring(text, 1, 10))


def _try_date(ten: Column) -> Column:
    return F.when(ten.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(ten, "yyyy-MM-dd"))


def date_of_parts(year: Column, month: Column, day: Column) -> Column:
    """A date of texts; month and day are 1 if absent; null without a year or if there is no such day."""
    number = lambda x: F.lpad(F.trim(x), 2, "0")
    one = lambda x: F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.lit("01")).otherwise(number(x))
    return _try_date(F.concat_ws("-", F.lpad(F.trim(year), 4, "0"), one(month), one(day)))


def first_date(*dates: Column) -> Column:
    """Fallback in order of priority."""
    return F.coalesce(*dates)


def date_text(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))


def year_text(date: Column) -> Column:
    return F.coalesce(F.year(date).cast("string"), F.lit(""))
