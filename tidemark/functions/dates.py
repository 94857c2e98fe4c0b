"""Calendar windows as column expressions over an explicit as-of date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def anchor(as_of: Column, days_ago: int = 0) -> Column:
    """The last complete day: the day before as_of, ``days_ago`` days earlier."""
    if days_ago < 0:
        raise ValueError("days_ago must not be negative")
    return F.date_sub(as_of, 1 + days_ago)


def window_start(end: Column, days: int) -> Column:
    if days < 1:
        raise ValueError("days must be at least 1")
    return F.date_sub(end, days - 1)


def block_number(day: Column, end: Column) -> Column:
    """Seven-day block of a day counted back from ``end``: 0 for the last, negative after it."""
    return F.floor(F.datediff(end, day) / 7).cast("int")


def weeks_until(event: Column, day: Column) -> Column:
    """Whole weeks to an event, NULL once it is past."""
    return F.when(event >= day, F.floor(F.datediff(event, day) / 7).cast("int"))


def days_between(start: Column, end: Column) -> Column:
    """Every day from start to end, none when end is earlier."""
    return F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def months_around(as_of: Column, ahead: int, back: int = 2) -> Column:
    """First days of the months scanned for events: forward first, then back."""
    first = F.trunc(as_of, "MM")
    return F.array(*[F.add_months(first, i) for i in (*range(ahead), *range(-1, -back - 1, -1))])


def strict_day(text: Column) -> Column:
    """A day written yyyy-MM-dd, NULL for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def contains_day(start: Column, end: Column, day: Column) -> Column:
    """Whether a day lies in an interval of days, both ends included; false for NULL."""
    return F.coalesce(day.between(start, end), F.lit(False))


def first_recovery(start: Column, end: Column, event: Column, days: int = 7) -> Column:
    """Whether a week is the first one after a past event: it ends after the event and begins within ``days`` of it."""
    return F.coalesce((event < end) & (F.datediff(start, event) <= days), F.lit(False))
