"""Dates and ages. Every 'now' is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def staleness(last: Column, now: Column) -> Column:
    """fresh up to 14 days, ageing up to 60, else stale; never without a date."""
    age = days_between(now, last)
    return F.when(last.isNull(), F.lit("never")).when(age <= 14, F.lit("fresh")).when(age <= 60, F.lit("ageing")).otherwise(F.lit("stale"))


def age_text(at: Column, now: Column) -> Column:
    days = F.floor(days_between(now, at))
    return F.when(days <= 0, F.lit("today")).when(days == 1, F.lit("yesterday")).otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def day_of_millis(millis: Column) -> Column:
    return F.to_date(F.timestamp_millis(millis))


def weekday_on_or_before(day: Column, weekday: str = "Tue") -> Column:
    return F.date_sub(F.next_day(day, weekday), 7)


def direction(start: Column, end: Column) -> Column:
    """northbound unless the end lies before the start."""
    return F.when(end >= start, F.lit("northbound")).otherwise(F.lit("southbound"))
