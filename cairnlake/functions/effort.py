"""Walking time, pace, grades, day cost and chart scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that results depend on.
KM_PER_MILE = 1.609344
METRES_PER_FOOT = 0.3048
KM_PER_HOUR = 5.0
ASCENT_M_PER_HOUR = 600.0


def naismith_minutes(miles: Column, ascent_ft: Column) -> Column:
    return miles * KM_PER_MILE / KM_PER_HOUR * 60.0 + ascent_ft * METRES_PER_FOOT / ASCENT_M_PER_HOUR * 60.0


def _bounded(value: Column, low: float, high: float, default: float) -> Column:
    finite = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(default)).otherwise(value)
    return F.greatest(F.lit(low), F.least(F.lit(high), finite))


def pace_minutes(miles: Column, ascent_ft: Column, descent_ft: Column, flat_mph: Column, ascent_m_h: Column, descent_min_km: Column) -> Column:
    """Minutes under a pace of one's own; its three figures are clamped, defaults stand in for what is no number."""
    mph = _bounded(flat_mph, 1.0, 4.0, KM_PER_HOUR / KM_PER_MILE)
    up = _bounded(ascent_m_h, 300.0, 900.0, ASCENT_M_PER_HOUR)
    down = _bounded(descent_min_km, 0.0, 60.0, 0.0)
    fall = F.greatest(F.lit(0.0), F.coalesce(descent_ft, F.lit(0.0))) * METRES_PER_FOOT
    return miles / mph * 60.0 + ascent_ft * METRES_PER_FOOT / up * 60.0 + fall / 1000.0 * down


def pace_ratio(minutes: Column, standard: Column) -> Column:
    return F.when(standard > 0, minutes / standard)


def grade_gate(drop_ft: Column, distance_ft: Column) -> tuple[Column, Column]:
    """Grade, and whether a path passes: under 10 feet, or a grade of at most 0.15."""
    grade = drop_ft / F.greatest(distance_ft, F.lit(1.0))
    return grade, (distance_ft < 10) | (grade <= 0.15)


def day_cost(size: Column, target: float, over: float = 2.25) -> Column:
    off = size - target
    return F.when(off > 0, F.lit(over)).otherwise(F.lit(1.0)) * off * off


def tick_step(span: Column) -> Column:
    """A step of 1, 2, 5 or 10 times a power of ten, about six to a span; 1 for no span."""
    rough = span / 6.0
    unit = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    steps = F.when(rough <= unit, unit).when(rough <= unit * 2, unit * 2).when(rough <= unit * 5, unit * 5).otherwise(unit * 10)
    return F.when(span <= 0, F.lit(1.0)).otherwise(steps)


def clamped_span(low: Column, high: Column, first: Column, last: Column, least: float = 2.0) -> tuple[Column, Column]:
    """A window of at least ``least``, widened about its middle and shifted into [first, last]; all of it if that is shorter."""
    a, b = F.least(low, high), F.greatest(low, high)
    short, middle = b - a < least, (a + b) / 2
    a, b = F.when(short, middle - least / 2).otherwise(a), F.when(short, middle + least / 2).otherwise(b)
    b = F.when(a < first, b + first - a).otherwise(b)
    a = F.greatest(a, first)
    a, b = F.when(b > last, F.greatest(first, a - (b - last))).otherwise(a), F.least(b, last)
    whole = last - first <= least
    return F.when(whole, first).otherwise(a), F.when(whole, last).otherwise(b)


def ribbon(at: Column, way: Column, first: Column, last: Column, width: float = 10.0, behind: float = 1.0) -> tuple[Column, Column]:
    """Ten miles of trail with one behind the walker (five if the way isn't known), slid into [first, last]."""
    back = F.when(way.isNull(), F.lit(width / 2)).when(way == "northbound", F.lit(behind)).otherwise(F.lit(width - behind))
    start = F.least(F.greatest(at - back, first), last - width)
    whole = last - first <= width
    return F.when(whole, first).otherwise(start), F.when(whole, last).otherwise(start + width)
