"""Plain forms of identifiers: one spelling for values that sources write in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted place types.
POI_TYPES = ("shelter", "campsite", "water", "resupply", "crossing", "viewpoint", "parking", "privy")

#: Bounds of a usable position, latitude then longitude.
USABLE_LAT = (33.0, 48.0)
USABLE_LON = (-86.0, -66.0)


def plain(col: Column) -> Column:
    """Trimmed and lower-case; null stays null."""
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))


def plain_source(col: Column) -> Column:
    return F.regexp_replace(plain(col), "[- ]", "_")


def plain_source_id(col: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col, r"[{}]", ""), r"^\s+|\s+$", ""))


def known_type(col: Column) -> Column:
    """The plain form if it is an accepted type, else null."""
    word = plain(col)
    return F.when(word.isin(*POI_TYPES), word)


def usable_position(lat: Column, lon: Column) -> Column:
    """True or false, never null; NaN is not usable."""
    return F.coalesce(lat.between(*USABLE_LAT) & lon.between(*USABLE_LON), F.lit(False))
