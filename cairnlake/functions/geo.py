"""Spherical, planar and tile geometry as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that results depend on.
EARTH_M = 6371008.8
EARTH_FT = 20902231.0
METRES_PER_DEGREE = 111320.0
METRES_PER_DEGREE_FIRST = 111132.0
METRES_PER_MILE = 1609.344
MERCATOR_HALF = 20037508.342789244


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    s1 = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    s2 = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.asin(F.when(h > 1.0, F.lit(1.0)).otherwise(F.sqrt(h))) * (2 * radius)  # a null stays null, which least() would not let it


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    return _haversine(lat1, lon1, lat2, lon2, EARTH_M)


def haversine_ft(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle feet."""
    return _haversine(lat1, lon1, lat2, lon2, EARTH_FT)


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres with the cosine of the mean latitude."""
    dx = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def flat_first_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres with the cosine of the first latitude and the shorter degree."""
    dx = (lon2 - lon1) * METRES_PER_DEGREE_FIRST * F.cos(F.radians(lat1))
    dy = (lat2 - lat1) * METRES_PER_DEGREE_FIRST
    return F.sqrt(dx * dx + dy * dy)


def segment_nearest(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """Planar distance from a point to a segment, with the foot point; a segment of no length is its point."""
    dx, dy = bx - ax, by - ay
    span = dx * dx + dy * dy
    t = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / span))).otherwise(F.lit(0.0))
    fx, fy = ax + t * dx, ay + t * dy
    return F.sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy)), fx, fy


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> tuple[Column, Column, Column]:
    """Whether two segments cross in one point, and that point (null if not, or if parallel)."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    turn = rx * sy - ry * sx
    t = F.when(turn != 0, ((cx - ax) * sy - (cy - ay) * sx) / turn)
    u = F.when(turn != 0, ((cx - ax) * ry - (cy - ay) * rx) / turn)
    hit = F.coalesce(t.between(0.0, 1.0) & u.between(0.0, 1.0), F.lit(False))
    return hit, F.when(hit, ax + t * rx), F.when(hit, ay + t * ry)


def shoelace(ring: Column) -> Column:
    """Area of a ring, an array of structs x, y; open or closed, any winding."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)) / 2).otherwise(F.lit(0.0))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against an array of structs x, y; under three corners nothing is inside."""
    n = F.size(ring)

    def crossing(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        straddles = (a["y"] > y) != (b["y"] > y)
        return F.when(straddles & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), F.lit(1)).otherwise(F.lit(0))

    hits = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crossing), F.lit(0), lambda a, v: a + v)
    return F.when(n >= 3, hits % 2 == 1).otherwise(F.lit(False))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to spherical Mercator metres."""
    x = lon * (MERCATOR_HALF / 180.0)
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * (MERCATOR_HALF / math.pi)
    return x, y


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    lon = x * (180.0 / MERCATOR_HALF)
    lat = F.degrees(F.atan(F.exp(y * (math.pi / MERCATOR_HALF))) * 2 - F.lit(math.pi / 2))
    return lon, lat


def _albers_constants() -> tuple[float, ...]:
    """GRS80 ellipsoid, parallels 29.5 and 45.5, origin 23 N 96 W."""
    a, f = 6378137.0, 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def q(p: float) -> float:
        s = math.sin(p)
        return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    p0, p1, p2 = map(math.radians, (23.0, 29.5, 45.5))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    return a, e, n, c, a * math.sqrt(c - n * q(p0)) / n


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to conic equal-area metres over the conterminous states."""
    a, e, n, c, rho0 = _albers_constants()
    s = F.sin(F.radians(lat))
    q = (s / (1 - s * s * (e * e)) - F.log((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - e * e)
    rho = F.sqrt(F.lit(c) - q * n) * (a / n)
    theta = F.radians(lon + 96.0) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres back to degrees; the latitude by the series in the authalic latitude, which is good to 1e-7 degrees, a centimetre."""
    a, e, n, c, rho0 = _albers_constants()
    dy = F.lit(rho0) - y
    q = (F.lit(c) - (x * x + dy * dy) * (n * n / (a * a))) / n
    pole = 1 - (1 - e * e) / (2 * e) * math.log((1 - e) / (1 + e))
    beta = F.asin(q / pole)
    e2, e4, e6 = e**2, e**4, e**6
    phi = beta + F.sin(beta * 2) * (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) + F.sin(beta * 4) * (23 * e4 / 360 + 251 * e6 / 3780) + F.sin(beta * 6) * (761 * e6 / 45360)
    return F.degrees(F.atan2(x, dy) / n) - 96.0, F.degrees(phi)


def tile_bounds(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """Mercator west, south, east, north of a tile."""
    side = F.lit(2 * MERCATOR_HALF) / F.pow(F.lit(2.0), z)
    west = x * side - MERCATOR_HALF
    north = F.lit(MERCATOR_HALF) - y * side
    return west, north - side, west + side, north


def tile_range(west: Column, south: Column, east: Column, north: Column, z: Column) -> tuple[Column, Column, Column, Column]:
    """First and last tile column, first and last tile row that bounds touch, clamped to the grid."""
    tiles = F.pow(F.lit(2.0), z)
    side = F.lit(2 * MERCATOR_HALF) / tiles

    def clamp(v: Column) -> Column:
        return F.greatest(F.lit(0), F.least(tiles - 1, F.floor(v))).cast("int")

    return (
        clamp((west + MERCATOR_HALF) / side),
        clamp((east + MERCATOR_HALF) / side),
        clamp((F.lit(MERCATOR_HALF) - north) / side),
        clamp((F.lit(MERCATOR_HALF) - south) / side),
    )
