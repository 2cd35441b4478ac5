"""The corridor of a line: clips, cells, polygons against lines, chains of segments, tile sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import lines as L


def segments_apart(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Planar distance between two segments (ax, ay, bx, by each): 0 if they cross, else the least from an end to the other."""
    ends = [geo.segment_nearest(p[i], p[i + 1], *q)[0] for p, q in ((a, b), (b, a)) for i in (0, 2)]
    return F.when(geo.segments_cross(*a, *b)[0], F.lit(0.0)).otherwise(F.least(*ends))


_ENDS = ("ax", "ay", "bx", "by")


def lines_within(segs: DataFrame, line: str, centre: DataFrame, reach: float) -> DataFrame:
    """Lines of which any part lies within ``reach`` of the centre line; kept whole, never cut. Both have ax, ay, bx, by.

    Cells are as wide as the reach: the lines' segments go into the cells they pass, the centre's into those within the
    reach of it.
    """
    own = L.cells_walked(segs.select(line, *_ENDS), reach, 0.0)
    mid = L.cells_walked(centre.select(*[F.col(c).alias(f"_{c}") for c in _ENDS], *_ENDS), reach, reach).drop(*_ENDS)
    met = own.join(mid, ["_cx", "_cy"])
    near = segments_apart(tuple(map(F.col, _ENDS)), tuple(F.col(f"_{c}") for c in _ENDS)) <= reach
    return met.where(near).select(line).distinct()


def meets_box(ax: Column, ay: Column, bx: Column, by: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a segment has a point in a closed box: what is left of it after the four sides."""
    dx, dy = bx - ax, by - ay
    low, high = F.lit(0.0), F.lit(1.0)
    possible = F.lit(True)
    for start, step, least, most in ((ax, dx, west, east), (ay, dy, south, north)):
        t0, t1 = (least - start) / F.when(step != 0, step), (most - start) / F.when(step != 0, step)
        low, high = F.greatest(low, F.least(t0, t1)), F.least(high, F.greatest(t0, t1))
        possible = possible & ((step != 0) | start.between(least, most))
    return possible & (low <= high)


def corridor_cells(centre: DataFrame, side: float, margin: float) -> DataFrame:
    """(col, row) of the grid cells that the centre line, widened by a margin on all sides, touches."""
    boxed = L.cells_walked(centre.select(*_ENDS), side, margin)
    west, south = F.col("_cx") * side, F.col("_cy") * side
    hit = meets_box(*map(F.col, _ENDS), west - margin, south - margin, west + side + margin, south + side + margin)
    return boxed.where(hit).select(F.col("_cx").alias("col"), F.col("_cy").alias("row")).distinct()


def inside_spans(ax: Column, ay: Column, bx: Column, by: Column, ring: Column) -> Column:
    """Parts of a segment inside a ring, as an array of structs (low, high) of shares of its length; any simple ring, by the even-odd rule."""
    n = F.size(ring)
    dx, dy = bx - ax, by - ay

    def crossing(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % n)
        ex, ey = q["x"] - p["x"], q["y"] - p["y"]
        turn = dx * ey - dy * ex
        t = F.when(turn != 0, ((p["x"] - ax) * ey - (p["y"] - ay) * ex) / turn)
        u = F.when(turn != 0, ((p["x"] - ax) * dy - (p["y"] - ay) * dx) / turn)
        return F.when(t.between(0.0, 1.0) & u.between(0.0, 1.0), t)

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), crossing)), F.array(F.lit(1.0)))))
    spans = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.struct(a.alias("low"), b.alias("high")))
    return F.filter(spans, lambda s: geo.point_in_ring(ax + dx * (s["low"] + s["high"]) / 2, ay + dy * (s["low"] + s["high"]) / 2, ring))


def clipped_ring(ring: Column, other: Column) -> Column:
    """The part of a convex ring inside another, both counter-clockwise: cut off by the sides of the other one after the other."""
    m = F.size(other)

    def cut_by(acc: Column, i: Column) -> Column:
        p, q = F.get(other, i), F.get(other, (i + 1) % m)
        side = lambda v: (q["x"] - p["x"]) * (v["y"] - p["y"]) - (q["y"] - p["y"]) * (v["x"] - p["x"])

        def corner(k: Column) -> Column:
            a, b = F.get(acc, k), F.get(acc, (k + 1) % F.size(acc))
            sa, sb = side(a), side(b)
            t = sa / F.when(sa != sb, sa - sb)
            at = F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))
            return F.array_compact(F.array(F.when(sa >= 0, a), F.when((sa >= 0) != (sb >= 0), at)))

        return F.when(F.size(acc) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(acc) - 1), corner))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), m - 1), ring, cut_by)


def chains(segs: DataFrame, key: str, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, chain): segments merged into chains over the nodes at which exactly two of them end; the chain is its least key.

    Segments merge only if they agree in the columns ``by``. Labels are followed to whole components.
    """
    ends = segs.select(key, *by, F.explode(F.array(a, b)).alias("_node"))
    joint = ends.groupBy("_node").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_a"), F.max(key).alias("_b"), *[F.min(c).eqNullSafe(F.max(c)).alias(f"_{c}") for c in by])
    joint = joint.where("_n = 2 and _a <> _b")
    for c in by:
        joint = joint.where(f"_{c}")
    linked = L.linked_blocks(joint, "_a", "_b")
    return segs.select(key).join(linked.select(F.col("key").alias(key), F.col("block").alias("chain")), key, "left").select(key, F.coalesce("chain", key).alias("chain"))


def seam_distance(tiles: DataFrame, seam: DataFrame, most: int) -> DataFrame:
    """(z, x, y, distance): rings to the nearest seam tile of the same zoom, null beyond ``most``. Seam tiles are written around themselves, so no tile looks at all."""
    steps = F.array(*[F.lit(i) for i in range(-most, most + 1)])
    around = seam.select("z", F.col("x").alias("_x"), F.col("y").alias("_y")).withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    near = around.groupBy("z", (F.col("_x") + F.col("_dx")).alias("x"), (F.col("_y") + F.col("_dy")).alias("y")).agg(F.min(F.greatest(F.abs("_dx"), F.abs("_dy"))).alias("distance"))
    return tiles.join(near, ["z", "x", "y"], "left").select("z", "x", "y", "distance")


def wkt(points: Column) -> Column:
    """LINESTRING text of an array of structs x, y."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def from_wkt(text: Column) -> Column:
    """Structs x, y of a LINESTRING text."""
    pairs = F.regexp_extract_all(text, F.lit(r"(-?[0-9.eE+-]+ -?[0-9.eE+-]+)"), 1)
    return F.transform(pairs, lambda p: F.struct(F.get(F.split(p, " "), F.lit(0)).cast("double").alias("x"), F.get(F.split(p, " "), F.lit(1)).cast("double").alias("y")))
