"""Lines: nearest segments, linear referencing, calibration, resampling, simplification, clustering of crossings."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut
from .sequence import running_totals


def segments(vertices: DataFrame, line: str, order: str, x: str, y: str) -> DataFrame:
    """(line, seg, ax, ay, bx, by, along): consecutive vertices of each line, with the length before the segment."""
    w = Window.partitionBy(line).orderBy(order)
    v = vertices.select(line, F.col(order).alias("seg"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.lead(x).over(w).alias("bx"), F.lead(y).over(w).alias("by")).where("bx is not null")
    length = F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay")))
    along = F.sum("_len").over(Window.partitionBy(line).orderBy("seg")) - F.col("_len")
    return v.withColumn("_len", length).withColumn("along", along).drop("_len")


def cells_walked(segs: DataFrame, side: float, margin: float) -> DataFrame:
    """Segments (ax, ay, bx, by) in every grid cell they come within ``margin`` of along both axes: adds _cx and _cy.

    Columns are walked one after the other, and of each only the rows that the segment passes in it, so a long slanting
    segment takes as many cells as it is long, not as its box is large.
    """
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = segs.withColumn("_cx", F.explode(F.sequence(F.floor((low - margin) / side), F.floor((high + margin) / side))))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    at = lambda x: F.when(dx != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("ax")) / dx)))
    t0, t1 = at(F.col("_cx") * side - margin), at((F.col("_cx") + 1) * side + margin)
    y0, y1 = F.coalesce(F.col("ay") + t0 * dy, F.col("ay")), F.coalesce(F.col("ay") + t1 * dy, F.col("by"))
    slack = margin * (1 + 1e-9) + side * 1e-9
    return columns.withColumn("_cy", F.explode(F.sequence(F.floor((F.least(y0, y1) - slack) / side), F.floor((F.greatest(y0, y1) + slack) / side))))


def _nearest(placed: DataFrame, segs: DataFrame, point: str, line: str, reach: float) -> DataFrame:
    """(point, distance, line, seg, along, foot_x, foot_y): the nearest segment within ``reach`` of each point with _px and _py.

    Segments are written into the cells (of side ``reach``) they pass, widened by the reach; a point looks into its own
    cell. Only the best segment of each map task is shuffled. Cells hold many times the rows of the segments they come
    from, by whose size the planner would broadcast them.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    walked = cells_walked(segs, reach, reach).hint("merge")
    d, fx, fy = geo.segment_nearest(F.col("_px"), F.col("_py"), *[F.col(c) for c in ("ax", "ay", "bx", "by")])
    met = placed.withColumns({"_cx": cell("_px"), "_cy": cell("_py")}).join(walked, ["_cx", "_cy"]).withColumn("distance", d).where(F.col("distance") <= reach)
    on = F.sqrt((fx - F.col("ax")) * (fx - F.col("ax")) + (fy - F.col("ay")) * (fy - F.col("ay")))
    best = F.struct("distance", line, "seg", (F.col("along") + on).alias("along"), fx.alias("foot_x"), fy.alias("foot_y"))
    return met.groupBy(point).agg(F.min(best).alias("_c")).select(point, "_c.*")


def nearest_segment(points: DataFrame, segs: DataFrame, point: str, x: str, y: str, line: str, reach: float, first: float | None = 0.125) -> DataFrame:
    """(point, line, distance, foot_x, foot_y, along): the nearest segment within ``reach``; points without one are absent.

    Points are looked at within a share ``first`` of the reach before, then within the root of that share: what is found
    there is the nearest, and in a dense net of lines it spares most of the pairs; only the others look over the whole
    reach. Of segments with the same ends only the one that ties go to is kept. None leaves both out (for segments far
    longer than the reach). Ties go to the smaller line, then the earlier segment.
    """
    left = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(point, F.col(x).alias("_px"), F.col(y).alias("_py"))
    found = []
    if first is not None:
        ends = ("ax", "ay", "bx", "by")
        segs = cut(segs.groupBy(*ends).agg(F.min(F.struct(line, "seg", "along")).alias("_s")).select("_s.*", *ends))
        for share in (first, first**0.5):
            found.append(cut(_nearest(left, segs, point, line, reach * share)))
            left = left.join(found[-1].select(point), point, "left_anti")
    best = functools.reduce(DataFrame.unionByName, [*found, _nearest(left, segs, point, line, reach)])
    return best.select(point, line, "distance", "foot_x", "foot_y", "along")


def calibrated(markers: DataFrame, line: str, along: str, mile: str) -> DataFrame:
    """(line, along, mile, reversed): marker knots of each line in order, made monotone.

    A line whose miles fall along it is turned about; then the running maximum stands for a marker out of order.
    """
    slope = markers.groupBy(line).agg((F.count(F.lit(1)) * F.sum(F.col(along) * F.col(mile)) - F.sum(along) * F.sum(mile) < 0).alias("reversed"))
    m = markers.join(slope, line).withColumn("_a", F.when(F.col("reversed"), -F.col(along)).otherwise(F.col(along)))
    w = Window.partitionBy(line).orderBy("_a").rowsBetween(Window.unboundedPreceding, 0)
    return m.select(line, F.col("_a").alias(along), F.max(mile).over(w).alias(mile), "reversed")


def knots(calibration: DataFrame, line: str, along: str, mile: str) -> DataFrame:
    """(line, knots): the knots of a line as one ordered array; a line has as many as markers, a few thousand."""
    return calibration.groupBy(line).agg(F.array_sort(F.collect_list(F.struct(F.col(along).alias("along"), F.col(mile).alias("mile")))).alias("knots"))


def mile_at(knots_: Column, along: Column, metres_per_mile: float = geo.METRES_PER_MILE) -> Column:
    """Mile at a length along a line: straight between the two knots around it, at true scale beyond the ends."""
    n = F.size(knots_)
    first, last = F.get(knots_, F.lit(0)), F.get(knots_, n - 1)
    below = F.filter(knots_, lambda k: k["along"] <= along)
    above = F.filter(knots_, lambda k: k["along"] > along)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    inside = a["mile"] + (b["mile"] - a["mile"]) * (along - a["along"]) / (b["along"] - a["along"])
    return F.when(n == 0, F.lit(None).cast("double")).when(along <= first["along"], first["mile"] - (first["along"] - along) / metres_per_mile).when(along >= last["along"], last["mile"] + (along - last["along"]) / metres_per_mile).otherwise(inside)


def resampled(lengths: DataFrame, line: str, length: str, interval: float) -> DataFrame:
    """(line, along, total): a point every ``interval`` along lines laid end to end in order of ``line``; the remainder carries over.

    A point that falls on a joint belongs to the line that ends there. Where a line starts comes from running totals over
    ranges of lines; the points are made by ``sequence`` on each.
    """
    laid = running_totals(lengths.select(line, F.col(length).alias("_len")), line, {"_until": F.col("_len"), "_n": F.lit(1).cast("long")})
    off = laid.select(line, "_len", (F.col("_until") - F.col("_len")).alias("_off"), "_n")
    low = F.when(F.col("_n") == 1, F.lit(0).cast("long")).otherwise(F.floor(F.col("_off") / interval) + 1)
    high = F.floor((F.col("_off") + F.col("_len")) / interval)
    steps = off.where(high >= low).withColumn("_i", F.explode(F.sequence(low, high)))
    return steps.select(line, (F.col("_i") * interval - F.col("_off")).alias("along"), (F.col("_i") * interval).alias("total"))


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Indices kept by farthest-point simplification, done with a stack and whole arrays of distances; tolerance 0 keeps all."""
    import numpy as np

    if tolerance <= 0 or len(points) < 3:
        return list(range(len(points)))
    at = np.asarray(points, float)
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, way, inner = at[i], at[j] - at[i], at[i + 1 : j]
        span = float(way @ way)
        t = np.clip((inner - a) @ way / span, 0.0, 1.0) if span else np.zeros(len(inner))
        off = ((inner - a - t[:, None] * way) ** 2).sum(1)
        far = int(off.argmax())
        if off[far] > tolerance * tolerance:
            keep.add(i + 1 + far)
            todo += [(i, i + 1 + far), (i + 1 + far, j)]
    return sorted(keep)


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Indices kept by recursive farthest-point simplification, done with a stack; tolerance 0 keeps all."""
    if tolerance <= 0 or len(points) < 3:
        return list(range(len(points)))
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        (ax, ay), (bx, by) = points[i], points[j]
        dx, dy = bx - ax, by - ay
        span = dx * dx + dy * dy
        far, at = -1.0, -1
        for k in range(i + 1, j):
            px, py = points[k]
            t = 0.0 if span == 0 else max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / span))
            d = (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2
            if d > far:
                far, at = d, k
        if far > tolerance * tolerance:
            keep.add(at)
            todo += [(i, at), (at, j)]
    return sorted(keep)


def simplified(vertices: DataFrame, line: str, order: str, x: str, y: str, tolerance: float) -> DataFrame:
    """(line, order) of the vertices kept; one line at a time, lines in parallel."""
    kinds = vertices.select(line, order).schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.iloc[simplify(list(zip(pdf[x], pdf[y])), tolerance)][[line, order]]

    return vertices.select(line, order, x, y).groupBy(line).applyInPandas(one, kinds)


def _to_ends(point: DataFrame) -> DataFrame:
    """Follow the pointers (key, block) to their ends by doubling."""
    point = cut(point)
    while True:
        on = point.select(F.col("key").alias("block"), F.col("block").alias("_next"))
        point = cut(point.select("key", "block").join(on, "block").select("key", F.col("_next").alias("block"), (F.col("_next") != F.col("block")).alias("_moved")))
        if point.where("_moved").isEmpty():
            return point.select("key", "block")


def linked_blocks(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(key, block) of every key of the pairs, block the least key linked to it over any number of pairs.

    Each round points every key to the least of itself and its neighbours, follows the pointers to their ends and joins
    the ends by the pairs that are left, until there are none; pairs are read both ways, and a key paired with itself
    alone is its own block.
    """
    both = F.inline(F.array(F.struct(F.col(a).alias("_a"), F.col(b).alias("_b")), F.struct(F.col(b).alias("_a"), F.col(a).alias("_b"))))
    edges = cut(pairs.select(both).distinct())
    out = None
    while not edges.isEmpty():
        point = _to_ends(edges.groupBy("_a").agg(F.min("_b").alias("_m")).select(F.col("_a").alias("key"), F.least("_a", "_m").alias("block")))
        end = lambda c, n: point.select(F.col("key").alias(c), F.col("block").alias(n))  # noqa: B023, E731
        out = point if out is None else out.join(end("block", "_next"), "block", "left").select("key", F.coalesce("_next", "block").alias("block"))
        edges = cut(edges.join(end("_a", "_ea"), "_a").join(end("_b", "_eb"), "_b").where("_ea <> _eb").select(F.col("_ea").alias("_a"), F.col("_eb").alias("_b")).distinct())
    return edges.select(F.col("_a").alias("key"), F.col("_b").alias("block")) if out is None else out


def greedy_clusters(points: DataFrame, block: str, key: str, rank: str, lat: str, lon: str, reach_m: float) -> DataFrame:
    """(key, head): points taken in order of rank, latitude, longitude and key join the first head within reach, or become one.

    The order matters by definition, so it is replayed inside each block; blocks must be further apart than the reach.
    """
    schema = points.select(F.col(key), F.col(key).alias("head")).schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values([rank, lat, lon, key])
        keys, las, los = pdf[key].tolist(), pdf[lat].to_numpy(), pdf[lon].to_numpy()
        heads, n, out = np.zeros(len(keys), int), 0, []
        for i, k in enumerate(keys):
            own = heads[:n]
            near = np.hypot((los[own] - los[i]) * geo.METRES_PER_DEGREE_FIRST * np.cos(np.radians(las[i])), (las[own] - las[i]) * geo.METRES_PER_DEGREE_FIRST) <= reach_m
            first = int(near.argmax()) if n else 0
            if n and near[first]:
                out.append((k, keys[own[first]]))
            else:
                heads[n], n = i, n + 1
                out.append((k, k))
        return pd.DataFrame(out, columns=[key, "head"])

    return points.select(block, key, rank, lat, lon).groupBy(block).applyInPandas(one, schema)
