"""Points near other points or inside regions: grid cells, neighbouring-cell joins, exact verification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def _rows(lat: Column, height: float) -> Column:
    return F.floor(lat / height).cast("long")


def _columns(row: Column, height: float, reach_m: float) -> Column:
    """How many cells go round the globe in a row: each at least as wide as the reach at any latitude of the row and of
    the rows beside it; one where these touch the last degree before a pole."""
    edge = F.greatest(F.abs((row - 1) * height), F.abs((row + 2) * height))
    least = F.lit(math.degrees(reach_m / geo.EARTH_M)) / F.cos(F.radians(F.least(edge, F.lit(89.0))))
    return F.when(edge >= 89.0, F.lit(1).cast("long")).otherwise(F.greatest(F.floor(360.0 / least), F.lit(1)))


def _column(lon: Column, columns: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) * columns / 360.0).cast("long"), columns)


def _cell(row: Column, col: Column) -> Column:
    """Row and column as one number; columns of a metre still stay under 32 bits."""
    return F.shiftleft(row, 32) + col


def cells_of(lat: Column, lon: Column, reach_m: float) -> Column:
    """The cell of a point as a number: cells are at least ``reach_m`` high and wide and close round the globe."""
    height = math.degrees(reach_m / geo.EARTH_M)
    row = _rows(lat, height)
    return _cell(row, _column(lon, _columns(row, height, reach_m)))


def cells_around(lat: Column, lon: Column, reach_m: float) -> Column:
    """All cells that can hold a point within ``reach_m``: three rows, each with its own columns, three cells a row, also over the 180th meridian."""
    height = math.degrees(reach_m / geo.EARTH_M)

    def row_cells(step: int) -> list[Column]:
        row = _rows(lat, height) + step
        columns = _columns(row, height, reach_m)
        col = _column(lon, columns)
        return [_cell(row, F.pmod(col + d, columns)) for d in (-1, 0, 1)]

    return F.array_distinct(F.array(*[c for step in (-1, 0, 1) for c in row_cells(step)]))


def _blocks_reached(cell: Column, reach_m: float) -> Column:
    """All cells into which some point of a cell is written by ``cells_around``: three rows, from beside its west edge to beside its east edge."""
    height = math.degrees(reach_m / geo.EARTH_M)
    row, col = F.shiftright(cell, 32), cell.bitwiseAND(F.lit(0xFFFFFFFF))
    own = _columns(row, height, reach_m)
    west, east = col * 360.0 / own, (col + 1) * 360.0 / own

    def row_blocks(step: int) -> Column:
        columns = _columns(row + step, height, reach_m)
        first, last = F.floor(west * columns / 360.0) - 1, F.floor(east * columns / 360.0) + 1
        return F.transform(F.sequence(first, F.least(last, first + columns)), lambda c: _cell(row + step, F.pmod(c, columns)))

    return F.array_distinct(F.concat(*[row_blocks(step) for step in (-1, 0, 1)]))


def _crowded_cells(left: DataFrame, right: DataFrame, by: list[str], reach_m: float, hot: int) -> DataFrame:
    """(by, _cell, _na, _nb): cells with more than ``hot`` left points, or with right points of a dense cell around, and their shares.

    Both frames have one row a point, with the cell it lies in. Right points are counted before they are written into
    nine cells: a cell that gets more than ``hot`` of them has a cell with over a sixteenth of that beside it, so only
    those are looked at, and what the others add is less than one share more.
    """
    block = [*by, "_cell"]
    many = left.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(*block, F.ceil(F.col("_n") / hot).cast("int").alias("_na"), F.lit(1).alias("_nb"))
    dense = right.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot / 16)
    near = dense.select(*by, "_n", F.explode(_blocks_reached(F.col("_cell"), reach_m)).alias("_cell")).groupBy(*block).agg((F.ceil(F.sum("_n") / hot) + 1).cast("int").alias("_nb"))
    return many.unionByName(near.select(*block, F.lit(1).alias("_na"), "_nb")).groupBy(*block).agg(F.max("_na").alias("_na"), F.max("_nb").alias("_nb"))


def crowded_blocks(counted: DataFrame, block: list[str], a: str, b: str, hot: int) -> DataFrame:
    """(block, _na, _nb) of the blocks with more than ``hot`` rows of either side: how many shares each side is spread over."""
    shares = lambda c: F.greatest(F.ceil(F.col(c) / hot), F.lit(1)).cast("int")
    return counted.where((F.col(a) > hot) | (F.col(b) > hot)).select(*block, shares(a).alias("_na"), shares(b).alias("_nb"))


def join_blocks(a: DataFrame, b: DataFrame, block: list[str], a_id: str, b_id: str, hot: int = 4096, crowded: DataFrame | None = None) -> DataFrame:
    """Join of two frames on their block columns, in which no crowded block is one task.

    A block with more than ``hot`` rows of either side is split into a grid of tasks: each side is spread over shares by
    a hash of its id and copied to the shares of the other. Every pair of the block meets once, as in the plain join.
    ``crowded`` may give the result of ``crowded_blocks`` where it is known already.
    """
    one, none = F.lit(1), F.lit(0)
    if crowded is None:
        both = a.select(*block, one.alias("_a"), none.alias("_b")).unionByName(b.select(*block, none.alias("_a"), one.alias("_b")))
        crowded = crowded_blocks(both.groupBy(*block).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")), block, "_a", "_b", hot)

    def spread(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.coalesce(own, one)).cast("int").alias(f"_s{own}")
        each = F.explode(F.sequence(none, F.coalesce(other, one) - 1)).alias(f"_s{other}")
        return df.join(crowded, block, "left").select(*df.columns, mine, each)

    return spread(a, a_id, "_na", "_nb").join(spread(b, b_id, "_nb", "_na"), [*block, "_s_na", "_s_nb"]).drop("_s_na", "_s_nb")


def pairs_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, lat: str, lon: str, radius_m: float, hot: int = 4096, by: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (id_l, id_r, metres) of a left and a right point at most ``radius_m`` apart by haversine.

    Both frames have their id and the columns ``lat`` and ``lon``; points with a null or NaN position take no part. The
    right side, which should be the smaller, is written into its own cell and the eight around it; the left side only
    into its own, so a pair meets exactly once, also across the 180th meridian. A cell with more than ``hot`` points of
    either side is split into a grid of tasks: each side is spread over shares by a hash of its id and copied to the
    shares of the other, so one crowded place, on whichever side, is worked on by many tasks and nothing is dropped.
    Repeated ids with equal positions give repeated pairs. Points must also agree in the columns ``by`` (null agrees
    with nothing); ``carry`` columns of both come out as c_l and c_r.
    """
    ok = f"{lat} is not null and {lon} is not null and not isnan({lat}) and not isnan({lon})"
    reach = radius_m * (1 + 1e-9)
    packed = [F.struct(*[F.col(c) for c in carry])] if carry else []
    a = left.where(ok).select(F.col(left_id).alias("id_l"), F.col(lat).alias("_la"), F.col(lon).alias("_lo"), *by, *[c.alias("c_l") for c in packed], cells_of(F.col(lat), F.col(lon), reach).alias("_cell"))
    b = right.where(ok).select(F.col(right_id).alias("id_r"), F.col(lat).alias("_ra"), F.col(lon).alias("_ro"), *by, *[c.alias("c_r") for c in packed], F.explode(cells_around(F.col(lat), F.col(lon), reach)).alias("_cell"))
    lying = right.where(ok).select(*by, cells_of(F.col(lat), F.col(lon), reach).alias("_cell"))
    met = join_blocks(a, b, [*by, "_cell"], "id_l", "id_r", hot, _crowded_cells(a, lying, list(by), reach, hot))
    far = geo.haversine_m(F.col("_la"), F.col("_lo"), F.col("_ra"), F.col("_ro"))
    return met.select("id_l", "id_r", far.alias("metres"), *by, *(["c_l", "c_r"] if carry else [])).where(F.col("metres") <= radius_m)


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """For every left id the nearest right id within the radius (ties: smaller id) and the number of points in reach; ids without any are absent."""
    pairs = pairs_within(left, right, left_id, right_id, lat, lon, radius_m)
    best = F.min(F.struct("metres", "id_r"))
    return pairs.groupBy("id_l").agg(best.alias("_best"), F.count(F.lit(1)).alias("in_reach")).select("id_l", F.col("_best.id_r").alias("id_r"), F.col("_best.metres").alias("metres"), "in_reach")


def points_in_regions(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, x: str, y: str, ring: str, cell: float) -> DataFrame:
    """Pairs (point id, region id) of points inside polygons, by the even-odd rule.

    Regions carry ``ring``, an array of structs x, y. Each region is written into the grid cells of its bounding box,
    points into theirs; the exact test follows. A point may lie in several regions; points with null position and
    regions with under three corners give nothing.
    """
    xs, ys = F.col(ring)["x"], F.col(ring)["y"]
    box = regions.select(F.col(region_id), F.col(ring).alias("_ring"), F.array_min(xs).alias("_x0"), F.array_max(xs).alias("_x1"), F.array_min(ys).alias("_y0"), F.array_max(ys).alias("_y1")).where("size(_ring) >= 3")
    spans = [F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)) for lo, hi in (("_x0", "_x1"), ("_y0", "_y1"))]
    keyed = box.withColumn("_cx", F.explode(spans[0])).withColumn("_cy", F.explode(spans[1]))
    placed = points.where(f"{x} is not null and {y} is not null").select(point_id, F.col(x).alias("_px"), F.col(y).alias("_py"), F.floor(F.col(x) / cell).alias("_cx"), F.floor(F.col(y) / cell).alias("_cy"))
    inside = placed.join(keyed, ["_cx", "_cy"]).where(F.col("_px").between(F.col("_x0"), F.col("_x1")) & F.col("_py").between(F.col("_y0"), F.col("_y1")))
    return inside.where(geo.point_in_ring(F.col("_px"), F.col("_py"), F.col("_ring"))).select(point_id, region_id)
