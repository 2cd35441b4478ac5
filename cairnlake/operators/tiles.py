"""Raster and tile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def tile_of(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    """Column and row of the tile that holds a point."""
    x, y = geo.mercator(lon, lat)
    x0, _, y0, _ = geo.tile_range(x, y, x, y, z)
    return x0, y0


def tiles_of_bounds(df: DataFrame, west: Column, south: Column, east: Column, north: Column, zoom: int) -> DataFrame:
    """Every tile of a zoom that the bounds (in degrees) of each row touch: x, y."""
    x0, y0 = geo.mercator(west, south)
    x1, y1 = geo.mercator(east, north)
    a, b, c, d = geo.tile_range(x0, y0, x1, y1, F.lit(float(zoom)))
    return df.withColumn("x", F.explode(F.sequence(a, b))).withColumn("y", F.explode(F.sequence(c, d)))


def owners(tiles: DataFrame, cells: DataFrame, key: list[str], cx: str, cy: str, side: float = 1.0) -> DataFrame:
    """The one cell that owns each tile: the one whose half-open box holds its centre, else the nearest, the lower index on ties.

    Most tiles are settled by an equi-join on squares of ``side``, into which every cell is written. Only those no cell
    holds look at all cells; of these the nearest is kept before anything is shuffled. Tiles and cells without a
    position or bounds have no part in it.
    """
    at = lambda c: F.floor(c / side).cast("long")
    filed = cells.withColumn("_gx", F.explode(F.sequence(at(F.col("west")), at(F.col("east"))))).withColumn("_gy", F.explode(F.sequence(at(F.col("south")), at(F.col("north")))))
    placed = tiles.where(F.col(cx).isNotNull() & F.col(cy).isNotNull()).withColumns({"_gx": at(F.col(cx)), "_gy": at(F.col(cy))})
    inside = (F.col(cx) >= F.col("west")) & (F.col(cx) < F.col("east")) & (F.col(cy) >= F.col("south")) & (F.col(cy) < F.col("north"))
    held = placed.join(filed, ["_gx", "_gy"]).where(inside).groupBy(*key).agg(F.min("cell").alias("cell"))
    dx = F.greatest(F.col("west") - F.col(cx), F.col(cx) - F.col("east"), F.lit(0.0))
    dy = F.greatest(F.col("south") - F.col(cy), F.col(cy) - F.col("north"), F.lit(0.0))
    lost = placed.drop("_gx", "_gy").join(held.select(*key), key, "left_anti")
    nearest = lost.join(cells, F.lit(True)).groupBy(*key).agg(F.min_by("cell", F.struct(dx * dx + dy * dy, "cell")).alias("cell"))
    return held.unionByName(nearest)


def floored_blue(blue: Column, unit: int) -> Column:
    """The blue part floored to a unit; units of 256 and more leave nothing of it."""
    return F.when(F.lit(unit >= 256), F.lit(0)).otherwise((F.floor(blue / unit) * unit).cast("int"))


def sampled(points: DataFrame, raster: DataFrame, key: str) -> DataFrame:
    """Value of each point from the first covering tile (by rank) that has a number there; null if none has.

    ``points`` has key, rank, tile_id, row, col for every candidate tile; the raster is a table of cells, so one
    equi-join reads them all.
    """
    hit = points.join(raster, ["tile_id", "row", "col"], "left").withColumn("_ok", F.col("value").isNotNull() & ~F.isnan("value"))
    return hit.groupBy(key).agg(F.min_by(F.when(F.col("_ok"), F.col("value")), F.when(F.col("_ok"), F.col("rank"))).alias("value"))


def seam_histogram(tiles: DataFrame, most: int) -> DataFrame:
    """Tiles by their distance to the seam, capped; null without a seam."""
    return tiles.select(F.when(F.col("distance").isNotNull(), F.least("distance", F.lit(most))).alias("distance")).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))
