"""Queries over the trail's corridor: clips, cells, polygons, chains, tile sets. The centre line runs through the notes, half mile by half mile."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.plain import usable_position
from ..operators import corridor as C
from ..operators import lines as L
from ..operators import nearby, tiles
from ..operators import sequence as S
from ..session import cut, table
from . import lines as line_queries
from . import warehouse
from .conditions import closures, notes
from .places import current_places

#: Metres a degree along both axes at 40 north, for the planar stand-in.
EAST_M, NORTH_M = 111320.0 * math.cos(math.radians(40.0)), 111320.0


def centreline(spark: SparkSession, d: str) -> DataFrame:
    """Vertices: of every half mile the note with the least id. Parts are a hundred miles long."""
    rows = notes(spark, d).where("mile is not null and lat is not null and lon is not null")
    v = rows.groupBy(F.floor(F.col("mile") * 2).alias("seq")).agg(F.min_by(F.struct("lat", "lon", "mile"), "id").alias("v"))
    return v.select("seq", F.floor(F.col("seq") / 200).alias("part"), "v.lat", "v.lon", "v.mile")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the centre line in degrees: part, seq, ax, ay, bx, by (x is the longitude)."""
    w = Window.partitionBy("part").orderBy("seq")
    v = centreline(spark, d)
    return v.select("part", "seq", F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.lead("lon").over(w).alias("bx"), F.lead("lat").over(w).alias("by")).where("bx is not null")


def _planar(df: DataFrame) -> DataFrame:
    return df.withColumns({"ax": F.col("ax") * EAST_M, "bx": F.col("bx") * EAST_M, "ay": F.col("ay") * NORTH_M, "by": F.col("by") * NORTH_M})


def j03_clipped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Closures as lines from end to end: those of which any part lies within a kilometre of the centre line."""
    own = closures(spark, d).where("start_lat is not null and start_lon is not null and end_lat is not null and end_lon is not null")
    own = own.select("id", F.col("start_lon").alias("ax"), F.col("start_lat").alias("ay"), F.col("end_lon").alias("bx"), F.col("end_lat").alias("by"))
    return C.lines_within(_planar(own), "id", _planar(_segments(spark, d)), 1000.0)


def a03_corridor(spark: SparkSession, d: str) -> DataFrame:
    """Places in the corridor: within five kilometres of a segment of the centre line, by source. No polygon is made."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    p = p.select("poi_key", "source", (F.col("longitude") * EAST_M).alias("x"), (F.col("latitude") * NORTH_M).alias("y"))
    segs = _planar(_segments(spark, d)).withColumn("along", F.lit(0.0)).withColumnRenamed("seq", "seg")
    near = L.nearest_segment(p, segs, "poi_key", "x", "y", "part", 5000.0, first=None)
    return p.join(near.select("poi_key"), "poi_key", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def r08_cells(spark: SparkSession, d: str) -> DataFrame:
    """One-degree cells that the corridor, a quarter degree wide on all sides, touches."""
    return C.corridor_cells(_segments(spark, d), 1.0, 0.25)


def j12_fine_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same for cells of a tenth of a degree around the bare line."""
    return C.corridor_cells(_segments(spark, d), 0.1, 0.0)


def j13_quads(spark: SparkSession, d: str) -> DataFrame:
    """Eighth-degree map quads that meet the corridor of a twentieth of a degree, numbered in one."""
    q = C.corridor_cells(_segments(spark, d), 0.125, 0.05)
    return q.select((F.col("row") * 10000 + F.col("col")).alias("quad"), (F.col("col") * 0.125).alias("west"), (F.col("row") * 0.125).alias("south"))


def j29_quads_of_cells(spark: SparkSession, d: str) -> DataFrame:
    """How many quads overlap each one-degree cell (widened by a hundredth, so quads on a border belong to two); touching is not overlapping."""
    cells = r08_cells(spark, d).select(F.col("col").cast("double").alias("w"), F.col("row").cast("double").alias("s"))
    reach = cells.withColumn("_c", F.explode(F.sequence(F.floor(F.col("w")).cast("long") - 1, F.floor(F.col("w")).cast("long") + 1))).withColumn("_r", F.explode(F.sequence(F.floor(F.col("s")).cast("long") - 1, F.floor(F.col("s")).cast("long") + 1)))
    q = j13_quads(spark, d).withColumns({"_c": F.floor("west"), "_r": F.floor("south")})
    over = (F.col("west") < F.col("w") + 1.01) & (F.col("west") + 0.125 > F.col("w") - 0.01) & (F.col("south") < F.col("s") + 1.01) & (F.col("south") + 0.125 > F.col("s") - 0.01)
    return q.join(reach, ["_c", "_r"]).where(over).groupBy(F.col("w").cast("long").alias("col"), F.col("s").cast("long").alias("row")).agg(F.count(F.lit(1)).alias("quads"))


def _bands(spark: SparkSession, radius: float) -> DataFrame:
    """Diamonds of some radius around every other degree, each of one of four classes; 88 by construction."""
    x, y = F.col("cx"), F.col("cy")
    corner = lambda dx, dy: F.struct((x + dx * radius).cast("double").alias("x"), (y + dy * radius).cast("double").alias("y"))
    grid = spark.range(-86, -65, 2).select(F.col("id").alias("cx")).crossJoin(spark.range(33, 49, 2).select(F.col("id").alias("cy")))
    return grid.select("cx", "cy", F.pmod(F.floor(x / 2) + F.floor(y / 2) * 2, F.lit(4)).alias("level"), F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1)).alias("ring"))


def a12_band_miles(spark: SparkSession, d: str) -> DataFrame:
    """Miles of the centre line in each class of area. The areas of a class are dissolved: where two of them overlap a stretch counts once."""
    bands = _bands(spark, 1.2)
    cell = bands.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("cx") - 1.2), F.floor(F.col("cx") + 1.2)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("cy") - 1.2), F.floor(F.col("cy") + 1.2))))
    segs = L.cells_walked(_segments(spark, d), 1.0, 0.0)
    met = segs.join(cell, ["_cx", "_cy"]).dropDuplicates(["part", "seq", "cx", "cy"])
    spans = met.select("part", "seq", "level", "ax", "ay", "bx", "by", F.inline(C.inside_spans(*map(F.col, C._ENDS), F.col("ring"))))
    merged = S.merged_intervals(spans, ["level", "part", "seq"], "low", "high")
    length = geo.haversine_m(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx")) / geo.METRES_PER_MILE
    miles = merged.join(_segments(spark, d), ["part", "seq"]).select("level", ((F.col("end") - F.col("start")) * length).alias("m"))
    return miles.groupBy("level").agg(F.round(F.sum("m"), 3).alias("miles"))


def a14_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of areas of different classes that overlap by more than a millionth of a square degree."""
    b = _bands(spark, 1.2)
    o = b.select(*[F.col(c).alias(f"o_{c}") for c in b.columns])
    near = (F.struct("cx", "cy") < F.struct("o_cx", "o_cy")) & (F.abs(F.col("cx") - F.col("o_cx")) < 2.4) & (F.abs(F.col("cy") - F.col("o_cy")) < 2.4)
    pairs = b.join(F.broadcast(o), near & (F.col("level") != F.col("o_level")))  # 88 areas
    area = geo.shoelace(C.clipped_ring(F.col("ring"), F.col("o_ring")))
    return pairs.select("cx", "cy", "o_cx", "o_cy", F.round(area, 6).alias("area")).where("area > 0.000001")


def _network(spark: SparkSession, d: str) -> DataFrame:
    """Segments from node to node: a row of parts with gaps at every seventeenth, and a spur off every twenty-ninth."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    main = p.where("p_partkey % 17 <> 0").select((k * 2).alias("seg"), k.alias("a"), (k + 1).alias("b"), F.floor(k / 40).alias("blaze"), (k % 3).alias("name"))
    spur = p.where("p_partkey % 29 = 0").select((k * 2 + 1).alias("seg"), k.alias("a"), (-k).alias("b"), F.floor(k / 40).alias("blaze"), (k % 3).alias("name"))
    return main.unionByName(spur)


def a04_chains(spark: SparkSession, d: str) -> DataFrame:
    """Segments merged into chains wherever exactly two of them meet."""
    return C.chains(_network(spark, d), "seg", "a", "b").groupBy("chain").agg(F.count(F.lit(1)).alias("n"))


def a23_merged_trails(spark: SparkSession, d: str) -> DataFrame:
    """Chains within one blaze; a chain has a name only if all its segments have the same."""
    net = cut(_network(spark, d).withColumn("name", F.when(F.col("blaze") % 2 == 0, F.lit(7)).otherwise(F.col("name"))))
    out = net.join(C.chains(net, "seg", "a", "b", ("blaze",)), "seg")
    return out.groupBy("chain", "blaze").agg(F.when(F.min("name") == F.max("name"), F.max("name")).alias("name"), F.count(F.lit(1)).alias("n"))


def w39_oriented(spark: SparkSession, d: str) -> DataFrame:
    """Lines in order along the axis between two termini, turned about where they run against it."""
    v = line_queries._vertices(spark, d)
    ends = v.groupBy("line").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    along = lambda p: F.col(f"{p}.x") * 0.6 - F.col(f"{p}.y") * 0.8
    turned = along("b") < along("a")
    start = F.least(along("a"), along("b"))
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("start", "line"))
    return ends.select("line", F.floor(F.col("line") / 100).alias("sheet"), turned.alias("turned"), F.round(start, 6).alias("start")).withColumn("place", place.cast("long"))


def w25_placed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the centre line by the mile of their first marker; one without any takes the mile of the nearest marker of all."""
    v = centreline(spark, d)
    marks = v.where("part % 3 <> 2")
    own = marks.groupBy("part").agg(F.min("mile").alias("start"))
    first = v.groupBy("part").agg(F.min_by(F.struct("lat", "lon"), "seq").alias("p")).join(own, "part", "left")
    lost = first.where("start is null").select("part", "p.lat", "p.lon")
    near = nearby.nearest_within(lost.withColumn("key", F.col("part")), marks.withColumn("key", F.col("seq")), "key", "key", "lat", "lon", 80_000.0)
    anchored = near.join(marks.select(F.col("seq").alias("id_r"), "mile"), "id_r").select(F.col("id_l").alias("part"), F.col("mile").alias("anchor"))
    return first.join(anchored, "part", "left").select("part", F.coalesce("start", "anchor").alias("start"), F.col("start").isNull().alias("anchored"))


def r02_export_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of an export: of the wide corridor at zooms 5 to 8, of the narrow band at 9 to 11; counts by zoom."""
    v = centreline(spark, d)
    out = None
    for z in range(5, 12):
        m = 0.5 if z < 9 else 0.05
        t = tiles.tiles_of_bounds(v.select("lon", "lat"), F.col("lon") - m, F.col("lat") - m, F.col("lon") + m, F.col("lat") + m, z).select(F.lit(z).alias("z"), "x", "y").distinct()
        out = t if out is None else out.unionByName(t)
    return out.groupBy("z").agg(F.count(F.lit(1)).alias("n"))


def r05_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Fifty-mile stretches that five points along each closure reach, with two miles of margin."""
    c = closures(spark, d).where("start_mile_marker is not null and end_mile_marker is not null")
    m = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("id", (F.col("start_mile_marker") + (F.col("end_mile_marker") - F.col("start_mile_marker")) * F.col("i") / 4).alias("m"))
    low, high = F.greatest(F.floor((F.col("m") - 2) / 50), F.lit(0)), F.least(F.floor((F.col("m") + 2) / 50), F.lit(43))
    return m.withColumn("stretch", F.explode(F.sequence(low, high))).select("id", "stretch").distinct()


def x23_spans(spark: SparkSession, d: str) -> DataFrame:
    """The span of every stretch in use; the last one is short."""
    s = r05_stretches(spark, d).select("stretch").distinct()
    return s.select("stretch", (F.col("stretch") * 50.0).alias("start"), F.least(F.col("stretch") * 50.0 + 50.0, F.lit(2190.0)).alias("end"))


def r06_miles(spark: SparkSession, d: str) -> DataFrame:
    """Miles of projected points: Mercator metres back to degrees, then the vertex nearest within five kilometres."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    x, y = geo.mercator(F.col("longitude"), F.col("latitude"))
    lon, lat = geo.mercator_inverse(F.col("mx"), F.col("my"))
    pts = p.select(F.col("poi_key").alias("key"), x.alias("mx"), y.alias("my")).select("key", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))
    v = centreline(spark, d).select(F.format_string("%08d", "seq").alias("key"), "lat", "lon", "mile")
    best = nearby.nearest_within(pts, v, "key", "key", "lat", "lon", 5000.0)
    return best.join(v.select(F.col("key").alias("id_r"), "mile"), "id_r").select(F.col("id_l").alias("poi_key"), F.round("mile", 3).alias("mile"))


def r09_dem_cells(spark: SparkSession, d: str) -> DataFrame:
    """Names of the one-degree height cells that boxes of half a degree around closures touch."""
    c = closures(spark, d).where("start_lat is not null and start_lon is not null")
    cell = c.select(F.explode(F.sequence(F.floor(F.col("start_lat") - 0.5), F.floor(F.col("start_lat") + 0.5))).alias("s"), "start_lon").withColumn("w", F.explode(F.sequence(F.floor(F.col("start_lon") - 0.5), F.floor(F.col("start_lon") + 0.5))))
    return cell.select(F.format_string("n%02dw%03d", F.col("s") + 1, -F.col("w")).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def _tile_set(spark: SparkSession, d: str, where: str) -> DataFrame:
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude"))).where(where)
    out = None
    for z in (8, 9, 10):
        x, y = tiles.tile_of(F.col("longitude"), F.col("latitude"), F.lit(float(z)))
        t = p.select(F.lit(z).alias("z"), x.alias("x"), y.alias("y")).groupBy("z", "x", "y").agg((F.count(F.lit(1)) * 100).alias("bytes"))
        out = t if out is None else out.unionByName(t)
    return out


def a27_shared(spark: SparkSession, d: str) -> DataFrame:
    """Tiles and bytes of one region by zoom, and how many of them another region needs too."""
    a, b = _tile_set(spark, d, "latitude < 41"), _tile_set(spark, d, "latitude >= 40").select("z", "x", "y", F.lit(1).alias("s"))
    return a.join(b, ["z", "x", "y"], "left").groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("bytes"), F.count("s").alias("shared"), F.coalesce(F.sum(F.when(F.col("s") == 1, F.col("bytes"))), F.lit(0)).alias("shared_bytes"))


def snk08_package(spark: SparkSession, d: str) -> DataFrame:
    """Tiles copied to a package: the whole footprint up to zoom 8, above it only those of the region."""
    every, region = _tile_set(spark, d, "true"), _tile_set(spark, d, "latitude between 39 and 41").select("z", "x", "y")
    kept = every.where("z <= 8").unionByName(every.where("z > 8").join(region, ["z", "x", "y"], "left_semi"))
    return kept.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("bytes"))


def x24_seam(spark: SparkSession, d: str) -> DataFrame:
    """Rings from each tile to the nearest seam tile of its zoom, null beyond three; and as a histogram (A-28)."""
    t = _tile_set(spark, d, "true").select("z", "x", "y")
    return tiles.seam_histogram(C.seam_distance(t, t.where("x % 11 = 0"), 3), 3)


def x21_owned(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that cells own against the tiles there are: missing, foreign and owned twice."""
    every = _tile_set(spark, d, "true").select("z", "x", "y")
    owned = every.where("(x + y) % 50 <> 0").unionByName(every.where("x % 40 = 0")).unionByName(every.where("y % 60 = 0").withColumn("x", F.col("x") + 100000))
    counted = owned.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    j = every.withColumn("e", F.lit(1)).join(counted, ["z", "x", "y"], "full_outer")
    return j.select(F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "foreign").when(F.col("n") > 1, "twice").alias("problem")).where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def x22_quads_of_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Quads whose bounds meet any tile of zoom 10 that holds a place: a tile's box is written into the quads it touches."""
    t = _tile_set(spark, d, "true").where("z = 10").select("x", "y")
    west, south, east, north = geo.tile_bounds(F.lit(10.0), F.col("x"), F.col("y"))
    w, s = geo.mercator_inverse(west, south)
    e, n = geo.mercator_inverse(east, north)
    boxed = t.select(w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"))
    q = boxed.select(F.explode(F.sequence(F.floor(F.col("w") / 0.125 + 1e-9), F.ceil(F.col("e") / 0.125 - 1e-9) - 1)).alias("col"), "s", "n").withColumn("row", F.explode(F.sequence(F.floor(F.col("s") / 0.125 + 1e-9), F.ceil(F.col("n") / 0.125 - 1e-9) - 1)))
    quads = j13_quads(spark, d)
    return quads.join(q.select((F.col("row") * 10000 + F.col("col")).alias("quad")).distinct(), "quad", "left_semi").select("quad")


def x20_spread(spark: SparkSession, d: str) -> DataFrame:
    """Forty keys spread evenly over the sorted list: of every fortieth part the first. Sampling is the feature."""
    keys = current_places(spark, d).select("poi_key")
    n = keys.count()
    ranked = keys.withColumn("at", F.row_number().over(Window.partitionBy(F.substring("poi_key", 1, 2)).orderBy("poi_key")))
    before = keys.groupBy(F.substring("poi_key", 1, 2).alias("stem")).agg(F.count(F.lit(1)).alias("c"))  # 256 stems of a hash
    before = before.select("stem", (F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("stem")) - F.col("c")).alias("before"))
    i = F.col("at") - 1 + F.col("before")
    placed = ranked.withColumn("stem", F.substring("poi_key", 1, 2)).join(F.broadcast(before), "stem").select("poi_key", i.alias("i"))
    return placed.where(F.col("i") == F.ceil(F.floor(F.col("i") * 40 / n) * n / 40)).select("poi_key", F.col("i"))


def _trail_lines(spark: SparkSession, d: str) -> DataFrame:
    pts = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    return line_queries._vertices(spark, d).groupBy("line").agg(F.transform(pts, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))  # at most fifty vertices a line


def snk02_lines(spark: SparkSession, d: str) -> DataFrame:
    """Trail lines as text and back: corners and length survive."""
    back = _trail_lines(spark, d).select("line", C.from_wkt(C.wkt(F.col("points"))).alias("p"))
    steps = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
    return back.select("line", F.size("p").cast("long").alias("corners"), F.round(F.aggregate(steps, F.lit(0.0), lambda a, v: a + v), 4).alias("length"))


def snk03_overview(spark: SparkSession, d: str) -> DataFrame:
    """The overview: all lines simplified to a tolerance of 100 and rounded to four places, as the parts of one multi-line; here by part, as one row would grow with the table."""
    kept = L.simplified(line_queries._vertices(spark, d), "line", "seq", "x", "y", 100.0)
    v = line_queries._vertices(spark, d).join(kept, ["line", "seq"], "left_semi")
    return v.groupBy("line").agg(F.count(F.lit(1)).alias("corners"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")))), lambda p: F.concat_ws(" ", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"))), ",").alias("part"))


def _shards(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "poi_snapshots").where("load_no >= 6").select((8 - F.col("load_no")).alias("shard"), "poi_key", "loaded_at")
    return s.groupBy("shard", "poi_key").agg(F.max("loaded_at").alias("stamp"))


def a29_merged_shards(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of several shards in one; the first shard wins, and keys in more than one are marked."""
    return _shards(spark, d).groupBy("poi_key").agg(F.min_by("stamp", "shard").alias("stamp"), (F.count(F.lit(1)) > 1).alias("shared"))


def s07_attributed(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose merged stamp differs from the control load, split into those in the overlap and the others."""
    control = table(spark, d, "poi_snapshots").where("load_no = 7").groupBy("poi_key").agg(F.max("loaded_at").alias("was"))
    return a29_merged_shards(spark, d).join(control, "poi_key").where("stamp <> was").groupBy("shared").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (j03_clipped_lines, j12_fine_cells, j13_quads, j29_quads_of_cells, a03_corridor, a04_chains, a12_band_miles, a14_overlaps, a23_merged_trails, a27_shared, a29_merged_shards, r02_export_tiles, r05_stretches, r06_miles, r08_cells, r09_dem_cells, s07_attributed, snk02_lines, snk03_overview, snk08_package, w25_placed_parts, w39_oriented, x20_spread, x21_owned, x22_quads_of_tiles, x23_spans, x24_seam)}

_N = "n as (select distinct * from field_notes)"
_C = "c as (select distinct * from closures)"
_LINE = f"{_N}, cl as (select floor(mile * 2)::bigint as seq, floor(mile * 2)::bigint // 200 as part, arg_min(lat, id) as lat, arg_min(lon, id) as lon, arg_min(mile, id) as mile from n where mile is not null and lat is not null and lon is not null group by 1, 2)"
_SEGS = f"{_LINE}, sg as (select * from (select part, seq, lon as ax, lat as ay, lead(lon) over w as bx, lead(lat) over w as byy from cl window w as (partition by part order by seq)) where bx is not null)"
_U = warehouse._P
_XY = f"pl as (select part, seq, ax * {EAST_M!r} as ax, ay * {NORTH_M!r} as ay, bx * {EAST_M!r} as bx, byy * {NORTH_M!r} as byy from sg)"


def _foot(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    span = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    t = f"(case when {span} > 0 then greatest(0.0, least(1.0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {span})) else 0.0 end)"
    return f"sqrt(power({px} - {ax} - {t} * ({bx} - {ax}), 2) + power({py} - {ay} - {t} * ({by} - {ay}), 2))"


def _cross(a: str, b: str, c: str, e: str) -> str:
    side = lambda p, q, r: f"sign(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
    return f"({side(a, b, c)} <> {side(a, b, e)} and {side(c, e, a)} <> {side(c, e, b)})"


def _in_box(w: str, s: str, e: str, n: str) -> str:
    """A segment meets a box: an end lies inside or it crosses a diagonal."""
    line = lambda x0, y0, x1, y1: f"(sign((bx - ax) * ({y0} - ay) - (byy - ay) * ({x0} - ax)) <> sign((bx - ax) * ({y1} - ay) - (byy - ay) * ({x1} - ax)) and sign(({x1} - {x0}) * (ay - {y0}) - ({y1} - {y0}) * (ax - {x0})) <> sign(({x1} - {x0}) * (byy - {y0}) - ({y1} - {y0}) * (bx - {x0})))"
    return f"((ax between {w} and {e} and ay between {s} and {n}) or (bx between {w} and {e} and byy between {s} and {n}) or {line(w, s, e, n)} or {line(w, n, e, s)})"


def _cells(side: float, m: float) -> str:
    w, s = f"cx * {side}", f"cy * {side}"
    return f"""(select distinct cx as col, cy as row from (select *, unnest(range(cast(floor((least(ay, byy) - {m}) / {side}) as bigint), cast(floor((greatest(ay, byy) + {m}) / {side}) as bigint) + 1)) as cy from
(select *, unnest(range(cast(floor((least(ax, bx) - {m}) / {side}) as bigint), cast(floor((greatest(ax, bx) + {m}) / {side}) as bigint) + 1)) as cx from sg)) where {_in_box(f"({w} - {m})", f"({s} - {m})", f"({w} + {side} + {m})", f"({s} + {side} + {m})")})"""


_QUADS = f"qd as (select row * 10000 + col as quad, col * 0.125 as west, row * 0.125 as south from {_cells(0.125, 0.05)})"
_BANDS = "bn as (select x.v as cx, y.v as cy, (floor(x.v / 2)::bigint + floor(y.v / 2)::bigint * 2) % 4 as l0 from (select unnest(range(-86, -65, 2)) as v) x, (select unnest(range(33, 49, 2)) as v) y), bands as (select cx, cy, case when l0 < 0 then l0 + 4 else l0 end as level from bn)"
_NET = "net as (select p_partkey * 2 as seg, p_partkey as a, p_partkey + 1 as b, p_partkey // 40 as blaze, p_partkey % 3 as name from part where p_partkey % 17 <> 0 union all select p_partkey * 2 + 1, p_partkey, -p_partkey, p_partkey // 40, p_partkey % 3 from part where p_partkey % 29 = 0), nd as (select node, count(*) as n, min(seg) as s0, max(seg) as s1, min(blaze) = max(blaze) as same from (select seg, blaze, unnest([a, b]) as node from net) group by 1)"


def _chained(also: str) -> str:
    return f"""{_NET}, lk as (select s0, s1 from nd where n = 2 and s0 <> s1 {also}), ed as (select s0 as x, s1 as y from lk union select s1, s0 from lk), rc(v, w) as (select seg, seg from net union select rc.v, ed.y from rc join ed on rc.w = ed.x), ch as (select v as seg, min(w) as chain from rc group by 1)"""


_TX = "cast(floor((longitude + 180) / 360 * {0}) as integer)"
_TY = "cast(floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * {0}) as integer)"


def _tiles_sql(where: str) -> str:
    return "(" + " union all ".join(f"select {z} as z, {_TX.format(2**z)} as x, {_TY.format(2**z)} as y, count(*) * 100 as bytes from u where {where} group by 1, 2, 3" for z in (8, 9, 10)) + ")"


def _export_sql() -> str:
    parts = []
    for z in range(5, 12):
        m, k = (0.5, 2**z) if z < 9 else (0.05, 2**z)
        tx = lambda e: f"cast(floor((({e}) + 180) / 360 * {k}) as integer)"  # noqa: B023, E731
        ty = lambda e: f"cast(floor((1 - ln(tan(radians({e})) + 1 / cos(radians({e}))) / pi()) / 2 * {k}) as integer)"  # noqa: B023, E731
        parts.append(f"select {z} as z, x, unnest(generate_series({ty(f'lat + {m}')}, {ty(f'lat - {m}')})) as y from (select lat, unnest(generate_series({tx(f'lon - {m}')}, {tx(f'lon + {m}')})) as x from cl)")
    return " union ".join(parts)


_STRETCH = f"{_C}, sm as (select id, start_mile_marker + (end_mile_marker - start_mile_marker) * i / 4 as m from c, (select unnest(range(0, 5)) as i) where start_mile_marker is not null and end_mile_marker is not null), st as (select distinct id, unnest(generate_series(greatest(cast(floor((m - 2) / 50) as bigint), 0), least(cast(floor((m + 2) / 50) as bigint), 43))) as stretch from sm)"
_SHARDS = "sh as (select 8 - load_no as shard, poi_key, max(loaded_at) as stamp from poi_snapshots where load_no >= 6 group by 1, 2), mg as (select poi_key, arg_min(stamp, shard) as stamp, count(*) > 1 as shared from sh group by 1)"
_LON = "(({0}) / 1024.0 * 360 - 180)"
_LAT = "degrees(atan(sinh(pi() * (1 - 2 * ({0}) / 1024.0))))"
_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(power(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin((radians({3}) - radians({1})) / 2), 2))))"

SQL = {
    "j03_clipped_lines": f"""with {_SEGS}, {_XY}, {_C}, o as (select id, start_lon * {EAST_M!r} as px, start_lat * {NORTH_M!r} as py, end_lon * {EAST_M!r} as qx, end_lat * {NORTH_M!r} as qy from c where start_lat is not null and start_lon is not null and end_lat is not null and end_lon is not null)
select distinct id from o, (select ax, ay, bx, byy as by_ from pl) where {_cross("p", "q", "a", "b").replace("by ", "by_ ").replace("by)", "by_)")} or least({_foot("px", "py", "ax", "ay", "bx", "by_")}, {_foot("qx", "qy", "ax", "ay", "bx", "by_")}, {_foot("ax", "ay", "px", "py", "qx", "qy")}, {_foot("bx", "by_", "px", "py", "qx", "qy")}) <= 1000""",
    "a03_corridor": f"""with {_SEGS}, {_XY}, {_U}, o as (select poi_key, source, longitude * {EAST_M!r} as px, latitude * {NORTH_M!r} as py from u), k as (select distinct o.poi_key, o.source from o join pl on py between least(ay, byy) - 5000 and greatest(ay, byy) + 5000 where {_foot("px", "py", "ax", "ay", "bx", "byy")} <= 5000) select source, count(*) as n from k group by 1""",
    "r08_cells": f"with {_SEGS} select * from {_cells(1.0, 0.25)}",
    "j12_fine_cells": f"with {_SEGS} select * from {_cells(0.1, 0.0)}",
    "j13_quads": f"with {_SEGS}, {_QUADS} select * from qd",
    "j29_quads_of_cells": f"with {_SEGS}, {_QUADS}, ce as (select * from {_cells(1.0, 0.25)}) select col, row, count(*) as quads from ce join qd on west < col + 1.01 and west + 0.125 > col - 0.01 and south < row + 1.01 and south + 0.125 > row - 0.01 group by 1, 2",
    "a12_band_miles": f"""with {_SEGS}, {_BANDS}, f as (select part, seq, level, cx, cy, s1 * (ax - cx) + s2 * (ay - cy) - 1.2 as f0, s1 * (bx - ax) + s2 * (byy - ay) as df from sg, bands, (values (1, 1), (1, -1), (-1, 1), (-1, -1)) q(s1, s2)),
t as (select part, seq, level, max(case when df < 0 then -f0 / df else 0 end) as lo, min(case when df > 0 then -f0 / df else 1 end) as hi, max(case when df = 0 and f0 > 0 then 1 else 0 end) as gone from f group by part, seq, level, cx, cy),
i as (select part, seq, level, greatest(lo, 0) as a, least(hi, 1) as b from t where gone = 0 and greatest(lo, 0) < least(hi, 1)), j as (select *, max(b) over (partition by part, seq, level order by a, b rows between unbounded preceding and 1 preceding) as r from i)
select level, round(sum(greatest(b - greatest(a, coalesce(r, 0)), 0) * {_HAV.format("ay", "ax", "byy", "bx")} / 1609.344), 3) as miles from j join sg using (part, seq) group by 1""",
    "a14_overlaps": f"""with {_BANDS}, p as (select a.cx, a.cy, b.cx as o_cx, b.cy as o_cy, greatest(0, sqrt(2.0) * 1.2 - abs(a.cx - b.cx + a.cy - b.cy) / sqrt(2.0)) * greatest(0, sqrt(2.0) * 1.2 - abs(a.cx - b.cx - a.cy + b.cy) / sqrt(2.0)) as area from bands a join bands b on (a.cx, a.cy) < (b.cx, b.cy) and a.level <> b.level)
select cx, cy, o_cx, o_cy, round(area, 6) as area from p where round(area, 6) > 0.000001""",
    "a04_chains": f"with recursive {_chained('')} select chain, count(*) as n from ch group by 1",
    "a23_merged_trails": f"with recursive {_chained('and same')} select chain, blaze, case when min(nm) = max(nm) then max(nm) end as name, count(*) as n from (select *, case when blaze % 2 = 0 then 7 else name end as nm from net) join ch using (seg) group by 1, 2",
    "w39_oriented": f"""with {line_queries._V}, e as (select line, arg_min(x, seq) * 0.6 - arg_min(y, seq) * 0.8 as a, arg_max(x, seq) * 0.6 - arg_max(y, seq) * 0.8 as b from v group by 1), s as (select line, line // 100 as sheet, b < a as turned, round(least(a, b), 6) as "start" from e) select *, row_number() over (partition by sheet order by "start", line) as place from s""",
    "w25_placed_parts": f"""with {_LINE}, mk as (select * from cl where part % 3 <> 2), f as (select part, arg_min(lat, seq) as la, arg_min(lon, seq) as lo, min(mile) as m from cl group by 1), x as (select f.part, arg_min(mk.mile, ({_HAV.format("la", "lo", "mk.lat", "mk.lon")}, mk.seq)) as anchor from f join mk on f.part % 3 = 2 and {_HAV.format("la", "lo", "mk.lat", "mk.lon")} <= 80000 group by 1)
select f.part, case when f.part % 3 <> 2 then (select min(mile) from mk where mk.part = f.part) else anchor end as "start", f.part % 3 = 2 as anchored from f left join x on x.part = f.part""",
    "r02_export_tiles": f"with {_LINE}, tl as ({_export_sql()}) select z, count(*) as n from tl group by 1",
    "r05_stretches": f"with {_STRETCH} select * from st",
    "x23_spans": f"""with {_STRETCH} select distinct stretch, stretch * 50.0::double as "start", least(stretch * 50.0 + 50, 2190.0)::double as "end" from st""",
    "r06_miles": f"""with {_LINE}, {_U}, j as (select poi_key, mile, row_number() over (partition by poi_key order by {_HAV.format("latitude", "longitude", "lat", "lon")}, seq) as rn from u join cl on abs(latitude - lat) < 0.046 where {_HAV.format("latitude", "longitude", "lat", "lon")} <= 5000) select poi_key, round(mile, 3) as mile from j where rn = 1""",
    "r09_dem_cells": f"with {_C}, k as (select unnest(generate_series(cast(floor(start_lat - 0.5) as bigint), cast(floor(start_lat + 0.5) as bigint))) as s, start_lon from c where start_lat is not null and start_lon is not null), l as (select s, unnest(generate_series(cast(floor(start_lon - 0.5) as bigint), cast(floor(start_lon + 0.5) as bigint))) as w from k) select printf('n%02dw%03d', s + 1, -w) as cell, count(*) as n from l group by 1",
    "a27_shared": f"with {_U}, a as {_tiles_sql('latitude < 41')}, b as {_tiles_sql('latitude >= 40')} select a.z, count(*) as tiles, cast(sum(a.bytes) as bigint) as bytes, count(b.z) as shared, cast(coalesce(sum(case when b.z is not null then a.bytes end), 0) as bigint) as shared_bytes from a left join b using (z, x, y) group by 1",
    "snk08_package": f"with {_U}, a as {_tiles_sql('true')}, b as {_tiles_sql('latitude between 39 and 41')} select z, count(*) as tiles, cast(sum(bytes) as bigint) as bytes from a where z <= 8 or (z, x, y) in (select (z, x, y) from b) group by 1",
    "x24_seam": f"with {_U}, t as {_tiles_sql('true')}, s as (select * from t where x % 11 = 0), k as (select t.z, t.x, t.y, min(greatest(abs(t.x - s.x), abs(t.y - s.y))) as g from t left join s on t.z = s.z and abs(t.x - s.x) <= 3 and abs(t.y - s.y) <= 3 group by 1, 2, 3) select cast(g as integer) as distance, count(*) as n from k group by 1",
    "x21_owned": f"""with {_U}, t as {_tiles_sql('true')}, o as (select z, x, y, count(*) as n from (select z, x, y from t where (x + y) % 50 <> 0 union all select z, x, y from t where x % 40 = 0 union all select z, x + 100000, y from t where y % 60 = 0) group by 1, 2, 3)
select * from (select case when o.n is null then 'missing' when t.bytes is null then 'foreign' when o.n > 1 then 'twice' end as problem, count(*) as n from t full outer join o using (z, x, y) group by 1) where problem is not null""",
    "x22_quads_of_tiles": f"""with {_SEGS}, {_QUADS}, {_U}, t as (select {_LON.format("x")} as w, {_LON.format("x + 1")} as e, {_LAT.format("y + 1")} as s, {_LAT.format("y")} as n from {_tiles_sql('true')} where z = 10) select distinct quad from qd join t on west < e - 1e-10 and west + 0.125 > w + 1e-10 and south < n - 1e-10 and south + 0.125 > s + 1e-10""",
    "x20_spread": f"with k as (select distinct poi_key from dim_pois), r as (select poi_key, row_number() over (order by poi_key) - 1 as i, count(*) over () as n from k) select poi_key, i from r where i = ceil(floor(i * 40 / n) * n / 40)",
    "snk02_lines": f"with {line_queries._V}, s as (select *, lag(x) over w as px, lag(y) over w as py from v window w as (partition by line order by seq)) select line, count(*) as corners, round(coalesce(sum(sqrt(power(x - px, 2) + power(y - py, 2))), 0), 4) as length from s group by 1",
    "snk03_overview": f"""with recursive {line_queries._V}, {line_queries._FARTHEST.format(tol=100)}, k as (select * from v where (line, seq) in (select (line, i) from fa union select (line, j) from fa)) select line, count(*) as corners, string_agg(x::bigint || ' ' || y::bigint, ',' order by seq) as part from k group by 1""",
    "a29_merged_shards": f"with {_SHARDS} select * from mg",
    "s07_attributed": f"with {_SHARDS}, k as (select poi_key, max(loaded_at) as was from poi_snapshots where load_no = 7 group by 1) select shared, count(*) as n from mg join k using (poi_key) where stamp <> was group by 1",
}
