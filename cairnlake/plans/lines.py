"""Queries over lines, tiles, day plans and streams. Lines are made from key arithmetic, alike in both engines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.plain import usable_position
from ..operators import lines as L
from ..operators import nearby, planning, tiles
from ..session import cut, own_folder, table
from ..sources import geojson
from ..streaming import walks
from . import trail
from .places import current_places


def _vertices(spark: SparkSession, d: str, by_line: bool = False) -> DataFrame:
    """Lines of up to fifty vertices from orders: x runs on, y wanders. ``by_line`` brings lines together as bare keys, a quarter of what vertices take."""
    k = F.col("o_orderkey")
    keys = table(spark, d, "orders").select(k)
    return (keys.repartition(F.floor(k / 50)) if by_line else keys).select((F.floor(k / 50)).alias("line"), (k % 50).alias("seq"), ((k % 50) * 10).cast("double").alias("x"), (F.floor(k / 50) * 40 % 1000 + k * 7919 % 23).cast("double").alias("y"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("point"), (k * 7919 % 4900 / 10.0).alias("px"), (k * 104729 % 10000 / 10.0).alias("py"))


def j17_nearest_segment(spark: SparkSession, d: str) -> DataFrame:
    segs = L.segments(_vertices(spark, d, by_line=True), "line", "seq", "x", "y")
    best = L.nearest_segment(_points(spark, d), segs, "point", "px", "py", "line", 30.0)
    return best.select("point", F.round("distance", 4).alias("distance"))


def j08_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Where the line segments cross a family of upright segments, by grid column."""
    segs = L.segments(_vertices(spark, d), "line", "seq", "x", "y")
    posts = spark.range(0, 49).select(F.col("id").alias("post"), (F.col("id") * 10 + 5).cast("double").alias("cx"), F.lit(0.0).alias("cy"), (F.col("id") * 10 + 5).cast("double").alias("dx"), F.lit(500.0).alias("dy"))
    keyed = segs.withColumn("cell", F.floor(F.least("ax", "bx") / 10))
    on = keyed.join(posts.withColumn("cell", F.col("post")), "cell")
    hit, x, y = geo.segments_cross(*[F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")])
    return on.where(hit).select("line", "seg", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def w26_resampled(spark: SparkSession, d: str) -> DataFrame:
    """A point every 25 along all lines laid end to end."""
    lengths = table(spark, d, "part").select(F.col("p_partkey").alias("line"), F.col("p_size").cast("double").alias("length"))
    return L.resampled(lengths, "line", "length", 25.0)


def w24_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Markers of each order made monotone, turned about where miles fall along the line."""
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").cast("double").alias("along"), F.round("l_quantity", 2).alias("mile"))
    m = m.groupBy("line", "along").agg(F.max("mile").alias("mile"))
    return L.calibrated(m, "line", "along", "mile").groupBy("reversed").agg(F.count(F.lit(1)).alias("n"))


def j33_miles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest line of each point, then its mile between that line's markers."""
    v = _vertices(spark, d)
    segs = L.segments(_vertices(spark, d, by_line=True), "line", "seq", "x", "y")
    best = L.nearest_segment(_points(spark, d), segs, "point", "px", "py", "line", 30.0)
    marks = v.where("seq % 10 = 0").select("line", (F.col("seq") * 10).cast("double").alias("along"), (F.col("seq") * 10 / 100.0 + F.col("line") * 5).alias("mile"))
    known = L.knots(marks, "line", "along", "mile")
    return best.join(known, "line").select("point", F.round(L.mile_at(F.col("knots"), F.col("along")), 3).alias("mile"))


def a24_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Held-out error of a calibration: every other marker fits, the rest are scored."""
    m = _vertices(spark, d).where("seq % 5 = 0").select("line", F.col("x").alias("along"), (F.col("x") / 100 + F.col("y") / 1000).alias("mile"))
    w = Window.partitionBy("line").orderBy("along")
    m = m.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("line"))).where("_all >= 4")
    fit = L.knots(m.where("_n % 2 = 1"), "line", "along", "mile")
    scored = m.where("_n % 2 = 0").join(fit, "line").select(F.abs(L.mile_at(F.col("knots"), F.col("along"), 100.0) - F.col("mile")).alias("e"))
    return scored.agg(F.round(F.percentile("e", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("e", F.lit(0.95)), 6).alias("p95"), F.round(F.max("e"), 6).alias("worst"))


def g12_simplified(spark: SparkSession, d: str) -> DataFrame:
    return L.simplified(_vertices(spark, d), "line", "seq", "x", "y", 6.0)


def w35_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Greedy clusters of water within 50 m, surveyed sources first, replayed in blocks of linked records."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")) & (F.col("known_type") == "water"))
    pairs = cut(nearby.pairs_within(p, p, "poi_key", "poi_key", "latitude", "longitude", 60.0).select("id_l", "id_r"))
    block = L.linked_blocks(pairs, "id_l", "id_r").select(F.col("key").alias("poi_key"), F.col("block").alias("near"))
    rows = p.join(block, "poi_key").withColumn("rank", F.when(F.col("source") == "osm_water", 1).otherwise(0))
    return L.greedy_clusters(rows, "near", "poi_key", "rank", "latitude", "longitude", 50.0)


def w35_folded(spark: SparkSession, d: str) -> DataFrame:
    """The same clusters with the facts of their members folded into the head: sources, the first name in order, how many there are."""
    p = cut(current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")) & (F.col("known_type") == "water")).select("poi_key", "source", "name"))
    m = w35_clusters(spark, d).join(p, "poi_key")
    own = F.when(F.col("name").isNotNull(), F.struct((F.col("source") == "osm_water").cast("int"), "poi_key"))
    return m.groupBy("head").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min_by("name", own).alias("name"), F.count(F.lit(1)).alias("n"))


def g02_projected(spark: SparkSession, d: str) -> DataFrame:
    """Positions in the conic and the Mercator projection, in decimetres, and whether both lead back to a millionth of a degree."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    x, y = geo.albers(F.col("longitude"), F.col("latitude"))
    u, v = geo.mercator(F.col("longitude"), F.col("latitude"))
    rows = p.select("poi_key", "longitude", "latitude", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))
    bx, by = geo.albers_inverse(F.col("x"), F.col("y"))
    mx, my = geo.mercator_inverse(F.col("u"), F.col("v"))
    worst = F.greatest(F.abs(bx - F.col("longitude")), F.abs(by - F.col("latitude")), F.abs(mx - F.col("longitude")), F.abs(my - F.col("latitude")))
    return rows.select("poi_key", *[F.round(c, 1).alias(c) for c in ("x", "y", "u", "v")], (worst < 1e-6).alias("exact"))


def g07_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area of a ring of each line: its vertices up and the axis back."""
    v = _vertices(spark, d)
    ring = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    r = v.groupBy("line").agg(F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return r.select("line", F.round(geo.shoelace(F.col("ring")), 3).alias("area"))


def g13_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Places by tile of zoom 8."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    x, y = tiles.tile_of(F.col("longitude"), F.col("latitude"), F.lit(8.0))
    return p.select(x.alias("x"), y.alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def r01_tile_cover(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of zoom 10 that a half-degree box around each closure touches."""
    c = table(spark, d, "closures").dropDuplicates(["id"]).where("start_lat is not null and start_lon is not null").select("id", "start_lat", "start_lon")
    lon, lat = F.col("start_lon"), F.col("start_lat")
    return tiles.tiles_of_bounds(c, lon - 0.25, lat - 0.25, lon + 0.25, lat + 0.25, 10).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def r04_owners(spark: SparkSession, d: str) -> DataFrame:
    cells = spark.range(0, 40).select(F.col("id").alias("cell"), (F.col("id") % 8 * 2 - 84).cast("double").alias("west"), (F.floor(F.col("id") / 8) * 2 + 35).cast("double").alias("south"))
    cells = cells.withColumns({"east": F.col("west") + 2, "north": F.col("south") + 2})
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude"))).select("poi_key", "longitude", "latitude")
    return tiles.owners(p, cells, ["poi_key"], "longitude", "latitude")


def r07_floored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tiles.floored_blue(F.col("p_partkey") % 256, 16).alias("blue"))


def src14_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Point samples from a raster table: the first covering tile with a number."""
    k = F.col("p_partkey")
    raster = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).alias("tile_id"), (F.col("l_linenumber") % 8).cast("long").alias("row"), (F.col("l_suppkey") % 8).alias("col"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity")).alias("value"))
    raster = raster.groupBy("tile_id", "row", "col").agg(F.max("value").alias("value"))
    base = table(spark, d, "part").select(k.alias("point"), (k % 8).alias("row"), (F.floor(k / 8) % 8).alias("col"))
    wanted = base.withColumn("rank", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("tile_id", (F.col("point") + F.col("rank") * 3) % 10)
    return tiles.sampled(wanted, raster, "point")


def dp1_days(spark: SparkSession, d: str) -> DataFrame:
    stops = table(spark, d, "part").select((F.col("p_partkey") % 20).alias("hike"), (F.floor(F.col("p_partkey") / 20) * 5 + F.col("p_size") % 5).cast("double").alias("mile"), (F.col("p_size") % 2 == 0).alias("camp"))
    stops = stops.groupBy("hike", "mile").agg(F.max("camp").alias("camp"))
    return planning.planned_days(stops, "hike", "mile", "camp", 14.0)


def dp2_exact(spark: SparkSession, d: str) -> DataFrame:
    """Twenty days for each hike; all parts lie along one trail, cut by key into hikes of equal length with at most fifty stops."""
    k, part = F.col("p_partkey"), table(spark, d, "part")
    keys = part.agg((F.max("p_partkey") + 1).alias("n")).select("n", F.ceil(F.col("n") / 50).alias("hikes"))
    hike = F.expr("p_partkey * hikes div n")
    stops = part.crossJoin(F.broadcast(keys)).select(hike.alias("hike"), (k * 5 + F.col("p_size") % 5).cast("double").alias("mile"), (F.col("p_size") % 2 == 0).alias("camp"))
    return planning.planned_days(stops.groupBy("hike", "mile").agg(F.max("camp").alias("camp")), "hike", "mile", "camp", 0.0, days=20)


def dp7_rests(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select("user_id", "event_id", (F.col("value") >= 10).alias("walked"))
    return planning.with_rests(days, "user_id", "event_id", "walked", 7).select("event_id", "rest_after", F.col("shift").cast("long").alias("shift"))


def dp8_slots(spark: SparkSession, d: str) -> DataFrame:
    pts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 300).cast("double").alias("mile")).groupBy("route", "seq").agg(F.max("mile").alias("mile"))
    return planning.cheapest_slot(pts.withColumn("new", (F.col("route") % 300).cast("double")), "route", "seq", "mile", "new")


def snk01_features(spark: SparkSession, d: str) -> DataFrame:
    """Features as JSON text, read back: id and position survive."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    text = p.select(geojson.feature(F.col("longitude"), F.col("latitude"), F.struct("poi_key", "known_type")).alias("value"))
    f = text.select(F.from_json("value", "properties struct<poi_key: string, known_type: string>, geometry struct<coordinates: array<double>>").alias("f"))
    return f.select("f.properties.poi_key", "f.properties.known_type", F.get("f.geometry.coordinates", F.lit(0)).alias("longitude"), F.get("f.geometry.coordinates", F.lit(1)).alias("latitude"))


def st_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type as a stream with a watermark, run to the end; of a window the newest count holds."""
    s = walks.windowed_counts(walks.read_stream(spark, f"{d}/events.parquet"), "ts", "event_type", "1 day", "1 hour")
    return walks.run_to_table(s, own_folder(spark, "stream"), ["start", "event_type"]).select(F.to_date("start").alias("day"), "event_type", "n")


def st08_once(spark: SparkSession, d: str) -> DataFrame:
    """Resent notes once, as a stream; by reporter type."""
    s = walks.first_seen(walks.read_stream(spark, f"{d}/field_notes.parquet", 100), "id", "posted_at", "3650 days")
    return walks.run_to_table(s, own_folder(spark, "stream")).groupBy("reporter_type").agg(F.count(F.lit(1)).alias("n"))


def st02_stream(spark: SparkSession, d: str) -> DataFrame:
    """Direction with hysteresis as keyed state; equal to the batch fold."""
    s = walks.directions(walks.read_stream(spark, f"{d}/events.parquet", 1000), "user_id", "ts", "value", 40.0)
    return walks.run_to_table(s, own_folder(spark, "stream"), ["user_id"])


def st01_stream(spark: SparkSession, d: str) -> DataFrame:
    e = walks.read_stream(spark, f"{d}/events.parquet", 1000).withColumn("off", F.col("value") > 20)
    out = walks.run_to_table(walks.alerts(e, "user_id", "ts", "off", 12 * 3600.0, 25 * 3600.0), own_folder(spark, "stream"))
    return out.groupBy("alert").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (j08_crossings, j17_nearest_segment, j33_miles, a24_held_out, w24_calibrated, w26_resampled, w35_clusters, w35_folded, g02_projected, g07_areas, g12_simplified, g13_tiles, r01_tile_cover, r04_owners, r07_floored, src14_sampled, dp1_days, dp2_exact, dp7_rests, dp8_slots, snk01_features, st_windows, st08_once, st01_stream, st02_stream)}

_V = "v as (select * from (select o_orderkey // 50 as line, o_orderkey % 50 as seq, (o_orderkey % 50 * 10)::double as x, (o_orderkey // 50 * 40 % 1000 + o_orderkey * 7919 % 23)::double as y from orders))"
_SEG = f"{_V}, s as (select * from (select line, seq as seg, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from v window w as (partition by line order by seq)) where x1 is not null)"
_PTS = "p as (select p_partkey as point, p_partkey * 7919 % 4900 / 10.0::double as px, p_partkey * 104729 % 10000 / 10.0::double as py from part)"
_FOOT = "case when power(x1 - x0, 2) + power(y1 - y0, 2) > 0 then greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (power(x1 - x0, 2) + power(y1 - y0, 2)))) else 0 end"
_NEAR = f"""{_SEG}, {_PTS}, c as (select point, line, seg, sum_len, x0, y0, t * (x1 - x0) as ox, t * (y1 - y0) as oy, sqrt(power(px - x0 - t * (x1 - x0), 2) + power(py - y0 - t * (y1 - y0), 2)) as d from (
  select *, {_FOOT} as t from p join (select *, coalesce(sum(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2))) over (partition by line order by seg rows between unbounded preceding and 1 preceding), 0) as sum_len from s) s on s.x0 - 31 <= px and s.x1 + 31 >= px)),
near as (select point, line, d, sum_len + sqrt(ox * ox + oy * oy) as along from (select *, row_number() over (partition by point order by d, line, seg) as rn from c where d <= 30) where rn = 1)"""
_P = """u as (select * from (select poi_key, longitude, latitude, case when lower(trim(poi_type)) in ('shelter', 'campsite', 'water', 'resupply', 'crossing', 'viewpoint', 'parking', 'privy') then lower(trim(poi_type)) end as known_type, row_number() over (partition by poi_key order by loaded_at desc) as rn from dim_pois) where rn = 1 and latitude between 33 and 48 and longitude between -86 and -66)"""
_TILE = "cast(floor((({lon}) + 180) / 360 * {n}) as integer) as x, cast(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * {n}) as integer) as y"
_TX = "cast(floor(({0} + 180) / 360 * 1024) as integer)"
_TY = "cast(floor((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * 1024) as integer)"

#: The conic's figures again, from their definition, for the SQL twin.
_ECC = math.sqrt(2 / 298.257222101 - 1 / 298.257222101**2)
_Q = f"((1 - {_ECC**2!r}) * ({{0}} / (1 - {_ECC**2!r} * {{0}} * {{0}}) - ln((1 - {_ECC!r} * {{0}}) / (1 + {_ECC!r} * {{0}})) / (2 * {_ECC!r})))"


def _q(lat: float) -> float:
    s = math.sin(math.radians(lat))
    return (1 - _ECC**2) * (s / (1 - _ECC**2 * s * s) - math.log((1 - _ECC * s) / (1 + _ECC * s)) / (2 * _ECC))


def _m(lat: float) -> float:
    s = math.sin(math.radians(lat))
    return math.cos(math.radians(lat)) / math.sqrt(1 - _ECC**2 * s * s)


_CONE_N = (_m(29.5) ** 2 - _m(45.5) ** 2) / (_q(45.5) - _q(29.5))
_CONE_C = _m(29.5) ** 2 + _CONE_N * _q(29.5)
_Q0 = repr(_q(23.0))
_RHO = f"(6378137.0 * sqrt({_CONE_C!r} - {_CONE_N!r} * {{0}}) / {_CONE_N!r})"

_PRICE = "(case when abs(m[j + 1] - m[i]) > {t} then 2.25 else 1.0 end * power(abs(m[j + 1] - m[i]) - {t}, 2) + case when c[j + 1] then power(0.02 * {t}, 2) else 0 end)"
_REACH = "case when len(list_filter(range(1, j + 1), lambda i: abs(m[j + 1] - m[i]) <= 25)) > 0 then list_filter(range(1, j + 1), lambda i: abs(m[j + 1] - m[i]) <= 25) else [j] end"
_HIKES = "h as (select hike, list(mile order by mile) as m, list(camp order by mile) as c, count(*) as n from st group by 1)"
#: The cheapest way to every stop, one stop a step, and the way back from the last one.
_PLAN = _HIKES + """, sv(hike, m, c, n, j, cost, back) as (select hike, m, c, n, 1::bigint, [0.0::double], [0::bigint] from h union all
select hike, m, c, n, j + 1, list_append(cost, b.k), list_append(back, b.i) from (select *, list_sort(list_transform(""" + _REACH + ", lambda i: {{'k': cost[i] + " + _PRICE.format(t="{target}") + """, 'i': i}}))[1] as b from sv where j < n)),
wy(hike, m, back, at_, k) as (select hike, m, back, n, 0 from sv where j = n union all select hike, m, back, back[at_], k + 1 from wy where at_ > 1)"""
_EXACT = _HIKES + """, sv(hike, m, c, n, j, t, cost, back) as (select hike, m, c, n, 1::bigint, (m[n] - m[1]) / 20, [list_concat([0.0::double], list_transform(range(20), lambda x: null::double))], [list_transform(range(20), lambda x: 0::bigint)] from h where n > 20 union all
select hike, m, c, n, j + 1, t, list_append(cost, list_concat([null::double], list_transform(b, lambda x: x.k))), list_append(back, list_transform(b, lambda x: x.i)) from (
  select *, list_transform(range(1, 21), lambda d: list_sort(list_transform(list_filter(""" + _REACH + ", lambda i: cost[i][d] is not null), lambda i: {'k': cost[i][d] + " + _PRICE.format(t="t") + """, 'i': i}))[1]) as b from sv where j < n)),
wy(hike, m, back, at_, k) as (select hike, m, back, n, 0 from sv where j = n and cost[n][21] is not null union all select hike, m, back, back[at_][20 - k], k + 1 from wy where k < 20)"""
_PLANNED = "select hike, cast(row_number() over (partition by hike order by k desc) as integer) as day, lag_ as from_mile, mile as to_mile from (select hike, k, m[at_] as mile, lag(m[at_]) over (partition by hike order by k desc) as lag_ from wy) where lag_ is not null"

#: Water in the order of the greedy clusters, one point a step, with the heads so far.
_WATER = "(select poi_key, name, latitude as la, longitude as lo, s as source, row_number() over (order by (s = 'osm_water')::int, latitude, longitude, poi_key) as i from (select *, regexp_replace(lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')), '[- ]', '_', 'g') as s, row_number() over (partition by poi_key order by loaded_at desc) as rn from dim_pois) where rn = 1 and latitude between 33 and 48 and longitude between -86 and -66 and lower(regexp_replace(poi_type, '^\\s+|\\s+$', '', 'g')) = 'water')"
_GREEDY = f"""wa as (select * from {_WATER}), gr(i, heads, key, head) as (select i, [{{'k': poi_key, 'la': la, 'lo': lo}}], poi_key, poi_key from wa where i = 1 union all
select i, case when near is null then list_append(heads, {{'k': poi_key, 'la': la, 'lo': lo}}) else heads end, poi_key, coalesce(near, poi_key) from (
  select wa.i, heads, poi_key, la, lo, list_filter(heads, lambda h: sqrt(power((h.lo - lo) * 111132 * cos(radians(la)), 2) + power((h.la - la) * 111132, 2)) <= 50)[1].k as near from gr join wa on wa.i = gr.i + 1))"""
#: Spans of a line between kept vertices, split at the farthest one until none is further than the tolerance.
_FARTHEST = """en as (select line, min(seq) as i, max(seq) as j from v group by 1), fa(line, i, j) as (select line, i, j from en union all
select line, unnest([i, k]), unnest([k, j]) from (select fa.line, fa.i, fa.j, arg_max(m.seq, (off(m.x, m.y, a.x, a.y, b.x, b.y), -m.seq)) as k, max(off(m.x, m.y, a.x, a.y, b.x, b.y)) as o from fa join v a on a.line = fa.line and a.seq = fa.i join v b on b.line = fa.line and b.seq = fa.j join v m on m.line = fa.line and m.seq > fa.i and m.seq < fa.j group by 1, 2, 3) where o > {tol} * {tol})"""
_OFF = "(power({0} - {2} - {6} * ({4} - {2}), 2) + power({1} - {3} - {6} * ({5} - {3}), 2))"
_SHARE = "greatest(0.0, least(1.0, (({0} - {2}) * ({4} - {2}) + ({1} - {3}) * ({5} - {3})) / (power({4} - {2}, 2) + power({5} - {3}, 2))))"
_ENDS = ("m.x", "m.y", "a.x", "a.y", "b.x", "b.y")
_FARTHEST = _FARTHEST.replace("off(m.x, m.y, a.x, a.y, b.x, b.y)", _OFF.format(*_ENDS, _SHARE.format(*_ENDS)))

SQL = {
    "j08_crossings": f"""with {_SEG}, post as (select i * 10 + 5 as x from range(0, 49) t(i)), h as (select line, seg, y0 + (y1 - y0) * (post.x - x0) / (x1 - x0) as y, post.x from s join post on post.x between least(x0, x1) and greatest(x0, x1) and floor(least(x0, x1) / 10) = (post.x - 5) / 10)
select line, seg, round(x::double, 4) as x, round(y, 4) as y from h where y between 0 and 500""",
    "j17_nearest_segment": f"with {_NEAR} select point, round(d, 4) as distance from near",
    "w24_calibrated": """with m as (select l_orderkey as line, l_linenumber as a, max(round(l_quantity, 2)) as mile from lineitem group by 1, 2), r as (select line, count(*) * sum(a * mile) - sum(a) * sum(mile) < 0 as reversed from m group by 1) select reversed, count(*) as n from m join r using (line) group by 1""",
    "w26_resampled": """with l as (select p_partkey as line, p_size::double as len, sum(p_size::double) over (order by p_partkey) - p_size as off, row_number() over (order by p_partkey) as n from part),
i as (select *, unnest(generate_series(case when n = 1 then 0 else cast(floor(off / 25) as bigint) + 1 end, cast(floor((off + len) / 25) as bigint))) as k from l) select line, k * 25.0::double - off as along, k * 25.0::double as total from i""",
    "g02_projected": f"""with {_P}, a as (select poi_key, longitude as lo, latitude as la, sin(radians(latitude)) as s from u), q as (select *, {_Q.format("s")} as q from a)
select poi_key, round({_RHO.format("q")} * sin({_CONE_N!r} * radians(lo + 96)), 1) as x, round({_RHO.format(_Q0)} - {_RHO.format("q")} * cos({_CONE_N!r} * radians(lo + 96)), 1) as y, round(lo * 20037508.342789244 / 180, 1) as u, round(ln((1 + s) / (1 - s)) / 2 * 6378137, 1) as v, true as exact from q""",
    "j33_miles": f"""with {_NEAR}, mk as (select line, (seq * 10)::double as a, seq * 10 / 100.0::double + line * 5 as m from v where seq % 10 = 0), e as (select line, min(a) as a0, arg_min(m, a) as m0, max(a) as a1, arg_max(m, a) as m1 from mk group by 1),
k as (select point, any_value(near.along) as x, any_value(a0) as a0, any_value(m0) as m0, any_value(a1) as a1, any_value(m1) as m1, max(case when a <= along then a end) as la, arg_max(m, case when a <= along then a end) as lm, min(case when a > along then a end) as ha, arg_min(m, case when a > along then a end) as hm from near join e using (line) join mk using (line) group by 1)
select point, round(case when x <= a0 then m0 - (a0 - x) / 1609.344 when x >= a1 then m1 + (x - a1) / 1609.344 else lm + (hm - lm) * (x - la) / (ha - la) end, 3) as mile from k""",
    "a24_held_out": f"""with {_V}, m0 as (select line, x as a, x / 100 + y / 1000 as m, row_number() over (partition by line order by x) as n, count(*) over (partition by line) as c from v where seq % 5 = 0), f as (select * from m0 where c >= 4 and n % 2 = 1), t as (select * from m0 where c >= 4 and n % 2 = 0),
e as (select line, min(a) as a0, arg_min(m, a) as m0, max(a) as a1, arg_max(m, a) as m1 from f group by 1), k as (select t.line, t.a as x, t.m as y, a0, m0, a1, m1, max(case when f.a <= t.a then f.a end) as la, arg_max(f.m, case when f.a <= t.a then f.a end) as lm, min(case when f.a > t.a then f.a end) as ha, arg_min(f.m, case when f.a > t.a then f.a end) as hm from t join e on e.line = t.line join f on f.line = t.line group by 1, 2, 3, 4, 5, 6, 7),
r as (select abs(case when x <= a0 then m0 - (a0 - x) / 100 when x >= a1 then m1 + (x - a1) / 100 else lm + (hm - lm) * (x - la) / (ha - la) end - y) as e from k) select round(quantile_cont(e, 0.5), 6) as median, round(quantile_cont(e, 0.95), 6) as p95, round(max(e), 6) as worst from r""",
    "dp1_days": f"""with recursive st as (select p_partkey % 20 as hike, (p_partkey // 20 * 5 + p_size % 5)::double as mile, max((p_size % 2 = 0)::int) = 1 as camp from part group by 1, 2), {_PLAN.format(target="14.0")} {_PLANNED}""",
    "dp2_exact": f"""with recursive n0 as (select max(p_partkey) + 1 as n, ceil((max(p_partkey) + 1) / 50)::bigint as hikes from part), st as (select (p_partkey * hikes) // n as hike, (p_partkey * 5 + p_size % 5)::double as mile, max((p_size % 2 = 0)::int) = 1 as camp from part, n0 group by 1, 2), {_EXACT} {_PLANNED}""",
    "g07_areas": f"""with {_V}, r as (select *, lead(x) over w as nx, lead(y) over w as ny, first_value(x) over w as fx, first_value(y) over w as fy, count(*) over (partition by line) as n from v window w as (partition by line order by seq))
select line, round(case when any_value(n) >= 3 then abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 else 0 end, 3) as area from r group by 1""",
    "g13_tiles": f"with {_P} select {_TILE.format(lon='longitude', lat='latitude', n=256)}, count(*) as n from u group by 1, 2",
    "r01_tile_cover": f"""with c as (select distinct * from closures where start_lat is not null and start_lon is not null), t as (select id, unnest(generate_series({_TX.format("(start_lon - 0.25)")}, {_TX.format("(start_lon + 0.25)")})) as x, start_lat from c),
b as (select id, x, unnest(generate_series({_TY.format("(start_lat + 0.25)")}, {_TY.format("(start_lat - 0.25)")})) as y from t) select cast(x as integer) as x, cast(y as integer) as y, count(*) as n from b group by 1, 2""",
    "r04_owners": f"""with {_P}, c as (select i as cell, (i % 8 * 2 - 84)::double as w, (i // 8 * 2 + 35)::double as s from range(0, 40) t(i))
select poi_key, arg_min(cell, (case when longitude >= w and longitude < w + 2 and latitude >= s and latitude < s + 2 then 0 else 1 end, power(greatest(w - longitude, longitude - w - 2, 0), 2) + power(greatest(s - latitude, latitude - s - 2, 0), 2), cell)) as cell from u join c on true group by 1""",
    "r07_floored": "select p_partkey, cast(p_partkey % 256 // 16 * 16 as integer) as blue from part",
    "src14_sampled": """with r as (select l_orderkey % 10 as t, l_linenumber % 8 as y, l_suppkey % 8 as x, max(case when l_orderkey % 3 <> 0 then l_quantity end) as v from lineitem group by 1, 2, 3), w as (select p_partkey as point, p_partkey % 8 as y, p_partkey // 8 % 8 as x, k as rank, (p_partkey + k * 3) % 10 as t from part, (select unnest([0, 1, 2]) as k))
select point, arg_min(v, case when v is not null then rank end) as value from w left join r using (t, y, x) group by 1""",
    "dp7_rests": """with c as (select user_id, event_id, value >= 10 as walked, sum((value >= 10)::int) over (partition by user_id order by event_id) as c, max(event_id) over (partition by user_id) as last from events), r as (select *, walked and c % 7 = 0 and event_id < last as rest_after from c)
select event_id, rest_after, cast(sum(rest_after::int) over (partition by user_id order by event_id) - rest_after::int as bigint) as shift from r""",
    "dp8_slots": """with p as (select l_orderkey as route, l_linenumber as seq, max((l_partkey % 300)::double) as mile, (l_orderkey % 300)::double as new from lineitem group by 1, 2, 4), q as (select *, lag(mile) over w as prev, row_number() over w - 1 as i, count(*) over (partition by route) as n from p window w as (partition by route order by seq)),
s as (select route, case when prev is null then abs(mile - new) else abs(new - prev) + abs(mile - new) - abs(mile - prev) end as cost, i as slot from q union all select route, abs(new - mile), n from q where i = n - 1)
select route, cast(slot as integer) as slot, cost from (select *, row_number() over (partition by route order by cost, slot desc) as rn from s) where rn = 1""",
    "snk01_features": f"with {_P} select poi_key, known_type, longitude, latitude from u",
    "w35_clusters": f"with recursive {_GREEDY} select key as poi_key, head from gr",
    "w35_folded": f"""with recursive {_GREEDY}, ws as (select * from {_WATER}) select head, string_agg(distinct source, ',' order by source) as sources, arg_min(name, case when name is not null then ((source = 'osm_water')::int, poi_key) end) as name, count(*) as n from gr join ws on poi_key = key group by 1""",
    "g12_simplified": f"with recursive {_V}, {_FARTHEST.format(tol=6)} select line, seq from v where (line, seq) in (select (line, i) from fa union select (line, j) from fa)",
    "st02_stream": trail.SQL["st02_direction"],
    "st_windows": "select ts::date as day, event_type, count(*) as n from events group by 1, 2",
    "st08_once": "select reporter_type, count(distinct id) as n from field_notes group by 1",
    "st01_stream": """with f as (select *, case when (value > 20) is distinct from lag(value > 20) over (partition by user_id order by ts) then 1 else 0 end as b from events), i as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as i from f),
h as (select *, epoch(ts - min(ts) over (partition by user_id, i)) / 3600 as h from i) select case when h >= 25 then 'push' when h >= 12 then 'cue' else 'silent' end as alert, count(*) as n from h where value > 20 group by 1""",
}
