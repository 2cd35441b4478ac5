"""Queries over trips, hikes, plans and what lies along a route. A user's events stand for trips of one to seven miles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import effort
from ..functions.plain import usable_position
from ..operators import nearby, planning, sites
from ..operators import notes as N
from ..operators import routes as R
from ..operators import sequence as S
from ..session import cut, table
from . import conditions, lines, trail, warehouse
from .conditions import closures, notes
from .places import current_places

LOW, HIGH = 100.0, 800.0


def trips(spark: SparkSession, d: str) -> DataFrame:
    """Trips with the miles they go over, their day and how far they are done."""
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "planned").when(F.col("event_type") == "signup", "part").otherwise("walked")
    return table(spark, d, "events").select(k.alias("trip"), "user_id", "ts", F.to_date("ts").alias("day"), (k % 997).cast("double").alias("start"), (k % 997 + 1 + k % 7).cast("double").alias("end"), kind.alias("kind"), "value")


def a20_reach(spark: SparkSession, d: str) -> DataFrame:
    """Middle half of the miles of days on trail (days of nothing left out), only for users with at least three."""
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(F.floor(F.col("value")).cast("long")).alias("v")).where("v > 0")
    q = days.groupBy("user_id").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    return q.select("user_id", F.when(F.col("n") >= 3, F.get("q", F.lit(0))).alias("low"), F.when(F.col("n") >= 3, F.get("q", F.lit(1))).alias("high"))


def a26_part_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Sum and greatest of the gaps from the end of a trip to the start of the next one along the trail."""
    return R.gaps_between(trips(spark, d), ["user_id"], "start", "end", "trip").groupBy("user_id").agg(F.sum("gap").alias("gaps"), F.max("gap").alias("widest"))


def a33_hike_figures(spark: SparkSession, d: str) -> DataFrame:
    """Miles walked within a hike's bounds, days out, trips, and trips whose miles are not certain."""
    t = trips(spark, d)
    inside = t.where((F.col("end") > LOW) & (F.col("start") < HIGH))
    miles = S.clip(S.merged_intervals(t.where("kind = 'walked'"), ["user_id"], "start", "end"), LOW, HIGH).groupBy("user_id").agg(F.sum(F.col("end") - F.col("start")).alias("miles"))
    out = inside.groupBy("user_id").agg(F.countDistinct("day").alias("days"), F.count(F.lit(1)).alias("trips"), F.count(F.when(F.col("kind") == "part", 1)).alias("uncertain"))
    return out.join(miles, "user_id", "left").select("user_id", F.coalesce("miles", F.lit(0.0)).alias("miles"), "days", "trips", "uncertain")


def _grouped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = cut(current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude"))))
    return p, cut(sites.grouped(p, "poi_key", "known_type", "name", "latitude", "longitude").withColumn("metres", F.round("metres", 2)))


def a37_composition(spark: SparkSession, d: str) -> DataFrame:
    """What a site shows: its anchor's pin, else that of the first visible member; and the kinds of its members."""
    p, g = _grouped(spark, d)
    return R.composition(g, p, "poi_key", "known_type", F.coalesce(F.col("confidence") != "low", F.lit(True)), sites.MEMBER_TYPES)


def k12_nearby(spark: SparkSession, d: str) -> DataFrame:
    """Members around an anchor in order of kind, then distance, in whole metres; none is nearer than three."""
    p, g = _grouped(spark, d)
    return R.phrases(g, p, "poi_key", "known_type", sites.MEMBER_TYPES, 3)


def x15_nearby(spark: SparkSession, d: str) -> DataFrame:
    """The nearby list of every anchor, with the nearest mapped water of 400 m added where the site has none."""
    p, g = _grouped(spark, d)
    listed = R.phrases(g, p, "poi_key", "known_type", sites.MEMBER_TYPES, 3)
    wet = g.join(p.where("known_type = 'water'").select(F.col("poi_key").alias("member")), "member", "left_semi").select("anchor").distinct()
    dry = p.join(listed.select(F.col("anchor").alias("poi_key")), "poi_key", "left_semi").join(wet.withColumnRenamed("anchor", "poi_key"), "poi_key", "left_anti")
    water = p.where("known_type = 'water'")
    near = nearby.nearest_within(dry, water, "poi_key", "poi_key", "latitude", "longitude", 400.0).select(F.col("id_l").alias("anchor"), F.concat(F.lit("water "), F.greatest(F.round("metres"), F.lit(3.0)).cast("int").cast("string")).alias("surveyed"))
    return listed.join(near, "anchor", "left").select("anchor", F.concat_ws("; ", "nearby", "surveyed").alias("nearby"))


def x11_synthetic_water(spark: SparkSession, d: str) -> DataFrame:
    """A water member made up for every shelter with water within 150 m whose site has none of its own."""
    p, g = _grouped(spark, d)
    water = p.where("known_type = 'water'")
    wet = g.join(water.select(F.col("poi_key").alias("member")), "member", "left_semi").select(F.col("anchor").alias("poi_key")).distinct()
    dry = p.where("known_type = 'shelter'").join(wet, "poi_key", "left_anti")
    near = nearby.nearest_within(dry, water, "poi_key", "poi_key", "latitude", "longitude", 150.0)
    lone = near.join(g.select(F.col("anchor").alias("id_l"), F.lit(False).alias("lone")).distinct(), "id_l", "left")
    return lone.select(F.concat(F.lit("synthetic:"), "id_l").alias("id"), F.col("id_l").alias("anchor"), F.lit("water").alias("poi_type"), F.coalesce("lone", F.lit(True)).alias("promoted"))


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one club (null where nobody) along the half miles of the trail; as many rows as the trail has half miles, so one task holds them."""
    marks = notes(spark, d).where("mile is not null").groupBy((F.floor(F.col("mile") * 2) / 2).alias("mile")).agg(F.max_by("reporter_type", "id").alias("said"), F.max("id").alias("top"))
    marks = marks.select("mile", F.when(F.substring("top", 2, 1) < "8", F.col("said")).alias("club"), F.lit("trail").alias("trail"))
    return S.equal_runs(marks, ["trail"], "mile", "club", 0.75, 0.25)


def a39_unattributed(spark: SparkSession, d: str) -> DataFrame:
    runs = _stretches(spark, d).where("club is null")
    return runs.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0.0)).alias("miles"), F.count(F.lit(1)).alias("runs"))


def a40_stretch_index(spark: SparkSession, d: str) -> DataFrame:
    """Clubs from south to north by where they start; nobody's stretches are kept under a name of their own."""
    runs = _stretches(spark, d).groupBy("club").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("miles"), F.count(F.lit(1)).alias("runs"))
    return runs.select(F.coalesce("club", F.lit("unattributed")).alias("club"), "start", "end", "miles", "runs")


def w38_timeline(spark: SparkSession, d: str) -> DataFrame:
    """All runs of clubs and of nobody in trail order, numbered."""
    return _stretches(spark, d).select(F.row_number().over(Window.partitionBy("trail").orderBy("start")).cast("long").alias("place"), "club", "start", "end")


def j37_club(spark: SparkSession, d: str) -> DataFrame:
    """The club of each closure's start: half-open runs, the first in order wins where runs overlap."""
    runs = _stretches(spark, d).where("club is not null").select("club", "start", "end")
    points = closures(spark, d).where("start_mile_marker is not null").select("id", F.col("start_mile_marker").alias("mile"))
    hit = N.stabbing(points, runs, "mile", "start", "end", 2.0).where("mile < end")
    return hit.groupBy("id").agg(F.min_by("club", "start").alias("club"))


def a44_bounding_hike(spark: SparkSession, d: str) -> DataFrame:
    """The hike that bounds a user's trips; the first of equal extremes gives the end its name."""
    t = trips(spark, d)
    return t.groupBy("user_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("trip", F.struct("start", "trip")).alias("from_trip"), F.max_by("trip", F.struct(F.col("end"), -F.col("trip"))).alias("to_trip"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def a45_lacking(spark: SparkSession, d: str) -> DataFrame:
    """Sources that have no viewpoint among their places."""
    views = current_places(spark, d).where("known_type = 'viewpoint'").select("source")
    return table(spark, d, "poi_sources").select("source").join(views, "source", "left_anti")


def w09_between(spark: SparkSession, d: str) -> DataFrame:
    """Raw climb between two mileposts, both included, with breaks kept."""
    e = trail.events(spark, d).where((F.col("event_id") % 997).between(100, 600))
    return S.ascent_over_profile(e, ["user_id"], trail.ORDER, trail.LEVEL, 0.0, "part_start").select("user_id", F.round("ascent", 3).alias("ascent"))


def w17_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of a hike: its trips by kind, and the gaps of at least 0.2 miles that no trip covers."""
    return R.pieces(trips(spark, d), ["user_id"], "start", "end", "kind", 0.0, 1000.0, 0.2)


def w22_slice(spark: SparkSession, d: str) -> DataFrame:
    """Vertices between two miles for every part that reaches in; one with fewer than two in range is widened to its neighbours."""
    v = notes(spark, d).where("mile is not null and lat is not null").groupBy(F.col("reporter_id").alias("part"), "mile").agg(F.min("id").alias("id"))
    return R.slice_between(v, "part", "mile", 700.0, 760.0).select("part", "id", "mile")


def w32_carries(spark: SparkSession, d: str) -> DataFrame:
    """Food to carry over each section: from its first row to its last, days and amount."""
    w = Window.partitionBy("user_id").orderBy(*trail.ORDER)
    e = trail.events(spark, d)
    after = F.coalesce(F.lag(F.col("event_type") == "purchase").over(w), F.lit(True))
    s = S.islands(e, ["user_id"], trail.ORDER, after, "section")
    order = F.struct(*trail.ORDER)
    return s.groupBy("user_id", "section").agg(F.min_by("event_id", order).alias("from_id"), F.max_by("event_id", order).alias("to_id"), F.countDistinct(F.to_date("ts")).alias("days"), F.round(F.sum("value"), 3).alias("miles")).withColumn("section", F.col("section").cast("long"))


def k03_gaps_near(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of a hike that fit a day of fifty miles, nearest to mile 500 first."""
    gaps = trail.w16_gaps(spark, d).withColumn("away", F.greatest(F.col("start") - 500.0, 500.0 - F.col("end"), F.lit(0.0))).where(F.col("end") - F.col("start") <= 50)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("away", "start"))
    return gaps.select("user_id", "start", "end", "away", place.cast("long").alias("place"))


def k09_beyond(spark: SparkSession, d: str) -> DataFrame:
    """The nearest stop beyond mile 700 toward 900, for each kind of reporter."""
    stops = notes(spark, d).where("mile > 700 and mile <= 900 and poi_id is not null")
    return stops.groupBy("reporter_type").agg(F.min_by("poi_id", F.struct("mile", "id")).alias("stop"), F.min("mile").alias("mile"))


def j48_nearest_stop(spark: SparkSession, d: str) -> DataFrame:
    """The stop nearest to each closure's start, within half a mile; the later of equally near ones."""
    stops = notes(spark, d).where("mile is not null and poi_id is not null").select(F.col("id").alias("stop"), (F.col("mile") - 0.5).alias("low"), (F.col("mile") + 0.5).alias("high"), F.col("mile").alias("at"))
    points = closures(spark, d).where("start_mile_marker is not null").select("id", F.col("start_mile_marker").alias("mile"))
    hit = N.stabbing(points, stops, "mile", "low", "high", 1.0).withColumn("away", F.round(F.abs(F.col("at") - F.col("mile")), 6))
    return hit.groupBy("id").agg(F.max_by("stop", F.struct(-F.col("away"), "stop")).alias("stop"), F.min("away").alias("away"))


def k10_one_photo(spark: SparkSession, d: str) -> DataFrame:
    """One note of each place: the nearest to it, then the newest, then the smallest id."""
    n = notes(spark, d).where("lat is not null and poi_id is not null").select("id", F.col("poi_id").alias("poi_key"), "lat", "lon", "observed_at")
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude"))).select("poi_key", "latitude", "longitude")
    away = F.round(F.abs(F.col("lat") - F.col("latitude")) + F.abs(F.col("lon") - F.col("longitude")), 5)
    return n.join(p, "poi_key").groupBy("poi_key").agg(F.min_by("id", F.struct(away, -F.unix_micros(F.col("observed_at").cast("timestamp")), "id")).alias("id"))


def n09_sample_at(spark: SparkSession, d: str) -> DataFrame:
    """The sample nearest to mile 500 of each walk; a later one only if it is nearer."""
    e = trail.events(spark, d).withColumn("mile", (F.col("event_id") % 997).cast("double"))
    return e.groupBy("user_id").agg(F.min_by("event_id", F.struct(F.abs(F.col("mile") - 500.0), "ts", "event_id")).alias("event_id"), F.min(F.abs(F.col("mile") - 500.0)).alias("away"))


def n11_legs(spark: SparkSession, d: str) -> DataFrame:
    """Distance, climb, fall and minutes of each walk's leg between two miles."""
    e = trail.events(spark, d).where((F.col("event_id") % 997).between(100, 600))
    up = S.ascent_over_profile(e, ["user_id"], trail.ORDER, trail.LEVEL, 0.0, "part_start")
    down = S.ascent_over_profile(e, ["user_id"], trail.ORDER, trail.LEVEL, 0.0, "part_start", sign=-1).withColumnRenamed("ascent", "descent")
    miles = e.groupBy("user_id").agg((F.max(F.col("event_id") % 997) - F.min(F.col("event_id") % 997)).cast("double").alias("miles"))
    legs = miles.join(up, "user_id", "left").join(down, "user_id", "left").na.fill(0.0)
    return legs.select("user_id", "miles", F.round("ascent", 3).alias("ascent"), F.round("descent", 3).alias("descent"), F.round(effort.naismith_minutes(F.col("miles"), F.col("ascent")), 3).alias("minutes"))


def n12_reached(spark: SparkSession, d: str) -> DataFrame:
    """The mile reached after ten hours of walking; walks that are shorter end where they end."""
    e = trail.events(spark, d)
    step = effort.naismith_minutes(F.col("value"), F.greatest(F.coalesce(F.col(trail.LEVEL), F.lit(0.0)), F.lit(0.0)))
    return R.mile_at_minutes(e.withColumn("minutes", step), ["user_id"], trail.ORDER, "value", "minutes", 600.0).select("user_id", F.round("mile", 4).alias("mile"))


def x28_lane_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Notes of one lane that chain to the one before within a mile and a half: middle, count, first and last."""
    rows = notes(spark, d).where("mile is not null").select("reporter_id", F.coalesce("observation", F.lit("none")).alias("lane"), "mile", "id")
    w = Window.partitionBy("reporter_id", "lane").orderBy("mile", "id")
    runs = S.islands(rows, ["reporter_id", "lane"], ["mile", "id"], F.coalesce(F.col("mile") - F.lag("mile").over(w) > 1.5, F.lit(True)), "cluster")
    return runs.groupBy("reporter_id", "lane", "cluster").agg(F.round((F.min("mile") + F.max("mile")) / 2, 4).alias("middle"), F.count(F.lit(1)).alias("n")).drop("cluster")


def x29_group_figures(spark: SparkSession, d: str) -> DataFrame:
    """Miles walked at least once by a group of users, its days, first and last."""
    t = trips(spark, d).withColumn("team", F.col("user_id") % 20)
    miles = S.merged_intervals(t, ["team"], "start", "end").groupBy("team").agg(F.sum(F.col("end") - F.col("start")).alias("miles"))
    return t.groupBy("team").agg(F.countDistinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).join(miles, "team")


def x30_group_trips(spark: SparkSession, d: str) -> DataFrame:
    """Trips of a user by their day, those without one last."""
    t = trips(spark, d).withColumn("day", F.when(F.col("kind") != "planned", F.col("day")))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("day"), "trip"))
    return t.select("trip", place.cast("long").alias("place"))


def _ways(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("northbound",), ("southbound",)], "way string")  # two rows


def _ahead(spark: SparkSession, d: str) -> DataFrame:
    c = closures(spark, d).where("start_mile_marker is not null and end_mile_marker is not null").crossJoin(F.broadcast(_ways(spark)))
    return c.withColumn("ahead", R.distance_ahead(F.col("start_mile_marker"), F.col("end_mile_marker"), F.lit(700.0), F.col("way")))


def x31_ahead(spark: SparkSession, d: str) -> DataFrame:
    """How far every notice lies ahead of mile 700 either way: 0 inside, null behind."""
    return _ahead(spark, d).select("id", "way", F.round("ahead", 6).alias("ahead"))


def x32_lanes(spark: SparkSession, d: str) -> DataFrame:
    """The nearest specific and the nearest broad notice ahead, either way."""
    broad = F.abs(F.col("end_mile_marker") - F.col("start_mile_marker")) > 50
    rows = N.nearest_ahead(_ahead(spark, d), F.concat_ws(" ", "way", F.when(broad, "broad").otherwise("specific")), F.col("ahead"), "id")
    return rows.select("lane", "id", F.round("ahead", 6).alias("ahead"))


def x33_highlights(spark: SparkSession, d: str) -> DataFrame:
    """Spans that overlap miles 400 to 900, in order of their start."""
    lo, hi = F.least("start_mile_marker", "end_mile_marker"), F.greatest("start_mile_marker", "end_mile_marker")
    rows = closures(spark, d).select("id", lo.alias("start"), hi.alias("end")).where("start <= 900 and end >= 400")
    placed = S.running_totals(rows.withColumn("order", F.struct("start", "id")), "order", {"place": F.lit(1).cast("long")})
    return placed.drop("order")


def x34_ascents(spark: SparkSession, d: str) -> DataFrame:
    """Climb of each order's legs; null if the profile of any leg is missing."""
    leg = F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(F.count(leg) == F.count(F.lit(1)), F.sum(leg)).alias("ascent"), F.count(F.lit(1)).alias("legs"))


def x35_on_ribbon(spark: SparkSession, d: str) -> DataFrame:
    """Notes within the ten miles from each reporter's first mile; a window without any other note has no row."""
    rows = notes(spark, d).where("mile is not null").select("reporter_id", "mile")
    first = rows.groupBy("reporter_id").agg(F.min("mile").alias("low"))
    inside = rows.join(first, "reporter_id").where((F.col("mile") > F.col("low")) & (F.col("mile") <= F.col("low") + 10))
    return inside.groupBy("reporter_id").agg(F.count(F.lit(1)).alias("n"), F.max("mile").alias("last"))


def x36_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Rendered features once each, by type: notes come twice where tiles overlap."""
    rows = table(spark, d, "field_notes").select("id", F.coalesce("observation", F.lit("none")).alias("kind"))
    return rows.dropDuplicates(["id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def x37_ticks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_size") + F.floor(F.col("p_retailprice")) % 40 + 1).cast("double").alias("b"))
    return R.ticks(p, "a", "b", effort.tick_step(F.col("b") - F.col("a"))).select("p_partkey", F.round("tick", 6).alias("tick"))


def _plan_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of a plan: each user's trips in order of time; day numbers are 0, 1, 2, ... and dates follow on."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "trip")) - 1
    t = trips(spark, d).withColumn("n", n.cast("long"))
    return t.select("user_id", "trip", "n", F.date_add(F.lit("2026-05-01").cast("date"), F.col("n").cast("int")).alias("date"), "kind")


def x38_zero_inserted(spark: SparkSession, d: str) -> DataFrame:
    """A day of rest after the third day: later days move on by one, in number and date."""
    return R.insert_day(_plan_days(spark, d), "user_id", "n", "date", 2, {"trip": F.lit(None).cast("long"), "kind": F.lit("zero")})


def x39_day_removed(spark: SparkSession, d: str) -> DataFrame:
    """The fourth day taken out unless it is walked; what follows moves back by one."""
    return R.remove_day(_plan_days(spark, d), "user_id", "n", "date", 3, F.col("kind") != "walked")


def x41_walked_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of walked days, from the lower mile to the higher; days of nothing are left out."""
    t = trips(spark, d).withColumn("end", F.when(F.col("trip") % 5 == 0, F.col("start")).when(F.col("trip") % 2 == 0, F.col("start") - 3).otherwise(F.col("end")))
    return t.where((F.col("kind") == "walked") & (F.col("start") != F.col("end"))).select("trip", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))


def _vertices(spark: SparkSession, d: str) -> DataFrame:
    """The trail as the positions with miles that maintainers gave."""
    return notes(spark, d).where("reporter_type = 'maintainer' and mile is not null and lat is not null and lon is not null").select(F.col("id").alias("vertex"), "lat", "lon", F.col("mile").alias("at"))


LOST_M = 4828.032


def _located(spark: SparkSession, d: str, points: DataFrame, key: str) -> DataFrame:
    """(key, mile) of the nearest vertex of the trail within three miles."""
    v = _vertices(spark, d)
    best = nearby.nearest_within(points, v.withColumnRenamed("vertex", key), key, key, "lat", "lon", LOST_M)
    return best.join(v.select(F.col("vertex").alias("id_r"), "at"), "id_r").select(F.col("id_l").alias(key), F.col("at").alias("mile"), "metres")


def j42_located(spark: SparkSession, d: str) -> DataFrame:
    points = closures(spark, d).where("start_lat is not null and start_lon is not null").select("id", F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"))
    return _located(spark, d, points, "id").select("id", "mile", F.round("metres", 1).alias("metres"))


def j43_reprojected(spark: SparkSession, d: str) -> DataFrame:
    """Closures at the miles their ends have on the trail of today, if both ends are found; else as they are."""
    c = closures(spark, d)
    end = lambda e: _located(spark, d, c.where(f"{e}_lat is not null and {e}_lon is not null").select("id", F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")), "id").select("id", F.col("mile").alias(f"{e}_now"))
    out = c.join(end("start"), "id", "left").join(end("end"), "id", "left")
    both = F.col("start_now").isNotNull() & F.col("end_now").isNotNull()
    return out.select("id", F.when(both, F.col("start_now")).otherwise(F.col("start_mile_marker")).alias("start"), F.when(both, F.col("end_now")).otherwise(F.col("end_mile_marker")).alias("end"), both.alias("moved"))


def x42_placed(spark: SparkSession, d: str) -> DataFrame:
    """Warnings by the mile of the nearest vertex, else the mile they came with; those with neither are dropped."""
    rows = notes(spark, d).where("observation in ('closed', 'damaged')").select("id", "lat", "lon", F.col("mile").alias("stored"))
    snapped = _located(spark, d, rows, "id").select("id", "mile")
    return rows.join(snapped, "id", "left").select("id", F.coalesce("mile", "stored").alias("mile")).where("mile is not null")


def j49_anchored(spark: SparkSession, d: str) -> DataFrame:
    """A mile on one axis carried to another by the offset of the nearest anchor (two axes: the note's mile and its half mile)."""
    anchors = _vertices(spark, d).select(F.col("at").alias("a"), (F.round(F.col("at") * 2) / 2).alias("b"))
    points = closures(spark, d).where("start_mile_marker is not null").select("id", F.col("start_mile_marker").alias("mile"))
    near = N.stabbing(points, anchors.withColumns({"low": F.col("a") - 25.0, "high": F.col("a") + 25.0}), "mile", "low", "high", 50.0)
    best = near.groupBy("id").agg(F.min_by(F.col("mile") + F.col("b") - F.col("a"), F.struct(F.round(F.abs(F.col("mile") - F.col("a")), 6), "a")).alias("mile"))
    return best.select("id", F.round("mile", 4).alias("mile"))


def x43_dispute(spark: SparkSession, d: str) -> DataFrame:
    """Each place with its dispute: no verdict (never noted) is told from a verdict of no dispute."""
    found = conditions.a07_disputes(spark, d).select(F.col("poi_id").alias("poi_key"), "reported_missing")
    out = current_places(spark, d).select("poi_key").join(found, "poi_key", "left")
    return out.groupBy(F.when(F.col("reported_missing").isNull(), "none").when(F.col("reported_missing"), "missing").otherwise("answered").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def _stops(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    stops = table(spark, d, "part").select((F.floor(k / 40)).alias("hike"), (k % 40 * 5 + F.col("p_size") % 5).cast("double").alias("mile"), (F.col("p_size") % 2 == 0).alias("camp"))
    return stops.groupBy("hike", "mile").agg(F.max("camp").alias("camp"))


def dp4_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Stops strictly between miles 50 and 150 with the two termini, which are no camps."""
    return planning.candidate_stops(_stops(spark, d), "hike", "mile", "camp", 50.0, 150.0)


def dp3_via(spark: SparkSession, d: str) -> DataFrame:
    """Days of a hike that must pass mile 100: planned leg by leg, the legs laid end to end."""
    return planning.planned_via(_stops(spark, d), "hike", "mile", "camp", [0.0, 100.0, 200.0], 14.0)


def dp5_absorbed(spark: SparkSession, d: str) -> DataFrame:
    """The stretch from mile 50 to 150 in as many days as before (six), lost miles spread over them."""
    out = planning.planned_days(planning.candidate_stops(_stops(spark, d), "hike", "mile", "camp", 50.0, 150.0), "hike", "mile", "camp", 0.0, days=6)
    return out.groupBy("hike").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg(F.col("to_mile") - F.col("from_mile")), 4).alias("average"))


def dp6_shifted(spark: SparkSession, d: str) -> DataFrame:
    """The same stretch at fourteen miles a day, and how many days later than six it ends."""
    out = planning.planned_days(planning.candidate_stops(_stops(spark, d), "hike", "mile", "camp", 50.0, 150.0), "hike", "mile", "camp", 14.0)
    n = out.groupBy("hike").agg(F.count(F.lit(1)).alias("days"))
    return n.select("hike", "days", (F.col("days") - 6).alias("shift"), F.date_add(F.lit("2026-05-10").cast("date"), (F.col("days") - 6).cast("int")).alias("finish"))


def x40_choices(spark: SparkSession, d: str) -> DataFrame:
    """Both ways to get back to a plan side by side: absorb the miles or shift the end."""
    a, s = dp5_absorbed(spark, d), dp6_shifted(spark, d)
    return s.join(a.select("hike", "average"), "hike", "left").select("hike", "average", "shift", "finish")


QUERIES = {f.__name__: f for f in (a20_reach, a26_part_gaps, a33_hike_figures, a37_composition, a39_unattributed, a40_stretch_index, a44_bounding_hike, a45_lacking, w09_between, w17_pieces, w22_slice, w32_carries, w38_timeline, j37_club, j42_located, j43_reprojected, j48_nearest_stop, j49_anchored, k03_gaps_near, k09_beyond, k10_one_photo, k12_nearby, n09_sample_at, n11_legs, n12_reached, x11_synthetic_water, x15_nearby, x28_lane_clusters, x29_group_figures, x30_group_trips, x31_ahead, x32_lanes, x33_highlights, x34_ascents, x35_on_ribbon, x36_drawn, x37_ticks, x38_zero_inserted, x39_day_removed, x40_choices, x41_walked_spans, x42_placed, x43_dispute, dp3_via, dp4_candidates, dp5_absorbed, dp6_shifted)}

_N = "n as (select distinct * from field_notes)"
_C = "c as (select distinct * from closures)"
_T = "t as (select event_id as trip, user_id, ts, ts::date as day, (event_id % 997)::double as a, (event_id % 997 + 1 + event_id % 7)::double as b, case event_type when 'error' then 'planned' when 'signup' then 'part' else 'walked' end as kind, value from events)"
_E = trail._E
_G = f"g as ({warehouse.SQL['w36_sites']})"
_P = warehouse._P
_RANK = "case known_type " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(sites.MEMBER_TYPES)) + f" else {len(sites.MEMBER_TYPES)} end"
_LISTED = f"""{_G}, {_P}, li as (select anchor, string_agg(coalesce(known_type || ' ', '') || cast(greatest(round(metres), 3) as integer), '; ' order by {_RANK}, cast(greatest(round(metres), 3) as integer), member) as nearby from g join p on p.poi_key = member group by 1)"""
_WET = "wet as (select distinct anchor from g join p on p.poi_key = member where known_type = 'water')"
_PAIR = "{0} a join u b on b.known_type = 'water' and abs(a.latitude - b.latitude) < {1} where {2} <= {3}"
_MARKS = f"""{_N}, mk as (select floor(mile * 2) / 2 as mile, case when substring(max(id), 2, 1) < '8' then arg_max(reporter_type, id) end as club from n where mile is not null group by 1),
f as (select *, case when club is not distinct from lag(club) over (order by mile) and mile - lag(mile) over (order by mile) <= 0.75 then 0 else 1 end as b from mk),
i as (select *, sum(b) over (order by mile rows unbounded preceding) as i from f), r as (select any_value(club) as club, min(mile) - 0.25 as "start", max(mile) + 0.25 as "end" from i group by i)"""
_BETWEEN = f"{_E}, w as (select * from e where event_id % 997 between 100 and 600), l as (select *, case when not part_start then lag(level) over (partition by user_id order by ts, event_id) end as p from w)"
_UP = "sum(case when level is not null and p is not null then greatest(level - p, 0) else 0 end)"
_DOWN = "sum(case when level is not null and p is not null then greatest(p - level, 0) else 0 end)"
_AHEAD = f"""{_C}, m as (select *, least(start_mile_marker, end_mile_marker) as lo, greatest(start_mile_marker, end_mile_marker) as hi from c where start_mile_marker is not null and end_mile_marker is not null),
h as (select id, way, lo, hi, case when 700 between lo and hi then 0 when way = 'northbound' and lo > 700 then lo - 700 when way = 'southbound' and hi < 700 then 700 - hi end as ahead from m, (select unnest(['northbound', 'southbound']) as way))"""
_DAYS = f"{_T}, p as (select user_id, trip, row_number() over (partition by user_id order by ts, trip) - 1 as n, kind from t)"
_FAR = "2 * 6371008.8 * asin(least(1.0, sqrt(power(sin((radians(v.lat) - radians(q.lat)) / 2), 2) + cos(radians(q.lat)) * cos(radians(v.lat)) * power(sin((radians(v.lon) - radians(q.lon)) / 2), 2))))"
_V = f"{_N}, v as (select id as vertex, lat, lon, mile as vm from n where reporter_type = 'maintainer' and mile is not null and lat is not null and lon is not null)"


def _near(points: str) -> str:
    return f"(select id, vm as mile, m as metres from (select q.id, v.vm, {_FAR} as m, row_number() over (partition by q.id order by {_FAR}, v.vertex) as rn from ({points}) q join v on abs(v.lat - q.lat) < 0.0435 where {_FAR} <= {LOST_M}) where rn = 1)"


_STOPS = "s as (select p_partkey // 40 as hike, (p_partkey % 40 * 5 + p_size % 5)::double as mile, max((p_size % 2 = 0)::int) = 1 as camp from part group by 1, 2)"
_CAND = f"{_STOPS}, k as (select hike, mile, camp from s where mile > 50 and mile < 150 union all select hike, unnest([50.0, 150.0])::double, false from (select distinct hike from s))"
_RUNS = trail._merge("s", "user_id")

SQL = {
    "a20_reach": "with d as (select user_id, ts::date as day, cast(sum(floor(value)) as bigint) as v from events group by 1, 2 having sum(floor(value)) > 0) select user_id, case when count(*) >= 3 then quantile_cont(v, 0.25) end as low, case when count(*) >= 3 then quantile_cont(v, 0.75) end as high from d group by 1",
    "a26_part_gaps": f"with {_T}, g as (select user_id, abs(lead(a) over (partition by user_id order by a, trip) - b) as gap from t) select user_id, sum(gap) as gaps, max(gap) as widest from g group by 1",
    "a33_hike_figures": f"""with {_T}, s as (select user_id, a, b from t where kind = 'walked'), {_RUNS}, x as (select user_id, sum(least("end", 800) - greatest("start", 100)) as miles from m where least("end", 800) > greatest("start", 100) group by 1),
o as (select user_id, count(distinct day) as days, count(*) as trips, count(*) filter (kind = 'part') as uncertain from t where b > 100 and a < 800 group by 1) select user_id, coalesce(miles, 0.0) as miles, days, trips, uncertain from o left join x using (user_id)""",
    "a37_composition": f"""with {_G}, {_P}, m as (select anchor, member, known_type, confidence is distinct from 'low' as seen from g join p on p.poi_key = member),
o as (select anchor, arg_min(case when seen then member end, case when seen then ({_RANK}, member) end) as first, coalesce(string_agg(distinct known_type, ',' order by known_type) filter (seen), '') as kinds from m group by 1)
select anchor, case when p.confidence is distinct from 'low' then anchor else first end as pin, kinds from o join p on p.poi_key = anchor""",
    "k12_nearby": f"with {_LISTED} select * from li",
    "x15_nearby": f"""with {_LISTED}, {_WET}, dry as (select * from u where poi_key in (select anchor from li) and poi_key not in (select anchor from wet)), w as (select a.poi_key as anchor, min({warehouse._HAV}) as m from {_PAIR.format("dry", 0.0037, warehouse._HAV, 400)} group by 1)
select anchor, concat_ws('; ', nearby, case when m is not null then 'water ' || cast(greatest(round(m), 3) as integer) end) as nearby from li left join w using (anchor)""",
    "x11_synthetic_water": f"""with {_G}, {_P}, {_WET}, dry as (select * from u where known_type = 'shelter' and poi_key not in (select anchor from wet)), w as (select distinct a.poi_key as anchor from {_PAIR.format("dry", 0.0014, warehouse._HAV, 150)})
select 'synthetic:' || anchor as id, anchor, 'water' as poi_type, anchor not in (select anchor from g) as promoted from w""",
    "a39_unattributed": f"""with {_MARKS} select coalesce(sum("end" - "start"), 0.0) as miles, count(*) as runs from r where club is null""",
    "a40_stretch_index": f"""with {_MARKS} select coalesce(club, 'unattributed') as club, min("start") as "start", max("end") as "end", sum("end" - "start") as miles, count(*) as runs from r group by club""",
    "w38_timeline": f"""with {_MARKS} select row_number() over (order by "start") as place, club, "start", "end" from r""",
    "j37_club": f"""with {_MARKS}, {_C} select id, arg_min(club, "start") as club from c join r on club is not null and start_mile_marker >= "start" and start_mile_marker < "end" group by 1""",
    "a44_bounding_hike": f"""with {_T} select user_id, min(a) as "start", max(b) as "end", arg_min(trip, (a, trip)) as from_trip, arg_max(trip, (b, -trip)) as to_trip, min(day) as first_day, max(day) as last_day from t group by 1""",
    "a45_lacking": f"with {_P} select source from poi_sources where source not in (select source from p where known_type = 'viewpoint' and source is not null)",
    "w09_between": f"with {_BETWEEN} select user_id, round({_UP}, 3) as ascent from l group by 1 having count(level) > 0",
    "w17_pieces": f"""with {_T}, s as (select user_id, a, b from t), {_RUNS}, u as (select distinct user_id, 0.0::double as "start", 0.0::double as "end" from m union all select user_id, greatest("start", 0), least("end", 1000) from m where least("end", 1000) > greatest("start", 0)),
gap as (select user_id, "end" as "start", coalesce(lead("start") over (partition by user_id order by "start", "end"), 1000.0) as "end" from u)
select user_id, kind, a as "start", b as "end" from t union all select user_id, 'gap', "start", "end" from gap where "end" - "start" >= 0.2""",
    "w22_slice": f"""with {_N}, v as (select reporter_id as part, mile, min(id) as id from n where mile is not null and lat is not null group by 1, 2),
k as (select *, mile between 700 and 760 as ins, count(*) filter (mile between 700 and 760) over (partition by part) as c, lead(mile) over w as nx, lag(mile) over w as pv from v window w as (partition by part order by mile)),
s as (select part, id, mile from k where case when c >= 2 then ins when c = 1 then ins or coalesce(nx between 700 and 760, false) or coalesce(pv between 700 and 760, false) else coalesce(mile < 700 and nx > 760, false) or coalesce(mile > 760 and pv < 700, false) end)
select part, id, mile from (select *, count(*) over (partition by part) as k from s) where k >= 2""",
    "w32_carries": """with f as (select *, case when lag(event_type) over (partition by user_id order by ts, event_id) = 'purchase' or lag(event_type) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as b from events),
s as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as section from f) select user_id, cast(section as bigint) as section, arg_min(event_id, (ts, event_id)) as from_id, arg_max(event_id, (ts, event_id)) as to_id, count(distinct ts::date) as days, round(sum(value), 3) as miles from s group by 1, 2""",
    "k03_gaps_near": f"""with gaps as ({trail.SQL["w16_gaps"]}), x as (select *, greatest("start" - 500, 500 - "end", 0) as away from gaps where "end" - "start" <= 50) select user_id, "start", "end", away, row_number() over (partition by user_id order by away, "start") as place from x""",
    "k09_beyond": f"with {_N} select reporter_type, arg_min(poi_id, (mile, id)) as stop, min(mile) as mile from n where mile > 700 and mile <= 900 and poi_id is not null group by 1",
    "j48_nearest_stop": f"""with {_N}, {_C}, h as (select c.id, n.id as stop, round(abs(n.mile - start_mile_marker), 6) as away from c join n on start_mile_marker between n.mile - 0.5 and n.mile + 0.5 and n.poi_id is not null) select id, arg_max(stop, (-away, stop)) as stop, min(away) as away from h group by 1""",
    "k10_one_photo": f"""with {_N}, {_P} select poi_key, arg_min(id, (round(abs(lat - latitude) + abs(lon - longitude), 5), -epoch_us(observed_at), id)) as id from n join u on poi_key = poi_id where lat is not null group by 1""",
    "n09_sample_at": "select user_id, arg_min(event_id, (abs(event_id % 997 - 500), ts, event_id)) as event_id, min(abs(event_id % 997 - 500))::double as away from events group by 1",
    "n11_legs": f"""with {_BETWEEN}, x as (select user_id, (max(event_id % 997) - min(event_id % 997))::double as miles, {_UP} as up, {_DOWN} as down from l group by 1)
select user_id, miles, round(up, 3) as ascent, round(down, 3) as descent, round(miles * 1.609344 / 5.0 * 60.0 + up * 0.3048 / 600.0 * 60.0, 3) as minutes from x""",
    "n12_reached": f"""with {_E}, s as (select *, value * 1.609344 / 5.0 * 60.0 + greatest(coalesce(level, 0), 0) * 0.3048 / 600.0 * 60.0 as m from e), c as (select *, sum(value) over w as way, sum(m) over w as til from s window w as (partition by user_id order by ts, event_id))
select user_id, round(coalesce(min(case when til - m < 600 and til >= 600 then way - value + value * (600 - til + m) / m end), max(way)), 4) as mile from c group by 1""",
    "x28_lane_clusters": f"""with {_N}, r as (select reporter_id, coalesce(observation, 'none') as lane, mile, id from n where mile is not null), f as (select *, case when mile - lag(mile) over w <= 1.5 then 0 else 1 end as b from r window w as (partition by reporter_id, lane order by mile, id)),
i as (select *, sum(b) over (partition by reporter_id, lane order by mile, id rows unbounded preceding) as i from f) select reporter_id, lane, round((min(mile) + max(mile)) / 2, 4) as middle, count(*) as n from i group by reporter_id, lane, i""",
    "x29_group_figures": f"""with {_T}, s as (select user_id % 20 as team, a, b from t), {trail._merge("s", "team")}, x as (select team, sum("end" - "start") as miles from m group by 1) select team, count(distinct day) as days, min(day) as first_day, max(day) as last_day, any_value(miles) as miles from (select *, user_id % 20 as team from t) join x using (team) group by 1""",
    "x30_group_trips": f"with {_T} select trip, row_number() over (partition by user_id order by case when kind <> 'planned' then day end nulls last, trip) as place from t",
    "x31_ahead": f"with {_AHEAD} select id, way, round(ahead, 6) as ahead from h",
    "x32_lanes": f"with {_AHEAD} select way || case when hi - lo > 50 then ' broad' else ' specific' end as lane, arg_min(id, (ahead, id)) as id, round(min(ahead), 6) as ahead from h where ahead is not null group by 1",
    "x33_highlights": f"""with {_C}, s as (select id, least(start_mile_marker, end_mile_marker) as "start", greatest(start_mile_marker, end_mile_marker) as "end" from c) select *, row_number() over (order by "start", id) as place from s where "start" <= 900 and "end" >= 400""",
    "x34_ascents": "select l_orderkey, case when count(*) = count(*) filter (l_partkey % 9 <> 0) then sum(l_quantity) end as ascent, count(*) as legs from lineitem group by 1",
    "x35_on_ribbon": f"with {_N}, f as (select reporter_id, min(mile) as low from n where mile is not null group by 1) select reporter_id, count(*) as n, max(mile) as last from n join f using (reporter_id) where mile > low and mile <= low + 10 group by 1",
    "x36_drawn": "select kind, count(*) as n from (select distinct id, coalesce(observation, 'none') as kind from field_notes) group by 1",
    "x37_ticks": """with p as (select p_partkey, p_size::double as a, (p_size + floor(p_retailprice)::bigint % 40 + 1)::double as b from part), q as (select *, (b - a) / 6 as rough, pow(10, floor(log10((b - a) / 6))) as u from p),
s as (select *, case when rough <= u then u when rough <= u * 2 then u * 2 when rough <= u * 5 then u * 5 else u * 10 end as step from q) select p_partkey, round(unnest(generate_series(cast(ceil(a / step) as bigint), cast(floor(b / step + 1e-9) as bigint))) * step, 6) as tick from s""",
    "x38_zero_inserted": f"with {_DAYS} select user_id, trip, n + (n > 2)::int as n, date '2026-05-01' + cast(n + (n > 2)::int as integer) as date, kind from p union all select user_id, null, 3, date '2026-05-04', 'zero' from p where n = 2",
    "x39_day_removed": f"with {_DAYS}, o as (select *, coalesce(max(case when n = 3 then (kind <> 'walked')::int end) over (partition by user_id), 0) as gone from p), k as (select user_id, trip, n - (gone = 1 and n > 3)::int as n, kind from o where gone = 0 or n <> 3) select user_id, trip, n, date '2026-05-01' + cast(n as integer) as date, kind from k",
    "x41_walked_spans": f"""with {_T}, s as (select trip, kind, a, case when trip % 5 = 0 then a when trip % 2 = 0 then a - 3 else b end as b from t) select trip, least(a, b) as "start", greatest(a, b) as "end" from s where kind = 'walked' and a <> b""",
    "j42_located": f"with {_V}, {_C} select id, mile, round(metres, 1) as metres from {_near('select id, start_lat as lat, start_lon as lon from c where start_lat is not null and start_lon is not null')}",
    "j43_reprojected": f"""with {_V}, {_C}, s as {_near("select id, start_lat as lat, start_lon as lon from c where start_lat is not null and start_lon is not null")}, e as {_near("select id, end_lat as lat, end_lon as lon from c where end_lat is not null and end_lon is not null")}
select c.id, case when s.id is not null and e.id is not null then s.mile else start_mile_marker end as "start", case when s.id is not null and e.id is not null then e.mile else end_mile_marker end as "end", s.id is not null and e.id is not null as moved from c left join s on s.id = c.id left join e on e.id = c.id""",
    "x42_placed": f"""with {_V}, w as (select id, lat, lon, mile as stored from n where observation in ('closed', 'damaged')), s as {_near("select id, lat, lon from w where lat is not null and lon is not null")} select w.id, coalesce(s.mile, stored) as mile from w left join s on s.id = w.id where coalesce(s.mile, stored) is not null""",
    "j49_anchored": f"""with {_V}, {_C} select id, round(arg_min(start_mile_marker + round(vm * 2) / 2 - vm, (round(abs(start_mile_marker - vm), 6), vm)), 4) as mile from c join v on start_mile_marker between vm - 25 and vm + 25 group by 1""",
    "x43_dispute": f"""with {_P}, dd as ({conditions.SQL["a07_disputes"]}) select case when reported_missing is null then 'none' when reported_missing then 'missing' else 'answered' end as state, count(*) as n from p left join dd on poi_id = poi_key group by 1""",
    "dp3_via": f"""with recursive s0 as (select p_partkey // 40 as hk, (p_partkey % 40 * 5 + p_size % 5)::double as mile, max((p_size % 2 = 0)::int) = 1 as camp from part group by 1, 2), ends as (select distinct hk from s0), st as (select hk * 2 as hike, mile, camp from s0 where mile > 0 and mile < 100 union all select hk * 2, unnest([0.0, 100.0])::double, false from ends union all select hk * 2 + 1, mile, camp from s0 where mile > 100 and mile < 200 union all select hk * 2 + 1, unnest([100.0, 200.0])::double, false from ends), {lines._PLAN.format(target="14.0")}, pd as ({lines._PLANNED}) select hike // 2 as hike, cast(row_number() over (partition by hike // 2 order by hike, day) as integer) as day, from_mile, to_mile from pd""",
    "dp5_absorbed": f"""with recursive {_CAND}, st as (select * from k), {lines._EXACT.replace("20", "6").replace("[21]", "[7]").replace("range(1, 21)", "range(1, 7)")}, pd as ({lines._PLANNED}) select hike, count(*) as days, round(avg(to_mile - from_mile), 4) as average from pd group by 1""",
    "dp6_shifted": f"""with recursive {_CAND}, st as (select * from k), {lines._PLAN.format(target="14.0")}, pd as ({lines._PLANNED}) select hike, count(*) as days, count(*) - 6 as shift, cast(date '2026-05-10' + cast(count(*) - 6 as integer) as date) as finish from pd group by 1""",
    "dp4_candidates": f"with {_CAND} select * from k",
}
SQL["x40_choices"] = f"with a as ({SQL['dp5_absorbed']}), s as ({SQL['dp6_shifted']}) select s.hike, average, shift, finish from s left join a using (hike)"
