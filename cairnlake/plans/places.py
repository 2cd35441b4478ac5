"""Queries over the place tables: history, snapshot changes, quality profile, nearness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plain import POI_TYPES, known_type, plain, plain_source, plain_source_id, usable_position
from ..operators import history, nearby, profile, snapshots
from ..session import cut, table

WORDS = {"poi_type": POI_TYPES}
RANGES = {"latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0)}
RADIUS_M = 150.0

_SQL_SOURCE = "regexp_replace(lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')), '[- ]', '_', 'g')"
_SQL_SOURCE_ID = "lower(regexp_replace(regexp_replace(source_id, '[{}]', '', 'g'), '^\\s+|\\s+$', '', 'g'))"
_SQL_PLAIN = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"
_SQL_TYPE = _SQL_PLAIN.format("poi_type")
_SQL_WORDS = ", ".join(f"'{w}'" for w in POI_TYPES)


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "poi_snapshots").withColumn("poi_key", plain(F.col("poi_key")))


def current_places(spark: SparkSession, d: str) -> DataFrame:
    """One row per poi_key of dim_pois: the values of its latest load, with plain source, source id and known type."""
    df = table(spark, d, "dim_pois").withColumn("poi_key", plain(F.col("poi_key")))
    values = {c: F.col(c) for c in ("name", "confidence", "longitude", "latitude", "loaded_at")}
    values = {"source": plain_source(F.col("source")), "source_id": plain_source_id(F.col("source_id")), "known_type": known_type(F.col("poi_type"))} | values
    return history.latest_delivery(df, ["poi_key"], values, ["loaded_at"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    versions = history.attribute_history(_snapshots(spark, d), "poi_key", "load_no", {"poi_type": plain(F.col("poi_type"))}, ["loaded_at"])
    return versions.select("poi_key", F.col("first").alias("first_load"), F.col("last").alias("last_load"))


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions over two attributes, each with intervals of its own: type in plain form and source id as written."""
    versions = history.attribute_history(_snapshots(spark, d), "poi_key", "load_no", {"poi_type": plain(F.col("poi_type")), "source_id": F.col("source_id")}, ["loaded_at"])
    return versions.select("poi_key", "poi_type", "source_id", F.col("first").alias("first_load"), F.col("last").alias("last_load"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    places = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    water = places.where("known_type = 'water'").select("poi_key", "latitude", "longitude")
    camps = places.where("known_type in ('shelter', 'campsite')").select("poi_key", "latitude", "longitude")
    pairs = nearby.pairs_within(camps, water, "poi_key", "poi_key", "latitude", "longitude", RADIUS_M)
    return pairs.select(F.least("id_l", "id_r").alias("poi_key_a"), F.greatest("id_l", "id_r").alias("poi_key_b"))


def p4_nearest_water(spark: SparkSession, d: str) -> DataFrame:
    """The nearest water of every shelter and campsite within 400 m, rounded to decimetres."""
    places = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    water = places.where("known_type = 'water'").select("poi_key", "latitude", "longitude")
    camps = places.where("known_type in ('shelter', 'campsite')").select("poi_key", "latitude", "longitude")
    best = nearby.nearest_within(camps, water, "poi_key", "poi_key", "latitude", "longitude", 400.0)
    return best.select(F.col("id_l").alias("poi_key"), F.col("id_r").alias("water_key"), F.round("metres", 1).alias("metres"), "in_reach")


def p4_regions(spark: SparkSession, d: str) -> DataFrame:
    """Places by region: diamonds of two degrees over the corridor, exact point-in-polygon after the grid join."""
    places = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    x, y = F.col("cx"), F.col("cy")
    corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    regions = spark.range(-86, -65, 2).select(F.col("id").alias("cx")).crossJoin(spark.range(33, 49, 2).select(F.col("id").alias("cy")))  # 88 rows by construction
    regions = regions.select(F.format_string("r%d_%d", "cx", "cy").alias("region"), F.array(corner(-1, 0), corner(0, 1), corner(1, 0), corner(0, -1)).alias("ring"))
    inside = nearby.points_in_regions(places, regions, "poi_key", "region", "longitude", "latitude", "ring", 0.5)
    return inside.groupBy("region").agg(F.count(F.lit(1)).alias("n_places"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    keys = {"source": plain_source(F.col("source")), "source_id": plain_source_id(F.col("source_id"))}
    df = table(spark, d, "poi_snapshots").select("load_no", "loaded_at", "latitude", "longitude", *[c.alias(k) for k, c in keys.items()])
    return snapshots.snapshot_changes(df, {k: F.col(k) for k in keys}, "load_no", {"latitude": 1e-6, "longitude": 1e-6}, ["loaded_at"])


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each kind by load and source."""
    return p6_found(spark, d).groupBy("load_no", "source", "change_kind").agg(F.count(F.lit(1)).alias("n"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.quality_findings(table(spark, d, "poi_snapshots"), "load_no", "poi_key", WORDS, RANGES)


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "poi_snapshots").select(F.col("load_no").cast("int").alias("load_no"), *WORDS, *RANGES)
    return cut(profile.mask_dictionary(profile.cells(df, ["load_no"], WORDS, RANGES), "load_no"))


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every profiled column of every load: null share, masks, range, rule breaks and mask divergence from the load before."""
    counted = _profiled(spark, d)
    shares = profile.column_shares(counted, "load_no")
    moved = profile.mask_divergence(counted, "load_no")
    return shares.join(moved, ["load_no", "field"], "left").select("load_no", F.col("field").alias("field_name"), "n_rows", "n_null", "n_bad", "n_masks", "low", "high", F.round("null_share", 6).alias("null_share"), F.round("divergence", 6).alias("divergence"))


def p7_masks(spark: SparkSession, d: str) -> DataFrame:
    """The mined patterns of every column over all loads."""
    masks = profile.mined_masks(_profiled(spark, d), 0.05)
    return masks.select(F.col("field").alias("field_name"), "mask", "n", "n_bad", F.round("share", 6).alias("share"), "dominant")


QUERIES = {f.__name__: f for f in (p1_found, p1_versions, p4_found, p4_nearest_water, p4_regions, p6_found, p6_rates, p7_found, p7_profile, p7_masks)}

_LATEST = f"""latest as (
  select load_no, poi_key, poi_type, source, source_id, latitude, longitude from (
    select load_no, {_SQL_PLAIN.format("poi_key")} as poi_key, {_SQL_TYPE} as poi_type, {_SQL_SOURCE} as source, source_id, latitude, longitude,
      row_number() over (partition by load_no, {_SQL_PLAIN.format("poi_key")} order by loaded_at desc, {_SQL_TYPE} desc nulls last, source_id desc) as rn
    from poi_snapshots) where rn = 1)"""

_PLACES = f"""places as (
  select poi_key, t, latitude, longitude from (
    select {_SQL_PLAIN.format("poi_key")} as poi_key, {_SQL_TYPE} as t, latitude, longitude,
      row_number() over (partition by {_SQL_PLAIN.format("poi_key")} order by loaded_at desc) as rn from dim_pois)
  where rn = 1 and latitude between 33 and 48 and longitude between -86 and -66)"""

_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(power(sin((radians(w.latitude) - radians(c.latitude)) / 2), 2) + cos(radians(c.latitude)) * cos(radians(w.latitude)) * power(sin((radians(w.longitude) - radians(c.longitude)) / 2), 2))))"

_CHANGES = f"""snap as (
  select load_no, source, source_id, latitude, longitude from (
    select load_no, {_SQL_SOURCE} as source, {_SQL_SOURCE_ID} as source_id, latitude, longitude,
      row_number() over (partition by load_no, {_SQL_SOURCE}, {_SQL_SOURCE_ID} order by loaded_at desc, latitude desc nulls last, longitude desc nulls last) as rn
    from poi_snapshots) where rn = 1),
changes as (
  select coalesce(a.load_no, b.load_no + 1) as load_no, coalesce(a.source, b.source) as source, coalesce(a.source_id, b.source_id) as source_id,
    case when b.source is null then 'added' when a.source is null then 'removed' else 'changed' end as change_kind
  from snap a full outer join snap b on a.load_no = b.load_no + 1 and a.source = b.source and a.source_id = b.source_id
  where coalesce(a.load_no, b.load_no + 1) between (select min(load_no) + 1 from poi_snapshots) and (select max(load_no) from poi_snapshots)
    and (a.source is null or b.source is null or (a.latitude is null) <> (b.latitude is null) or (a.longitude is null) <> (b.longitude is null)
      or abs(a.latitude - b.latitude) > 0.000001 or abs(a.longitude - b.longitude) > 0.000001))"""

_CELLS = f"""cells as (
  select load_no, 'poi_type' as field_name, poi_type as v, null::double as x, coalesce(poi_type not in ({_SQL_WORDS}), false) as bad, lower(poi_key) as poi_key from poi_snapshots
  union all select load_no, 'latitude', latitude::varchar, latitude, coalesce(latitude < -90 or latitude > 90, false), lower(poi_key) from poi_snapshots
  union all select load_no, 'longitude', longitude::varchar, longitude, coalesce(longitude < -180 or longitude > 180, false), lower(poi_key) from poi_snapshots)"""

_MASKS = r"""masked as (
  select load_no, field_name, bad, x, case when v is null then null when field_name = 'poi_type' then
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '\p{Lu}', 'A', 'g'), '\p{Ll}', 'a', 'g'), '\p{N}', '9', 'g'), '\s', '_', 'g')
    else (case when x < 0 then '-' else '' end) || regexp_replace(cast(cast(floor(abs(x)) as bigint) as varchar), '[0-9]', '9', 'g') end as mask
  from cells)"""


def _islands(columns: str, changed: str) -> str:
    return f"""with {_LATEST}, flagged as (
  select *, case when lag(load_no) over w = load_no - 1 and {changed} then 0 else 1 end as new from latest window w as (partition by poi_key order by load_no)),
numbered as (select *, sum(new) over (partition by poi_key order by load_no) as run from flagged)
select poi_key, {columns} cast(min(load_no) as integer) as first_load, cast(max(load_no) as integer) as last_load from numbered group by poi_key, run"""


SQL = {
    "p1_found": _islands("", "poi_type is not distinct from lag(poi_type) over w"),
    "p1_versions": _islands("any_value(poi_type) as poi_type, any_value(source_id) as source_id,", "poi_type is not distinct from lag(poi_type) over w and source_id is not distinct from lag(source_id) over w"),
    "p4_found": f"""with {_PLACES} select least(w.poi_key, c.poi_key) as poi_key_a, greatest(w.poi_key, c.poi_key) as poi_key_b
from places w join places c on w.t = 'water' and c.t in ('shelter', 'campsite') and abs(w.latitude - c.latitude) < 0.0014 where {_HAV} <= 150""",
    "p4_nearest_water": f"""with {_PLACES}, pairs as (select c.poi_key, w.poi_key as water_key, {_HAV} as m from places w join places c on w.t = 'water' and c.t in ('shelter', 'campsite') and abs(w.latitude - c.latitude) < 0.0037 where {_HAV} <= 400)
select poi_key, water_key, round(m, 1) as metres, in_reach from (select *, count(*) over (partition by poi_key) as in_reach, row_number() over (partition by poi_key order by m, water_key) as rn from pairs) where rn = 1""",
    "p4_regions": f"""with {_PLACES}, r as (select x.v as cx, y.v as cy from (select unnest(range(-86, -65, 2)) as v) x, (select unnest(range(33, 49, 2)) as v) y)
select 'r' || cx || '_' || cy as region, count(*) as n_places from places join r on abs(longitude - cx) + abs(latitude - cy) < 1 group by 1""",
    "p6_found": f"with {_CHANGES} select cast(load_no as integer) as load_no, source, source_id, change_kind from changes",
    "p6_rates": f"with {_CHANGES} select cast(load_no as integer) as load_no, source, change_kind, count(*) as n from changes group by 1, 2, 3",
    "p7_found": f"""with {_CELLS}, shares as (select load_no, field_name, avg(case when v is null then 1.0 else 0.0 end) as s from cells group by 1, 2),
words as (select unnest([{_SQL_WORDS}]) as w), word_shares as (select load_no, w, sum(case when v = w then 1.0 else 0.0 end) / count(*) as s from cells, words where field_name = 'poi_type' and v is not null group by 1, 2)
select distinct cast(load_no as integer) as load_no, field_name, 'bad_value' as finding, poi_key from cells where bad
union select cast(a.load_no as integer), a.field_name, 'null_shift', '' from shares a join shares b on a.load_no = b.load_no + 1 and a.field_name = b.field_name and abs(a.s - b.s) > 0.10
union select cast(a.load_no as integer), 'poi_type', 'share_shift', '' from word_shares a join word_shares b on a.load_no = b.load_no + 1 and a.w = b.w and abs(a.s - b.s) > 0.10""",
    "p7_profile": f"""with {_CELLS}, {_MASKS}, per as (select load_no, field_name, mask, count(*) as n from masked where mask is not null group by 1, 2, 3),
tot as (select load_no, field_name, sum(n) as t from per group by 1, 2), loads as (select distinct load_no, field_name from tot), grid as (select l.load_no, m.field_name, m.mask from loads l join (select distinct field_name, mask from per) m using (field_name)),
sh as (select g.load_no, g.field_name, g.mask, coalesce(p.n, 0) / t.t as s from grid g join tot t using (load_no, field_name) left join per p using (load_no, field_name, mask)),
div as (select a.load_no, a.field_name, sum(abs(a.s - b.s)) / 2 as d from sh a join sh b on a.load_no = b.load_no + 1 and a.field_name = b.field_name and a.mask = b.mask group by 1, 2)
select cast(m.load_no as integer) as load_no, m.field_name, count(*) as n_rows, count(*) - count(m.mask) as n_null, cast(sum(m.bad::int) as bigint) as n_bad, count(distinct m.mask) as n_masks, min(m.x) as low, max(m.x) as high,
  round((count(*) - count(m.mask)) / count(*), 6) as null_share, round(any_value(div.d), 6) as divergence
from masked m left join div on div.load_no = m.load_no and div.field_name = m.field_name group by m.load_no, m.field_name""",
    "p7_masks": f"""with {_CELLS}, {_MASKS} select field_name, mask, count(*) as n, cast(sum(bad::int) as bigint) as n_bad, round(count(*) / sum(count(*)) over (partition by field_name), 6) as share, count(*) / sum(count(*)) over (partition by field_name) >= 0.05 as dominant from masked where mask is not null group by 1, 2""",
}
