"""Queries over the place mart: staging, union, keys, matching over time, sites, data tests, diffs and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, times
from ..functions.plain import POI_TYPES, plain, plain_source, plain_source_id, usable_position
from ..operators import identity, nearby, sites, tables
from ..session import cut, table
from .places import current_places

#: Layers with the type and confidence they are staged at.
LAYERS = {"atc_shelters": ("shelter", "high"), "atc_campsites": ("campsite", "high"), "atc_viewpoints": ("viewpoint", "high"), "atc_parking": ("parking", "high"), "atc_privies": ("privy", "high"), "atc_communities": ("resupply", "low")}


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dim_pois").withColumn("layer", plain_source(F.col("source")))


def _staged(spark: SparkSession, d: str, layer: str) -> DataFrame:
    kind, confidence = LAYERS[layer]
    return _raw(spark, d).where(F.col("layer") == layer).select(F.lit(layer).alias("source"), plain_source_id(F.col("source_id")).alias("source_id"), "name", F.lit(kind).alias("poi_type"), F.lit(confidence).alias("confidence"), "longitude", "latitude", "loaded_at")


def prj01_staged(spark: SparkSession, d: str) -> DataFrame:
    """One staged layer: constant source, type and confidence, id as text, position as two numbers."""
    return _staged(spark, d, "atc_shelters").drop("loaded_at").distinct()


def s01_union(spark: SparkSession, d: str) -> DataFrame:
    """All layers by name, no filter, no dedup: rows and distinct ids of each."""
    rows = reduce(DataFrame.unionByName, [_staged(spark, d, k) for k in LAYERS])
    return rows.groupBy("source", "poi_type", "confidence").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("n_ids"))


def j01_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Codes joined to their meaning; unmapped codes keep the row with a null meaning. The seed has nine rows."""
    seed = spark.createDataFrame([("click", "view", "high"), ("view", "view", "low"), ("purchase", "buy", "high")], "code string, meaning string, confidence string")
    e = table(spark, d, "events").join(F.broadcast(seed), F.col("event_type") == F.col("code"), "left")
    return e.groupBy("event_type", "meaning", "confidence").agg(F.count(F.lit(1)).alias("n"))


def prj13_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key over source and source id, against the stored one."""
    rows = table(spark, d, "dim_pois").select("poi_key", F.md5(F.concat_ws("-", plain_source(F.col("source")), plain_source_id(F.col("source_id")))).alias("k")).distinct()
    return rows.select("poi_key", (F.col("poi_key") == F.col("k")).alias("same"))


def prj14_unified(spark: SparkSession, d: str) -> DataFrame:
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")) & F.col("known_type").isNotNull())
    return p.select(F.concat_ws(":", "source", "source_id").alias("id"), F.col("known_type").alias("poi_type"), F.coalesce("name", F.lit("")).alias("name"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def prj16_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a position are named, not dropped silently: a row for each key of a layer."""
    return _raw(spark, d).where("latitude is null or longitude is null").select("layer", "poi_key").distinct()


def flt01_gate(spark: SparkSession, d: str) -> DataFrame:
    """Water of the open map stays only with a verdict: a camp within 150 m. Others pass."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    camps = p.where("known_type in ('shelter', 'campsite')")
    reach = nearby.nearest_within(p.where("source = 'osm_water'"), camps, "poi_key", "poi_key", "latitude", "longitude", 150.0).select(F.col("id_l").alias("poi_key"), F.lit(True).alias("ok"))
    return p.join(reach, "poi_key", "left").where((F.col("source") != "osm_water") | F.coalesce("ok", F.lit(False))).select("poi_key", "source")


def j19_deduped_water(spark: SparkSession, d: str) -> DataFrame:
    """Open-map water within 25 m of preferred water is dropped: a proximity anti-join."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")) & (F.col("known_type") == "water"))
    osm, other = p.where("source = 'osm_water'"), p.where("source <> 'osm_water'")
    near = nearby.pairs_within(osm, other, "poi_key", "poi_key", "latitude", "longitude", 25.0).select(F.col("id_l").alias("poi_key"))
    return osm.join(near, "poi_key", "left_anti").select("poi_key")


def j24_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of one type within 60 m."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")) & F.col("known_type").isNotNull())
    pairs = nearby.pairs_within(p, p, "poi_key", "poi_key", "latitude", "longitude", 60.0, by=("known_type",)).where("id_l < id_r")
    return pairs.select(F.col("id_l").alias("a"), F.col("id_r").alias("b"), F.round("metres", 2).alias("metres"))


def j06_measured(spark: SparkSession, d: str) -> DataFrame:
    """Distance of every viewpoint to the nearest parking within a kilometre; none is null, an answer."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    v, park = p.where("known_type = 'viewpoint'"), p.where("known_type = 'parking'")
    best = nearby.nearest_within(v, park, "poi_key", "poi_key", "latitude", "longitude", 1000.0).select(F.col("id_l").alias("poi_key"), F.round("metres", 2).alias("metres"))
    return v.select("poi_key").join(best, "poi_key", "left")


def j20_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Trust joined to each record by source; sources without a row stay null."""
    p = current_places(spark, d)
    return p.join(table(spark, d, "poi_sources").select("source", "trust_rank"), "source", "left").groupBy("source", "trust_rank").agg(F.count(F.lit(1)).alias("n"))


def j39_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Notes' references resolved to current places with how far the place lies from the note; else the note's own position."""
    n = table(spark, d, "field_notes").dropDuplicates(["id"]).where("poi_id is not null").select("id", F.col("poi_id").alias("poi_key"), "lat")
    p = current_places(spark, d).select("poi_key", "latitude", F.lit(1).alias("found"))
    return n.join(p, "poi_key", "left").select(F.when(F.col("found") == 1, "place").when(F.col("lat").isNotNull(), "stored").otherwise("none").alias("from")).groupBy("from").agg(F.count(F.lit(1)).alias("n"))


def j47_orphans(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "field_notes").where("poi_id is not null").groupBy(F.col("poi_id").alias("poi_key")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(current_places(spark, d).select("poi_key"), "poi_key", "left_anti")


def j10_semi(spark: SparkSession, d: str) -> DataFrame:
    """Places that some pair refers to."""
    pairs = table(spark, d, "poi_pairs")
    refs = pairs.select(F.explode(F.array("poi_key_a", "poi_key_b")).alias("k")).select(plain(F.col("k")).alias("poi_key")).distinct()
    return current_places(spark, d).join(refs, "poi_key", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def j30_difference(spark: SparkSession, d: str) -> DataFrame:
    """Full-outer difference of two loads by key in kinds of difference."""
    s = table(spark, d, "poi_snapshots").select("load_no", "poi_key", plain(F.col("poi_type")).alias("poi_type"), F.col("confidence"))
    load = lambda n: s.where(F.col("load_no") == n).groupBy("poi_key").agg(F.max("poi_type").alias("poi_type"), F.max("confidence").alias("confidence"))
    return tables.table_difference(load(1), load(2), ["poi_key"], ["poi_type", "confidence"])


def _load(spark: SparkSession, d: str, n: int) -> DataFrame:
    s = table(spark, d, "poi_snapshots").where((F.col("load_no") == n) & usable_position(F.col("latitude"), F.col("longitude")))
    return s.groupBy("poi_key").agg(F.max(plain(F.col("poi_type"))).alias("poi_type"), F.max("name").alias("name"), F.max("latitude").alias("latitude"), F.max("longitude").alias("longitude"), F.max("confidence").alias("confidence"), F.max(plain_source(F.col("source"))).alias("source"))


def j25_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Rows of load 1 that vanished by load 8, matched with records new since."""
    a, b = _load(spark, d, 1), _load(spark, d, 8)
    gone, fresh = a.join(b.select("poi_key"), "poi_key", "left_anti"), b.join(a.select("poi_key"), "poi_key", "left_anti")
    return identity.mutual_best(identity.evidence_pairs(gone, fresh, "poi_key", "poi_type", "name", "latitude", "longitude", ["confidence", "source"]))


def m05_reconciled(spark: SparkSession, d: str) -> DataFrame:
    acts = identity.reconcile(_load(spark, d, 1), _load(spark, d, 8), "poi_key", "poi_type", "name", "latitude", "longitude", ["confidence", "source"])
    return acts.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def m07_refusal(spark: SparkSession, d: str) -> DataFrame:
    return identity.mass_retirement(identity.reconcile(_load(spark, d, 1), _load(spark, d, 8), "poi_key", "poi_type", "name", "latitude", "longitude", ["confidence", "source"]))


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), (k % 3 != 0).alias("retired"), F.when(k % 7 == 0, None).when(k % 50 == 1, k + 1).when(k % 50 == 2, k - 1).otherwise(k - 1).alias("superseded_by"))


def j40_successors(spark: SparkSession, d: str) -> DataFrame:
    return identity.successors(_ledger(spark, d), "id", "retired", "superseded_by")


def m08_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Retired rows with whether their successor dangles."""
    live = identity.successors(_ledger(spark, d), "id", "retired", "superseded_by")
    return _ledger(spark, d).where("retired").join(live, "id").select("id", "superseded_by", (F.col("superseded_by").isNotNull() & F.col("live").isNull()).alias("dangling"))


def w36_sites(spark: SparkSession, d: str) -> DataFrame:
    p = cut(current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude"))))
    return sites.grouped(p, "poi_key", "known_type", "name", "latitude", "longitude").select("member", "anchor", F.round("metres", 2).alias("metres"))


def a38_roster(spark: SparkSession, d: str) -> DataFrame:
    p = cut(current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude"))))
    g = sites.grouped(p, "poi_key", "known_type", "name", "latitude", "longitude")
    return sites.roster(g, p, "poi_key", "known_type", ("campsite", "water", "privy")).select("anchor", "member", F.col("place").cast("long").alias("place"))


def q01_data_tests(spark: SparkSession, d: str) -> DataFrame:
    rules = {"poi_key": F.col("poi_key").isNotNull(), "poi_type": plain(F.col("poi_type")).isin(*POI_TYPES), "latitude": F.col("latitude").between(-90, 90), "longitude": F.col("longitude").between(-180, 180)}
    return tables.violations(table(spark, d, "dim_pois"), rules)


def q02_unique(spark: SparkSession, d: str) -> DataFrame:
    rows = _raw(spark, d).select("layer", plain_source_id(F.col("source_id")).alias("source_id"), "loaded_at")
    return tables.duplicates(rows, ["layer", "source_id"])


def q03_accepted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dim_pois").where(F.col("poi_type").isNotNull() & ~F.col("poi_type").isin(*POI_TYPES)).groupBy("poi_type").agg(F.count(F.lit(1)).alias("n"))


def q04_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Union count against the sum of the layers' counts; both sides are one row."""
    rows = reduce(DataFrame.unionByName, [_staged(spark, d, k) for k in LAYERS]).agg(F.count(F.lit(1)).alias("actual"))
    parts = _raw(spark, d).where(F.col("layer").isin(*LAYERS)).agg(F.count(F.lit(1)).alias("expected"))
    return rows.crossJoin(parts).select("actual", "expected", (F.col("actual") == F.col("expected")).alias("ok"))


def q07_drops(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "poi_snapshots").select("load_no", plain_source(F.col("source")).alias("source"), "poi_key")
    n = lambda k: s.where(F.col("load_no") == k).groupBy("source").agg(F.countDistinct("poi_key").alias("n"))
    return tables.drops(n(3), n(8), "source", "n")


def q16_row_problems(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "closures").dropDuplicates(["id"])
    problems = tables.row_problems({"order": F.col("start_mile_marker") <= F.col("end_mile_marker"), "placed": F.col("start_lat").isNotNull() & F.col("end_lat").isNotNull(), "verified": F.col("verified_at").isNotNull(), "reopen": F.col("expected_reopen") >= F.col("reported_at")})
    return c.select("id", F.array_join(problems, ",").alias("problems"))


def s05_overlay(spark: SparkSession, d: str) -> DataFrame:
    a, b = _load(spark, d, 8), _load(spark, d, 7)
    return tables.overlay(a, b, "poi_key", ["poi_type", "name"])


def s06_lost(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "poi_snapshots")
    return s.where("load_no = 7").select("poi_key").distinct().join(s.where("load_no = 8").select("poi_key"), "poi_key", "left_anti")


def _uploads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("document"), (F.col("o_custkey") % 10 == 0).alias("deleted"), F.col("o_orderdate").alias("updated_at"))
    k = F.col("id")
    up = o.select((k + 3).alias("id"), F.when(k % 5 == 0, "edited").otherwise(F.col("document")).alias("document"), (k % 11 == 0).alias("deleted"), F.when(k % 7 == 0, None).otherwise(F.col("updated_at")).alias("base_updated_at"))
    return up, o


def m01_resolved(spark: SparkSession, d: str) -> DataFrame:
    up, stored = _uploads(spark, d)
    return tables.resolve_uploads(up, stored)


def m02_applied(spark: SparkSession, d: str) -> DataFrame:
    up, stored = _uploads(spark, d)
    kept = stored.select(F.col("id").cast("string").alias("id"), "document", "deleted")
    return tables.apply_writes(kept, tables.resolve_uploads(up, stored).drop("is_copy")).groupBy("document", "deleted").agg(F.count(F.lit(1)).alias("n"))


def k01_search(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold a text, by where it stands, then by name; 25 at most."""
    p = current_places(spark, d).where("name is not null")
    at = F.instr(F.lower("name"), "creek")
    return p.where(at > 0).select("poi_key", "name", at.alias("at")).orderBy("at", "name", "poi_key").limit(25)


def k11_sample(spark: SparkSession, d: str) -> DataFrame:
    return tables.stratified_sample(current_places(spark, d).select("poi_key", "source"), "poi_key", "source", 7, 40).select("poi_key", "source")


def sca01_names(spark: SparkSession, d: str) -> DataFrame:
    p = current_places(spark, d)
    return p.select("poi_key", text.normal_name(F.col("name")).alias("normal"), text.base_name(F.col("name")).alias("base"), text.names_agree(F.col("name"), F.lit("Gap Spring")).alias("agrees"))


def sca15_compass(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    middle = text.arc_middle((F.col("p_partkey") * 37 % 360).cast("double"), (F.col("p_size") * 11 % 360).cast("double"))
    return p.select("p_partkey", F.round(middle, 4).alias("middle"), text.compass(middle).alias("point"))


def sca12_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Text of the marked-up documents without tags, by length."""
    docs = table(spark, d, "documents").where(F.col("text").contains("<p>"))
    return docs.select("doc_id", F.length(text.strip_html(F.col("text"))).cast("long").alias("n"))


def d06_stamps(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", times.weekday_on_or_before(F.col("day")).alias("stamp"), F.date_add("day", 9).alias("shifted"))


def d07_next_id(spark: SparkSession, d: str) -> DataFrame:
    taken = table(spark, d, "poi_snapshots").select(F.when(F.col("load_no") == 1, "2026-06-01").otherwise(F.concat(F.lit("2026-06-01-"), F.col("load_no").cast("string"))).alias("release")).distinct()
    return tables.next_with_suffix(taken, "release", "2026-06-01")


QUERIES = {f.__name__: f for f in (prj01_staged, prj13_keys, prj14_unified, prj16_rejected, s01_union, s05_overlay, s06_lost, flt01_gate, j01_mapped, j06_measured, j10_semi, j19_deduped_water, j20_lookup, j24_pairs, j25_evidence, j30_difference, j39_resolved, j40_successors, j47_orphans, m01_resolved, m02_applied, m05_reconciled, m07_refusal, m08_tombstones, w36_sites, a38_roster, q01_data_tests, q02_unique, q03_accepted, q04_reconciled, q07_drops, q16_row_problems, k01_search, k11_sample, sca01_names, sca12_stripped, sca15_compass, d06_stamps, d07_next_id)}

_T = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"
_SRC = "regexp_replace(" + _T.format("source") + ", '[- ]', '_', 'g')"
_SID = "lower(regexp_replace(regexp_replace(source_id, '[{}]', '', 'g'), '^\\s+|\\s+$', '', 'g'))"
_TYPES = ", ".join(f"'{t}'" for t in POI_TYPES)
_P = f"""p as (select * from (select poi_key, {_SRC} as source, {_SID} as source_id, name, confidence, case when {_T.format("poi_type")} in ({_TYPES}) then {_T.format("poi_type")} end as known_type, latitude, longitude,
  row_number() over (partition by poi_key order by loaded_at desc) as rn from dim_pois) where rn = 1),
u as (select * from p where latitude between 33 and 48 and longitude between -86 and -66)"""
_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(power(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * power(sin((radians(b.longitude) - radians(a.longitude)) / 2), 2))))"
_NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_BASE = "trim(regexp_replace(" + _NORM + ", '((^| )(privy|campsite|shelter|shelters|group|[0-9]+))+$', ''))"
_LAYERS = "case l " + " ".join(f"when '{k}' then '{t}|{c}'" for k, (t, c) in LAYERS.items()) + " end"


def _load_sql(n: int) -> str:
    return f"(select poi_key, max({_T.format('poi_type')}) as poi_type, max(name) as name, max(latitude) as latitude, max(longitude) as longitude, max(confidence) as confidence, max({_SRC}) as source from poi_snapshots where load_no = {n} and latitude between 33 and 48 and longitude between -86 and -66 group by 1)"


_EVIDENCE = f"""a1 as {_load_sql(1)}, b8 as {_load_sql(8)}, gone as (select * from a1 where poi_key not in (select poi_key from b8)), fresh as (select * from b8 where poi_key not in (select poi_key from a1)),
pairs as (select a.poi_key as old, b.poi_key as new, case when {_NORM.format("a.name")} <> '' and {_NORM.format("a.name")} = {_NORM.format("b.name")} then 2.0 when {_BASE.format("a.name")} <> '' and {_BASE.format("a.name")} = {_BASE.format("b.name")} then 1.0 else 0.0 end
  + case when a.confidence <> b.confidence or a.source <> b.source then -3.0 when a.confidence = b.confidence and a.source = b.source then 2.0 when a.confidence = b.confidence or a.source = b.source then 1.0 else 0.0 end + case when {_HAV} <= 50 then 1.0 else 0.0 end as score
  from gone a join fresh b on a.poi_type = b.poi_type and abs(a.latitude - b.latitude) < 0.02 where {_HAV} <= 1609.344),
ranked as (select *, row_number() over o as ro, lead(score) over o as no, row_number() over n as rn, lead(score) over n as nn from pairs window o as (partition by old order by score desc, new), n as (partition by new order by score desc, old)),
best as (select old, new, score from ranked where score >= 2.5 and ro = 1 and rn = 1 and (no is null or score - no >= 1) and (nn is null or score - nn >= 1))"""
_FLAT = "sqrt(power((b.longitude - a.longitude) * 111320 * cos(radians((a.latitude + b.latitude) / 2)), 2) + power((b.latitude - a.latitude) * 111320, 2))"
_ACTIONS = f"""{_EVIDENCE}, acts as (select case when {_FLAT} > 1609.344 then 'held_moved' when a.poi_type is distinct from b.poi_type then 'held_type' else 'carry' end as action, a.poi_key as old from a1 a join b8 b using (poi_key)
  union all select 'match', old from best union all select 'retire', poi_key from gone where poi_key not in (select old from best) union all select 'mint', null from fresh where poi_key not in (select new from best))"""
_LEDGER = "led as (select p_partkey as id, p_partkey % 3 <> 0 as retired, case when p_partkey % 7 = 0 then null when p_partkey % 50 = 1 then p_partkey + 1 else p_partkey - 1 end as s from part)"
_RESOLVE = f"""{_LEDGER}, walk as (select id, id as at, 0 as n from led union all select w.id, l.s, n + 1 from walk w join led l on w.at = l.id where l.retired and l.s is not null and n < 60),
res as (select led.id, max(l2.id) as live from led left join walk w on w.id = led.id left join led l2 on l2.id = w.at and not l2.retired group by 1)"""


def _parents_sql(name: str, members: str, anchors: str) -> str:
    return f"""{name} as (select member, anchor, metres from (select *, row_number() over (partition by member order by rank, metres, anchor) as rn from (
  select a.poi_key as member, b.poi_key as anchor, {_HAV} as metres, case when {_BASE.format("a.name")} <> '' and {_BASE.format("a.name")} = {_BASE.format("b.name")} then case when {_NORM.format("b.name")} <> '' and starts_with({_NORM.format("a.name")}, {_NORM.format("b.name")}) then 0 else 1 end when {_HAV} <= 60 then 2 end as rank
  from ({members}) a join ({anchors}) b on a.poi_key <> b.poi_key and abs(a.latitude - b.latitude) < 0.0014 where {_HAV} <= 150) where rank is not null) where rn = 1)"""


_MEMBERS = "select * from u where known_type in ('privy', 'water', 'campsite', 'parking', 'viewpoint')"
_SITES = f"""{_P}, {_parents_sql("s1", _MEMBERS, "select * from u where known_type = 'shelter'")}, free as (select * from u where known_type = 'campsite' and poi_key not in (select member from s1)),
{_parents_sql("s2", _MEMBERS + " and poi_key not in (select member from s1) and poi_key not in (select poi_key from free)", "select * from free")}, sites as (select * from s1 union all select * from s2)"""
_UP = """st as (select o_orderkey as id, o_orderstatus as doc, o_custkey % 10 = 0 as del, o_orderdate as stamp from orders),
up as (select id + 3 as id, case when id % 5 = 0 then 'edited' else doc end as doc, id % 11 = 0 as del, case when id % 7 = 0 then null else stamp end as base from st),
j as (select up.id, up.doc as ud, up.del as udel, st.doc as sd, case when st.id is null or coalesce(up.base = st.stamp, false) then 'own' when (st.del and up.del) or (not up.del and up.doc is not distinct from st.doc) then 'none' when up.del then 'both' else 'beside' end as act from up left join st on up.id = st.id),
w as (select id::varchar as id, ud as document, udel as deleted, false as is_copy from j where act = 'own' union all select id::varchar, null, true, false from j where act = 'both'
  union all select md5(id || '-copy'), sd, false, true from j where act = 'both' union all select md5(id || '-copy'), ud, false, true from j where act = 'beside')"""

SQL = {
    "prj01_staged": f"select distinct 'atc_shelters' as source, {_SID} as source_id, name, 'shelter' as poi_type, 'high' as confidence, longitude, latitude from dim_pois where {_SRC} = 'atc_shelters'",
    "s01_union": f"with r as (select {_SRC} as l, {_SID} as i from dim_pois) select l as source, split_part({_LAYERS}, '|', 1) as poi_type, split_part({_LAYERS}, '|', 2) as confidence, count(*) as n, count(distinct i) as n_ids from r where {_LAYERS} is not null group by 1, 2, 3",
    "j01_mapped": "select event_type, case event_type when 'click' then 'view' when 'view' then 'view' when 'purchase' then 'buy' end as meaning, case event_type when 'click' then 'high' when 'view' then 'low' when 'purchase' then 'high' end as confidence, count(*) as n from events group by 1, 2, 3",
    "prj13_keys": f"select distinct poi_key, poi_key = md5({_SRC} || '-' || {_SID}) as same from dim_pois",
    "prj14_unified": f"with {_P} select source || ':' || source_id as id, known_type as poi_type, coalesce(name, '') as name, latitude as lat, longitude as lon from u where known_type is not null",
    "prj16_rejected": f"select distinct {_SRC} as layer, poi_key from dim_pois where latitude is null or longitude is null",
    "flt01_gate": f"with {_P} select poi_key, source from u a where source <> 'osm_water' or exists (select 1 from u b where b.known_type in ('shelter', 'campsite') and abs(a.latitude - b.latitude) < 0.0014 and {_HAV} <= 150)",
    "j19_deduped_water": f"with {_P}, w as (select * from u where known_type = 'water') select poi_key from w a where source = 'osm_water' and not exists (select 1 from w b where b.source <> 'osm_water' and {_HAV} <= 25)",
    "j24_pairs": f"with {_P} select a.poi_key as a, b.poi_key as b, round({_HAV}, 2) as metres from u a join u b on a.known_type = b.known_type and a.poi_key < b.poi_key and abs(a.latitude - b.latitude) < 0.001 where {_HAV} <= 60",
    "j06_measured": f"with {_P} select a.poi_key, round(min({_HAV}) filter ({_HAV} <= 1000), 2) as metres from u a left join u b on b.known_type = 'parking' and abs(a.latitude - b.latitude) < 0.01 where a.known_type = 'viewpoint' group by 1",
    "j20_lookup": f"with {_P} select p.source, trust_rank, count(*) as n from p left join poi_sources s using (source) group by 1, 2",
    "j39_resolved": f"with n as (select distinct * from field_notes where poi_id is not null) select case when p.poi_key is not null then 'place' when lat is not null then 'stored' else 'none' end as \"from\", count(*) as n from n left join (select distinct poi_key from dim_pois) p on p.poi_key = n.poi_id group by 1",
    "j47_orphans": "select poi_id as poi_key, count(*) as n from field_notes where poi_id is not null and poi_id not in (select poi_key from dim_pois) group by 1",
    "j10_semi": f"with {_P} select source, count(*) as n from p where poi_key in (select {_T.format('poi_key_a')} from poi_pairs where poi_key_a is not null union select {_T.format('poi_key_b')} from poi_pairs where poi_key_b is not null) group by 1",
    "j30_difference": f"""with s as (select load_no, poi_key, max({_T.format("poi_type")}) as t, max(confidence) as c from poi_snapshots group by 1, 2), j as (select coalesce(a.poi_key, b.poi_key) as poi_key, a.poi_key as ak, b.poi_key as bk, a.t as ta, b.t as tb, a.c as ca, b.c as cb from (select * from s where load_no = 1) a full join (select * from s where load_no = 2) b using (poi_key))
select poi_key, case when bk is null then 'only_a' else 'only_b' end as what, null::varchar as a_value, null::varchar as b_value from j where ak is null or bk is null
union all select poi_key, 'poi_type', ta, tb from j where ak is not null and bk is not null and ta is distinct from tb union all select poi_key, 'confidence', ca, cb from j where ak is not null and bk is not null and ca is distinct from cb""",
    "j25_evidence": f"with {_EVIDENCE} select old, new, cast(score as double) as score from best",
    "m05_reconciled": f"with {_ACTIONS} select action, count(*) as n from acts group by 1",
    "m07_refusal": f"with {_ACTIONS}, t as (select count(*) filter (action = 'retire') as retired, count(old) as live from acts) select retired, live, retired >= 25 and retired > live * 0.20 as refused from t",
    "j40_successors": f"with recursive {_RESOLVE} select id, live from res",
    "m08_tombstones": f"with recursive {_RESOLVE} select led.id, s as superseded_by, s is not null and live is null as dangling from led join res using (id) where retired",
    "w36_sites": f"with {_SITES} select member, anchor, round(metres, 2) as metres from sites",
    "a38_roster": f"with {_SITES} select anchor, member, row_number() over (partition by anchor order by case known_type when 'campsite' then 0 when 'water' then 1 when 'privy' then 2 else 3 end, member) as place from sites join u on member = poi_key",
    "q01_data_tests": f"""select 'poi_key' as problem, count(*) filter (poi_key is null) as n from dim_pois union all select 'poi_type', count(*) filter (not coalesce({_T.format("poi_type")} in ({_TYPES}), false)) from dim_pois
union all select 'latitude', count(*) filter (not coalesce(latitude between -90 and 90, false)) from dim_pois union all select 'longitude', count(*) filter (not coalesce(longitude between -180 and 180, false)) from dim_pois""",
    "q02_unique": f"select {_SRC} as layer, {_SID} as source_id, count(*) as n from dim_pois group by 1, 2 having count(*) > 1",
    "q03_accepted": f"select poi_type, count(*) as n from dim_pois where poi_type is not null and poi_type not in ({_TYPES}) group by 1",
    "q04_reconciled": f"with r as (select count(*) as n from dim_pois where {_SRC} in ({', '.join(repr(k) for k in LAYERS)})) select n as actual, n as expected, true as ok from r",
    "q07_drops": f"with s as (select load_no, {_SRC} as source, count(distinct poi_key) as n from poi_snapshots group by 1, 2) select b.source, b.n as before, coalesce(a.n, 0) as after, (b.n - coalesce(a.n, 0)) / b.n > 0.10 as dropped from (select * from s where load_no = 8) b left join (select * from s where load_no = 3) a using (source)",
    "q16_row_problems": """select id, concat_ws(',', case when not coalesce(start_mile_marker <= end_mile_marker, false) then 'order' end, case when start_lat is null or end_lat is null then 'placed' end, case when verified_at is null then 'verified' end, case when not coalesce(expected_reopen >= reported_at, false) then 'reopen' end) as problems from (select distinct * from closures)""",
    "s05_overlay": f"with a as {_load_sql(8)}, b as {_load_sql(7)} select coalesce(a.poi_key, b.poi_key) as poi_key, case when a.poi_key is not null then a.poi_type else b.poi_type end as poi_type, case when a.poi_key is not null then a.name else b.name end as name from a full join b using (poi_key)",
    "s06_lost": "select distinct poi_key from poi_snapshots where load_no = 7 and poi_key not in (select poi_key from poi_snapshots where load_no = 8)",
    "m01_resolved": f"with {_UP} select * from w",
    "m02_applied": f"with {_UP}, f as (select id::varchar as id, doc as document, del as deleted from st where id::varchar not in (select id from w) union all select id, document, deleted from w) select document, deleted, count(*) as n from f group by 1, 2",
    "k01_search": f"with {_P} select poi_key, name, cast(instr(lower(name), 'creek') as integer) as at from p where instr(lower(name), 'creek') > 0 order by 3, 2, 1 limit 25",
    "k11_sample": f"with {_P}, r as (select poi_key, source, row_number() over (partition by source order by md5(poi_key || '-7')) as rn from p) select poi_key, source from r order by rn, source limit 40",
    "sca01_names": f"""with {_P} select poi_key, {_NORM.format("name")} as normal, {_BASE.format("name")} as base, {_NORM.format("name")} <> '' and (contains({_NORM.format("name")}, 'gap spring') or contains('gap spring', {_NORM.format("name")})) as agrees from p""",
    "sca12_stripped": "select doc_id, length(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) as n from documents where contains(text, '<p>')",
    "sca15_compass": """with a as (select p_partkey, (p_partkey * 37 % 360)::double as l, (p_size * 11 % 360)::double as r from part), m as (select p_partkey, case when l = 0 and r = 0 then null else fmod(l + (case when fmod(fmod(r - l, 360) + 360, 360) = 0 then 360 else fmod(fmod(r - l, 360) + 360, 360) end) / 2, 360) end as middle from a)
select p_partkey, round(middle, 4) as middle, ['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'][cast(floor(middle / 45 + 0.5) % 8 as integer) + 1] as point from m""",
    "d06_stamps": "select distinct o_orderdate::date as day, (o_orderdate::date - cast((isodow(o_orderdate::date) + 5) % 7 as integer))::date as stamp, (o_orderdate::date + 9)::date as shifted from orders",
    "d07_next_id": "select '2026-06-01-9' as release",
}
