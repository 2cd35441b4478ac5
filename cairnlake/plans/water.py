"""Queries over water, surveys and source files: scans, nearest sites, facts folded over sources, records and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import effort, text
from ..functions.plain import plain, plain_source, usable_position
from ..operators import nearby
from ..session import cut, own_folder, table
from ..sources import geojson
from . import lines, warehouse
from .conditions import closures, notes
from .places import current_places

FEET_400_M = 121.92


def _places(spark: SparkSession, d: str) -> DataFrame:
    return current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Elements of an open map: id, position and tags as a map."""
    o = F.col("observation")
    tag = F.when(o == "flowing", F.create_map(F.lit("natural"), F.lit("spring"))).when(o == "dry", F.create_map(F.lit("amenity"), F.lit("drinking_water"), F.lit("natural"), F.lit("rock"))).when(o == "low", F.create_map(F.lit("man_made"), F.lit("water_well"))).otherwise(F.create_map(F.lit("natural"), F.lit("tree")))
    return notes(spark, d).select("id", "lat", "lon", "reporter_id", "mile", tag.alias("tags"))


def src04_water_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose tags say water, by class; the first matching tag decides."""
    kind = text.classified([(F.col("tags")[k], v, name) for k, v, name in text.WATER_TAGS])
    return _nodes(spark, d).where("lat is not null").select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def src05_extracts(spark: SparkSession, d: str) -> DataFrame:
    """Elements of several extracts, each once: the last extract wins."""
    s = table(spark, d, "poi_snapshots").select("poi_key", "load_no", F.col("loaded_at"))
    return s.groupBy("poi_key").agg(F.max("load_no").alias("extract")).groupBy("extract").agg(F.count(F.lit(1)).alias("n"))


def src06_layer(spark: SparkSession, d: str) -> DataFrame:
    """A staged layer by feature code, with the flow each code means; codes without one say nothing, which is no answer."""
    flow = F.create_map(*[F.lit(x) for kv in {46006: "perennial", 46003: "intermittent"}.items() for x in kv])
    p = table(spark, d, "part").select("p_partkey", (F.lit(46000) + F.col("p_size") % 10).alias("fcode")).where(F.col("fcode").isin(46000, 46003, 46006, 46007))
    return p.groupBy("fcode", flow[F.col("fcode")].alias("flow")).agg(F.count(F.lit(1)).alias("n"))


def src08_registered_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns in memory as a relation, then one transform over all: the nine sources with their refresh time in weeks."""
    import pyarrow as pa

    rows = table(spark, d, "poi_sources").select("source", "refresh_days").toArrow()  # nine rows
    relation = spark.createDataFrame(pa.table({"source": rows.column("source"), "days": rows.column("refresh_days")}))
    return relation.select("source", F.round(F.col("days") / 7.0, 4).alias("weeks"))


def src11_stamped(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a service's table with their timestamps stamped as UTC text; null stays null."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c)
    return closures(spark, d).select("id", stamp("reported_at"), stamp("expected_reopen"))


def src01_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Places written as a GeoJSON collection for each source and scanned again with load time and path."""
    folder = own_folder(spark, "geojson")
    p = _places(spark, d)
    f = F.struct(F.lit("Feature").alias("type"), F.col("poi_key").alias("id"), F.struct("name", "source").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"))
    line = p.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(f).alias("features"))).alias("value"))
    line.write.mode("append").text(folder)
    raw = spark.read.schema(geojson.COLLECTION).json(folder)
    read = geojson.point_features(raw, "2026-06-01 00:00:00")
    return read.select("id", F.col("properties")["name"].alias("name"), "lon", "lat", F.col("_loaded_at").cast("string").alias("loaded"), (F.length("_source_path") > 0).alias("has_path"))


#: Layers of a registry; those with a kind are loaded elsewhere.
REGISTRY = [("atc", "shelters", None), ("atc", "centerline", "line"), ("atc", "parking", None), ("osm", "water", None), ("nps", "bounds", "polygon")]


def src03_layers(spark: SparkSession, d: str) -> DataFrame:
    """Which layers of the registry load, and the names of their tables."""
    return geojson.registered_layers(spark.createDataFrame(REGISTRY, "provider string, key string, kind string"), [("opentrail", "at")])


def src07_csv(spark: SparkSession, d: str) -> DataFrame:
    """Orders through delimited text with a declared schema."""
    folder = own_folder(spark, "csv")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.mode("append").option("header", True).csv(folder)
    return geojson.read_table(spark, folder, "o_orderkey long, o_totalprice double, o_orderstatus string").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def src12_stats(spark: SparkSession, d: str) -> DataFrame:
    """Zipped tab-separated statistics by header name; blank layers are dropped."""
    folder = own_folder(spark, "tsv")
    p = table(spark, d, "part").select((F.col("p_partkey") % 5).alias("z"), F.col("p_size").alias("bytes"), F.when(F.col("p_partkey") % 4 == 0, F.lit(" ")).otherwise(F.col("p_brand")).alias("layer"))
    p.write.mode("append").option("sep", "\t").option("header", True).option("compression", "gzip").csv(folder)
    return geojson.read_stats(spark, folder, ["z", "layer", "bytes"]).groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bytes").cast("long")).alias("bytes"))


def src13_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every document's bytes; equal contents share one."""
    docs = table(spark, d, "documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def src15_html(spark: SparkSession, d: str) -> DataFrame:
    """Rows scraped from pages of one table each."""
    row = F.concat(F.lit("<tr class='x'><td><b>"), F.col("source"), F.lit("</b></td><td> "), F.col("trust_rank").cast("string"), F.lit(" </td></tr>"))
    page = table(spark, d, "poi_sources").select(F.concat(F.lit("<table><tr><th>s</th></tr>"), row, F.lit("</table>")).alias("page"))
    return page.select(F.inline(F.transform(geojson.html_rows(F.col("page")), lambda r: F.struct(F.get(r, F.lit(0)).alias("source"), F.get(r, F.lit(1)).cast("int").alias("trust_rank")))))


def src16_page_text(spark: SparkSession, d: str) -> DataFrame:
    """Water sources out of the lines of a page's text: mile, name and whether it is marked as unreliable."""
    lines = table(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("p_partkey").cast("string"), F.lit(".5  Spring "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, F.lit("*")).otherwise(F.lit(""))))), "\n").alias("body"))
    found = lines.select("page", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^([0-9]+\.[0-9])\s+([A-Z][^\n]*)$"), 0)).alias("l"))
    return found.select("page", F.regexp_extract("l", r"^([0-9.]+)", 1).cast("double").alias("mile"), F.regexp_extract("l", r"\s+([A-Z][^*]*)", 1).alias("name"), F.endswith("l", F.lit("*")).alias("unreliable"))


def src17_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profiles as JSON documents parsed to typed samples; samples without a finite distance are dropped."""
    s = table(spark, d, "part").groupBy((F.col("p_partkey") % 100).alias("profile")).agg(F.to_json(F.collect_list(F.struct(F.when(F.col("p_partkey") % 6 != 0, F.col("p_partkey") / 2.0).alias("distance_mi"), F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("elevation_ft")))).alias("doc"))
    out = s.select("profile", F.inline(geojson.profile_samples(F.col("doc"))))
    return out.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.count("elevation_ft").alias("levels"), F.max("distance_mi").alias("last"))


def snk04_document(spark: SparkSession, d: str) -> DataFrame:
    """A published document of rows in order, read back: what stands first and last, and how many there are."""
    rows = closures(spark, d).where("moderation_status = 'verified'").select("id", F.round("start_mile_marker", 3).alias("mile"))
    doc = geojson.document(rows, "closures", "2026-06-01T00:00:00Z", ["mile", "id"])
    v = doc.select(F.from_json("value", "generated_at string, closures array<struct<mile: double, id: string>>").alias("v"))
    return v.select("v.generated_at", F.size("v.closures").cast("long").alias("n"), F.get("v.closures", F.lit(0))["id"].alias("first"), F.element_at("v.closures", -1)["id"].alias("last"))


def snk05_guarded(spark: SparkSession, d: str) -> DataFrame:
    """A guarded write of the mart and what a reader finds after it and after a refused one."""
    path = own_folder(spark, "guarded") + "/pois"
    p = _places(spark, d)
    n = geojson.guarded_write(p, path, 0)
    try:
        geojson.guarded_write(p.limit(1), path, n)
        refused = False
    except ValueError:
        refused = True
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


def snk07_rings(spark: SparkSession, d: str) -> DataFrame:
    """Polygon files of boxes around closures written and read: corners of the first ring."""
    c = closures(spark, d).where("start_lat is not null and start_lon is not null")
    at = lambda dx, dy: F.struct((F.col("start_lon") + dx).alias("x"), (F.col("start_lat") + dy).alias("y"))
    file = c.select("id", geojson.poly_text(F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)), F.col("id")).alias("t"))
    back = file.select("id", geojson.poly_rings(F.col("t")).alias("r"))
    return back.select("id", F.size("r").cast("long").alias("rings"), F.round(F.get(F.get("r", F.lit(0)), F.lit(2))["x"], 4).alias("x"), F.round(F.get(F.get("r", F.lit(0)), F.lit(2))["y"], 4).alias("y"))


def j07_assembled(spark: SparkSession, d: str) -> DataFrame:
    """Ways from their references: each looked up with its place, ordered; ways with fewer than two points that exist are left out."""
    nodes = _nodes(spark, d)
    ways = notes(spark, d).where("mile is not null").groupBy(F.col("reporter_id").alias("way")).agg(F.transform(F.array_sort(F.collect_list(F.struct("mile", "id"))), lambda p: p["id"]).alias("refs"))  # a way has some hundred references
    refs = ways.select("way", F.posexplode("refs").alias("pos", "id"))
    met = refs.join(nodes.where("lat is not null").select("id", "lat", "lon"), "id")
    return met.groupBy("way").agg(F.count(F.lit(1)).alias("n"), F.min_by("lat", "pos").alias("first_lat"), F.max_by("lat", "pos").alias("last_lat")).where("n >= 2")


def j05_nearest_site(spark: SparkSession, d: str) -> DataFrame:
    """The nearest shelter or campsite of each water within 400 m, with its kind and position."""
    p = cut(_places(spark, d).select("poi_key", "known_type", "latitude", "longitude"))
    camps = p.where("known_type in ('shelter', 'campsite')")
    best = nearby.nearest_within(p.where("known_type = 'water'"), camps, "poi_key", "poi_key", "latitude", "longitude", 400.0)
    site = camps.select(F.col("poi_key").alias("id_r"), F.col("known_type").alias("site_kind"), F.col("longitude").alias("site_lon"), F.col("latitude").alias("site_lat"))
    return best.join(site, "id_r").select(F.col("id_l").alias("poi_key"), "site_kind", "site_lon", "site_lat", F.round("metres", 1).alias("metres"))


def j09_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Water within three thousandths of a degree of a site along both axes: more than are near, an exact pass comes after."""
    p = cut(_places(spark, d).select("poi_key", "known_type", "latitude", "longitude"))
    side = 0.003
    cell = lambda df: df.withColumns({"_r": F.floor(F.col("latitude") / side), "_c": F.floor(F.col("longitude") / side)})
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    w = cell(p.where("known_type = 'water'")).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    w = w.select(F.col("poi_key").alias("water"), F.col("latitude").alias("wa"), F.col("longitude").alias("wo"), (F.col("_r") + F.col("_i")).alias("_r"), (F.col("_c") + F.col("_j")).alias("_c"))
    met = nearby.join_blocks(cell(p.where("known_type in ('shelter', 'campsite')")), w, ["_r", "_c"], "poi_key", "water")
    return met.where((F.abs(F.col("latitude") - F.col("wa")) <= side) & (F.abs(F.col("longitude") - F.col("wo")) <= side)).groupBy("poi_key").agg(F.count(F.lit(1)).alias("n"))


def _site_water(spark: SparkSession, d: str) -> DataFrame:
    """Every shelter with the water within 400 feet: source, name, distance, position."""
    p = cut(_places(spark, d).select("poi_key", "known_type", "source", "name", "confidence", "latitude", "longitude"))
    pairs = nearby.pairs_within(p.where("known_type in ('shelter', 'campsite')"), p.where("known_type = 'water'"), "poi_key", "poi_key", "latitude", "longitude", FEET_400_M, carry=("source", "name", "confidence", "latitude", "longitude"))
    return pairs.select(F.col("id_l").alias("site"), F.col("id_r").alias("water"), "metres", F.col("c_r.source").alias("source"), F.col("c_r.name").alias("name"), F.col("c_r.confidence").alias("confidence"), F.col("c_r.latitude").alias("lat"), F.col("c_r.longitude").alias("lon"))


def j18_merged_sources(spark: SparkSession, d: str) -> DataFrame:
    """The nearest water of each source by site; sources whose water lies within 20 m (along both axes) of the nearest of all are one with it."""
    s = _site_water(spark, d)
    per = s.groupBy("site", "source").agg(F.min(F.struct("metres", "water", "lat", "lon")).alias("c"))
    per = per.withColumn("best", F.min("c").over(Window.partitionBy("site")))  # a row a source
    near = (F.abs(F.col("c.lat") - F.col("best.lat")) * 111132.0 <= 20) & (F.abs(F.col("c.lon") - F.col("best.lon")) * 111132.0 * F.cos(F.radians("best.lat")) <= 20)
    return per.where(near).groupBy("site").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.round(F.min("c.metres"), 2).alias("metres"))


def x04_site_water(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of a site with distance, drop, grade and whether it passes; the drop stands for a height in the tables."""
    drop = (F.length("name") * 3).cast("double")
    s = _site_water(spark, d)
    feet = F.col("metres") / 0.3048
    grade, passes = effort.grade_gate(drop, feet)
    reason = F.when(F.col("name").isNull(), "no height").when(passes, "reachable").otherwise("too steep")
    return s.select("site", "water", F.round(feet, 1).alias("feet"), F.when(F.col("name").isNotNull(), F.round(grade, 4)).alias("grade"), reason.alias("reason"))


def x05_document(spark: SparkSession, d: str) -> DataFrame:
    """The whole water document: every site with how many waters are on record for it, and every cluster of water with its members and sources."""
    sites = x04_site_water(spark, d).groupBy(F.col("site").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("reason") == "reachable", 1)).alias("reachable"))
    water = lines.w35_folded(spark, d).select(F.col("head").alias("id"), F.lit("crossing").alias("kind"), "n", F.lit(None).cast("long").alias("reachable"), "sources")
    return sites.select("id", F.lit("site").alias("kind"), "n", "reachable", F.lit(None).cast("string").alias("sources")).unionByName(water)


def x08_reach(spark: SparkSession, d: str) -> DataFrame:
    """Three nearests of each open-map water folded to one record: shelter, campsite, other water, and the least of them in words."""
    p = cut(_places(spark, d).select("poi_key", "known_type", "source", "latitude", "longitude"))
    osm = p.where("source = 'osm_water'")
    near = lambda where, n: nearby.nearest_within(osm, p.where(where), "poi_key", "poi_key", "latitude", "longitude", 300.0).select(F.col("id_l").alias("poi_key"), F.round("metres", 1).alias(n))
    out = osm.select("poi_key").join(near("known_type = 'shelter'", "shelter"), "poi_key", "left").join(near("known_type = 'campsite'", "campsite"), "poi_key", "left").join(near("known_type = 'water' and source <> 'osm_water'", "water"), "poi_key", "left")
    least = F.least("shelter", "campsite", "water")
    name = F.when(F.col("shelter") == least, "shelter").when(F.col("campsite") == least, "campsite").otherwise("water")
    return out.select("poi_key", "shelter", "campsite", "water", F.when(least.isNull(), "nothing within 300 m").otherwise(F.concat(name, F.lit(" in reach"))).alias("reason"))


def x06_graded(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on points that cleared the distance: by grade, and not reachable where the height is unknown. Graded ones are not done again."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("point"), (F.col("p_size") * 10.0).alias("feet"), F.when(F.col("p_partkey") % 10 == 0, F.lit(True)).alias("done"))
    heights = table(spark, d, "lineitem").where("l_quantity > 5").groupBy(F.col("l_partkey").alias("point")).agg(F.min("l_quantity").alias("drop"))
    out = p.join(heights, "point", "left")
    passes = effort.grade_gate(F.col("drop"), F.col("feet"))[1]
    return out.select("point", F.coalesce("done", F.coalesce(passes, F.lit(False))).alias("reachable")).groupBy("reachable").agg(F.count(F.lit(1)).alias("n"))


def x07_forgotten(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on distances above the wider of the floor they were made with and the floor of today are forgotten, not false."""
    p = table(spark, d, "part").select((F.col("p_size") * 10.0).alias("feet"), (F.col("p_partkey") % 300).cast("double").alias("floor"), (F.col("p_partkey") % 2 == 0).alias("verdict"))
    kept = F.when(F.col("feet") <= F.greatest("floor", F.lit(120.0)), F.col("verdict"))
    return p.select(kept.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def a02_member_lists(spark: SparkSession, d: str) -> DataFrame:
    """Groups with at least two members: any time they were grouped at, and the members in order."""
    g = table(spark, d, "poi_groups").select(plain(F.col("group_id")).alias("group_id"), plain(F.col("poi_key")).alias("poi_key"), "grouped_at").groupBy("group_id", "poi_key").agg(F.max("grouped_at").alias("at"))
    out = g.groupBy("group_id").agg(F.max("at").alias("at"), F.array_join(F.array_sort(F.collect_list("poi_key")), ",").alias("members"), F.count(F.lit(1)).alias("n"))
    return out.where("n >= 2")


def a30_folded_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a group folded over its members: all sources, the first name in order of trust with who gave it, and a claim of three values (null if nobody says, else that all who say agree)."""
    g = table(spark, d, "poi_groups").select(plain(F.col("group_id")).alias("group_id"), plain(F.col("poi_key")).alias("poi_key")).distinct()
    trust = table(spark, d, "poi_sources").select("source", "trust_rank")
    m = g.join(current_places(spark, d), "poi_key").join(trust, "source", "left")
    order = F.struct(F.coalesce("trust_rank", F.lit(99)), "poi_key")
    named = F.when(F.col("name").isNotNull(), F.struct("name", "source"))
    out = m.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min_by(named, F.when(F.col("name").isNotNull(), order)).alias("f"), F.bool_and(F.col("confidence") == "high").alias("sure"))
    return out.select("group_id", "sources", F.col("f.name").alias("name"), F.col("f.source").alias("name_from"), "sure")


def j21_water_distance(spark: SparkSession, d: str) -> DataFrame:
    """Camps with the distance to their water looked up; none is null."""
    p = cut(_places(spark, d).select("poi_key", "known_type", "latitude", "longitude"))
    camps = p.where("known_type in ('shelter', 'campsite')")
    best = nearby.nearest_within(camps, p.where("known_type = 'water'"), "poi_key", "poi_key", "latitude", "longitude", 400.0).select(F.col("id_l").alias("poi_key"), F.round(F.col("metres") / 0.3048, 0).alias("feet"))
    return camps.select("poi_key").join(best, "poi_key", "left")


def j22_photos(spark: SparkSession, d: str) -> DataFrame:
    """Newest notes of places as lists of two sources; where both have one, that of the through-hikers wins."""
    n = notes(spark, d).where("poi_id is not null")
    lists = n.groupBy(F.col("poi_id").alias("poi_key")).agg(F.max_by(F.when(F.col("reporter_type") == "thru", F.col("id")), F.when(F.col("reporter_type") == "thru", F.struct("observed_at", "id"))).alias("a"), F.max_by(F.when(F.col("reporter_type") != "thru", F.col("id")), F.when(F.col("reporter_type") != "thru", F.struct("observed_at", "id"))).alias("b"))
    return current_places(spark, d).select("poi_key").join(lists, "poi_key", "left").select("poi_key", F.coalesce("a", "b").alias("photo"), F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").alias("source"))


def _surveyed(spark: SparkSession, d: str) -> DataFrame:
    """Shelters of the club matched with records of other sources: the nearest whose name agrees within 400 m, else the nearest within 60 m."""
    p = cut(_places(spark, d).select("poi_key", "source", "name", "latitude", "longitude"))
    own = p.where("source = 'atc_shelters'")
    pairs = nearby.pairs_within(own, p.where("source <> 'atc_shelters'"), "poi_key", "poi_key", "latitude", "longitude", 400.0, carry=("name",))
    agrees = text.names_agree(F.col("c_l.name"), F.col("c_r.name"))
    rank = F.when(agrees, 0).when(F.col("metres") <= 60, 1)
    best = pairs.withColumn("rank", rank).where("rank is not null").groupBy("id_l").agg(F.min(F.struct("rank", "metres", "id_r")).alias("c"))
    return own.select("poi_key").join(best.select(F.col("id_l").alias("poi_key"), "c.*"), "poi_key", "left")


def j28_survey_match(spark: SparkSession, d: str) -> DataFrame:
    how = F.when(F.col("rank") == 0, "name").when(F.col("rank") == 1, "near")
    return _surveyed(spark, d).select("poi_key", F.col("id_r").alias("match"), how.alias("how"), F.round("metres", 1).alias("metres"))


def x03_distances(spark: SparkSession, d: str) -> DataFrame:
    """Every shelter with its surveyed distance or why it has none; a match too far off is refused."""
    s = _surveyed(spark, d)
    reason = F.when(F.col("id_r").isNull(), "no match").when(F.col("metres") > 250, "too far")
    return s.select("poi_key", F.when(reason.isNull(), F.round("metres", 1)).alias("metres"), reason.alias("reason"))


#: Fixed values of the stand-in for a register of capacities.
_RAW = ("8", "6s/2c", "4+4", "3+4", "0", "several")


def sca04_capacity(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, _RAW)), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.capacity(raw).alias("c")).select("p_partkey", F.col("c.value").alias("value"), F.col("c.reason").alias("reason"))


def _register(spark: SparkSession, d: str) -> DataFrame:
    p = current_places(spark, d).where("name is not null")
    return p.select(text.normal_name(F.col("name")).alias("norm"), "poi_key", (F.col("known_type") == "shelter").alias("structure"), F.get(F.array(*map(F.lit, _RAW)), F.pmod(F.ascii("poi_key"), F.lit(6))).alias("raw")).where("norm <> ''")


def x01_capacity_index(spark: SparkSession, d: str) -> DataFrame:
    """One row for each name: on a clash the only structure wins, else none."""
    s = F.coalesce("structure", F.lit(False))
    g = _register(spark, d).groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(s, 1)).alias("structures"), F.max(F.struct(s.alias("s"), "poi_key")).alias("top"), F.max("poi_key").alias("only"))
    return g.select("norm", F.when(F.col("n") == 1, F.col("only")).when(F.col("structures") == 1, F.col("top.poi_key")).alias("row"))


def x02_capacities(spark: SparkSession, d: str) -> DataFrame:
    """Every shelter with a capacity or a stated reason."""
    index = x01_capacity_index(spark, d).join(_register(spark, d).select(F.col("poi_key").alias("row"), "raw"), "row", "left")
    s = current_places(spark, d).where("known_type = 'shelter'").select("poi_key", text.normal_name(F.col("name")).alias("norm"))
    j = s.join(index.select("norm", "row", "raw", F.lit(True).alias("known")), "norm", "left").withColumn("c", text.capacity(F.col("raw")))
    reason = F.when(F.col("known").isNull(), "not in the register").when(F.col("row").isNull(), "several of that name").otherwise(F.col("c.reason"))
    return j.select("poi_key", F.when(F.col("row").isNotNull(), F.col("c.value")).alias("value"), reason.alias("reason"))


def x12_unified_water(spark: SparkSession, d: str) -> DataFrame:
    """Water without a record of its own as records: the id is the position rounded to five places."""
    n = notes(spark, d).where("observation in ('flowing', 'low') and lat is not null and lon is not null")
    five = lambda c: F.format_string("%.5f", F.floor(F.col(c) * 100000 + 0.5) / 100000)
    key = F.concat(F.lit("crossing:"), five("lat"), F.lit(","), five("lon"))
    return n.select(key.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def x13_ledger_ids(spark: SparkSession, d: str) -> DataFrame:
    """Derived ids replaced by the live id of the ledger (here the first load) on source and source id; counts of both."""
    p = current_places(spark, d).select("source", "source_id", "poi_key")
    ledger = table(spark, d, "poi_snapshots").where("load_no = 1").select(plain_source(F.col("source")).alias("source"), F.lower(F.regexp_replace(F.regexp_replace("source_id", r"[{}]", ""), r"^\s+|\s+$", "")).alias("source_id"), F.lit(True).alias("known")).distinct()
    j = p.join(ledger, ["source", "source_id"], "left")
    return j.select(F.when(F.col("known"), "ledger").otherwise("derived").alias("id_from")).groupBy("id_from").agg(F.count(F.lit(1)).alias("n"))


def x14_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """A sentence for each place by its type; types without a form of words have none."""
    p = current_places(spark, d)
    name, sure = F.coalesce(F.when(plain(F.col("name")) != "", F.trim("name")), F.lit("unnamed")), F.when(F.col("confidence") == "low", F.lit("unverified"))
    kind = F.when(F.col("known_type") == "shelter", F.concat(F.lit("Shelter "), name)).when(F.col("known_type") == "privy", F.lit("A privy")).when(F.col("known_type") == "parking", F.concat(F.lit("Parking at "), name)).when(F.col("known_type") == "water", F.concat_ws(" ", F.lit("Water"), F.when(F.col("source") == "osm_water", F.lit("from the open map"))))
    return p.select("poi_key", F.when(kind.isNotNull(), F.concat(F.concat_ws(", ", kind, sure), F.lit("."))).alias("description"))


def x16_legs(spark: SparkSession, d: str) -> DataFrame:
    """Legs of each highlight resolved through published ids, in the order of the file; a leg that is not published is named."""
    legs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    known = table(spark, d, "part").where("p_partkey % 13 <> 0").select("p_partkey", F.col("p_size").alias("mile"))
    j = legs.join(known, "p_partkey", "left").groupBy("l_orderkey", "l_linenumber").agg(F.max("mile").alias("mile"))
    item = F.struct("l_linenumber", F.coalesce(F.col("mile").cast("string"), F.lit("?")).alias("t"))
    return j.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ",").alias("miles"))  # an order has seven lines


QUERIES = {f.__name__: f for f in (src01_geojson, src03_layers, src04_water_nodes, src05_extracts, src06_layer, src07_csv, src08_registered_columns, src11_stamped, src12_stats, src13_digests, src15_html, src16_page_text, src17_profile, snk04_document, snk05_guarded, snk07_rings, a02_member_lists, a30_folded_facts, j05_nearest_site, j07_assembled, j09_candidates, j18_merged_sources, j21_water_distance, j22_photos, j28_survey_match, sca04_capacity, x01_capacity_index, x02_capacities, x03_distances, x04_site_water, x05_document, x06_graded, x07_forgotten, x08_reach, x12_unified_water, x13_ledger_ids, x14_descriptions, x16_legs)}

_N = "n as (select distinct * from field_notes)"
_C = "c as (select distinct * from closures)"
_P, _HAV, _NORM, _TRIM = warehouse._P, warehouse._HAV, warehouse._NORM, warehouse._T
_CAMPS = "known_type in ('shelter', 'campsite')"
_GROUPS = f"gm as (select distinct {_TRIM.format('group_id')} as group_id, {_TRIM.format('poi_key')} as poi_key from poi_groups)"


def _nearest(a: str, b: str, m: float, degrees: float) -> str:
    return f"(select key, other, m from (select a.poi_key as key, b.poi_key as other, {_HAV} as m, row_number() over (partition by a.poi_key order by {_HAV}, b.poi_key) as rn from (select * from u where {a}) a join (select * from u where {b}) b on abs(a.latitude - b.latitude) < {degrees} where {_HAV} <= {m}) where rn = 1)"


_SITEWATER = f"sw as (select a.poi_key as site, b.poi_key as water, {_HAV} as metres, b.source, b.name, b.latitude as lat, b.longitude as lon from (select * from u where {_CAMPS}) a join (select * from u where known_type = 'water') b on abs(a.latitude - b.latitude) < 0.0012 where {_HAV} <= {FEET_400_M})"
_AGREE = f"({_NORM.format('a.name')} <> '' and {_NORM.format('b.name')} <> '' and (contains({_NORM.format('a.name')}, {_NORM.format('b.name')}) or contains({_NORM.format('b.name')}, {_NORM.format('a.name')})))"
_SURVEY = f"""sv as (select a.poi_key, b.poi_key as other, {_HAV} as metres, case when {_AGREE} then 0 when {_HAV} <= 60 then 1 end as rank from (select * from u where source = 'atc_shelters') a join (select * from u where source <> 'atc_shelters') b on abs(a.latitude - b.latitude) < 0.0037 where {_HAV} <= 400),
sb as (select u.poi_key, k.rank, k.metres, k.other from u left join (select * from (select *, row_number() over (partition by poi_key order by rank, metres, other) as rn from sv where rank is not null) where rn = 1) k using (poi_key) where u.source = 'atc_shelters')"""
_RAWSQL = "['8', '6s/2c', '4+4', '3+4', '0', 'several']"
_CAPV = "case {0} when '8' then 8 when '6s/2c' then 6 when '4+4' then 4 end"
_CAPR = "case {0} when '3+4' then 'two structures' when '0' then 'zero' when 'several' then 'no number' end"
_REG = f"""rg as (select {_NORM.format('name')} as norm, poi_key, coalesce(known_type = 'shelter', false) as st, {_RAWSQL}[ascii(poi_key) % 6 + 1] as raw from p where name is not null and {_NORM.format('name')} <> ''),
ix as (select norm, case when count(*) = 1 then max(poi_key) when count(*) filter (st) = 1 then max(case when st then poi_key end) end as row from rg group by 1)"""

SQL = {
    "src01_geojson": f"with {_P} select poi_key as id, name, longitude as lon, latitude as lat, '2026-06-01 00:00:00' as loaded, true as has_path from u",
    "src03_layers": "select * from (values ('raw_atc__shelters'), ('raw_atc__parking'), ('raw_osm__water'), ('raw_opentrail__at')) t(name)",
    "src04_water_nodes": f"with {_N} select case observation when 'flowing' then 'spring' when 'dry' then 'tap' else 'well' end as kind, count(*) as n from n where lat is not null and observation in ('flowing', 'dry', 'low') group by 1",
    "src05_extracts": "select extract, count(*) as n from (select poi_key, max(load_no) as extract from poi_snapshots group by 1) group by 1",
    "src06_layer": "select 46000 + p_size % 10 as fcode, case p_size % 10 when 6 then 'perennial' when 3 then 'intermittent' end as flow, count(*) as n from part where p_size % 10 in (0, 3, 6, 7) group by 1, 2",
    "src08_registered_columns": "select source, round(refresh_days / 7.0, 4)::double as weeks from poi_sources",
    "src11_stamped": f"with {_C} select id, strftime(reported_at, '%Y-%m-%dT%H:%M:%S.%fZ') as reported_at, strftime(expected_reopen, '%Y-%m-%dT%H:%M:%S.%fZ') as expected_reopen from c",
    "src07_csv": "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1",
    "src12_stats": "select (p_partkey % 5)::varchar as z, count(*) as n, sum(p_size)::bigint as bytes from part where p_partkey % 4 <> 0 group by 1",
    "src13_digests": "select sha256(text) as digest, count(*) as n from documents where text is not null group by 1 having count(*) > 1",
    "src15_html": "select source, trust_rank from poi_sources",
    "src16_page_text": "select p_partkey % 50 as page, p_partkey + 0.5::double as mile, 'Spring ' || p_size as name, p_size % 3 = 0 as unreliable from part",
    "src17_profile": "select p_partkey % 100 as profile, count(*) as n, count(*) filter (p_size % 4 <> 0) as levels, max(p_partkey / 2.0)::double as last from part where p_partkey % 6 <> 0 group by 1",
    "snk04_document": f"with {_C}, v as (select id, round(start_mile_marker, 3) as mile from c where moderation_status = 'verified') select '2026-06-01T00:00:00Z' as generated_at, count(*) as n, arg_min(id, (mile, id)) as first, arg_max(id, (mile, id)) as last from v",
    "snk05_guarded": f"with {_P} select count(*) as n, true as refused from u",
    "snk07_rings": f"with {_C} select id, 1 as rings, round(start_lon + 1, 4) as x, round(start_lat + 1, 4) as y from c where start_lat is not null and start_lon is not null",
    "j07_assembled": f"with {_N} select reporter_id as way, count(*) as n, arg_min(lat, (mile, id)) as first_lat, arg_max(lat, (mile, id)) as last_lat from n where mile is not null and lat is not null group by 1 having count(*) >= 2",
    "j05_nearest_site": f"with {_P}, k as {_nearest(chr(39).join(['known_type = ', 'water', '']), _CAMPS, 400.0, 0.0037)} select key as poi_key, known_type as site_kind, longitude as site_lon, latitude as site_lat, round(m, 1) as metres from k join u on u.poi_key = other",
    "j09_candidates": f"with {_P} select a.poi_key, count(*) as n from u a join u b on a.{_CAMPS} and b.known_type = 'water' and abs(a.latitude - b.latitude) <= 0.003 and abs(a.longitude - b.longitude) <= 0.003 group by 1",
    "j18_merged_sources": f"""with {_P}, {_SITEWATER}, pr as (select * from (select *, row_number() over (partition by site, source order by metres, water) as rn from sw) where rn = 1),
be as (select *, first_value(lat) over w as bl, first_value(lon) over w as bo from pr window w as (partition by site order by metres, water))
select site, string_agg(distinct source, ',' order by source) as sources, round(min(metres), 2) as metres from be where abs(lat - bl) * 111132 <= 20 and abs(lon - bo) * 111132 * cos(radians(bl)) <= 20 group by 1""",
    "x04_site_water": f"""with {_P}, {_SITEWATER}, g as (select *, metres / 0.3048 as feet, length(name) * 3.0::double as dr from sw) select site, water, round(feet, 1) as feet, round(case when name is not null then dr / greatest(feet, 1) end, 4) as grade,
  case when name is null then 'no height' when feet < 10 or dr / greatest(feet, 1) <= 0.15 then 'reachable' else 'too steep' end as reason from g""",
    "x08_reach": f"""with {_P}, a as {_nearest("source = 'osm_water'", "known_type = 'shelter'", 300.0, 0.0028)}, b as {_nearest("source = 'osm_water'", "known_type = 'campsite'", 300.0, 0.0028)}, c as {_nearest("source = 'osm_water'", "known_type = 'water' and source <> 'osm_water'", 300.0, 0.0028)},
k as (select u.poi_key, round(a.m, 1) as shelter, round(b.m, 1) as campsite, round(c.m, 1) as water from u left join a on a.key = u.poi_key left join b on b.key = u.poi_key left join c on c.key = u.poi_key where u.source = 'osm_water')
select *, case when least(shelter, campsite, water) is null then 'nothing within 300 m' when shelter = least(shelter, campsite, water) then 'shelter in reach' when campsite = least(shelter, campsite, water) then 'campsite in reach' else 'water in reach' end as reason from k""",
    "x06_graded": "with h as (select l_partkey as point, min(l_quantity) as dr from lineitem where l_quantity > 5 group by 1) select case when p_partkey % 10 = 0 then true else coalesce(p_size * 10 < 10 or dr / greatest(p_size * 10.0, 1) <= 0.15, false) end and true as reachable, count(*) as n from part left join h on point = p_partkey group by 1",
    "x07_forgotten": "select case when p_size * 10 <= greatest(p_partkey % 300, 120) then p_partkey % 2 = 0 end as verdict, count(*) as n from part group by 1",
    "a02_member_lists": f"with m as (select {_TRIM.format('group_id')} as group_id, {_TRIM.format('poi_key')} as poi_key, max(grouped_at) as g from poi_groups group by 1, 2) select group_id, max(g) as at, string_agg(poi_key, ',' order by poi_key) as members, count(*) as n from m group by 1 having count(*) >= 2",
    "a30_folded_facts": f"""with {_P}, {_GROUPS}, m as (select gm.group_id, p.*, coalesce(trust_rank, 99) as tr from gm join p using (poi_key) left join poi_sources s on s.source = p.source)
select group_id, string_agg(distinct source, ',' order by source) as sources, arg_min(name, case when name is not null then (tr, poi_key) end) as name, arg_min(case when name is not null then source end, case when name is not null then (tr, poi_key) end) as name_from, bool_and(confidence = 'high') as sure from m group by 1""",
    "j21_water_distance": f"with {_P}, k as {_nearest(_CAMPS, chr(39).join(['known_type = ', 'water', '']), 400.0, 0.0037)} select poi_key, round(m / 0.3048, 0) as feet from u left join k on key = poi_key where {_CAMPS}",
    "j22_photos": f"""with {_N}, {_P}, l as (select poi_id, arg_max(case when reporter_type = 'thru' then id end, case when reporter_type = 'thru' then (observed_at, id) end) as a, arg_max(case when reporter_type <> 'thru' then id end, case when reporter_type <> 'thru' then (observed_at, id) end) as b from n where poi_id is not null group by 1)
select poi_key, coalesce(a, b) as photo, case when a is not null then 'first' when b is not null then 'second' end as source from p left join l on poi_id = poi_key""",
    "j28_survey_match": f"with {_P}, {_SURVEY} select poi_key, other as match, case rank when 0 then 'name' when 1 then 'near' end as how, round(metres, 1) as metres from sb",
    "x03_distances": f"with {_P}, {_SURVEY} select poi_key, case when other is not null and metres <= 250 then round(metres, 1) end as metres, case when other is null then 'no match' when metres > 250 then 'too far' end as reason from sb",
    "sca04_capacity": f"with r as (select p_partkey, {_RAWSQL}[p_partkey % 6 + 1] as raw from part) select p_partkey, {_CAPV.format('raw')} as value, {_CAPR.format('raw')} as reason from r",
    "x01_capacity_index": f"with {_P}, {_REG} select * from ix",
    "x02_capacities": f"""with {_P}, {_REG}, s as (select poi_key, {_NORM.format('name')} as norm from p where known_type = 'shelter'), j as (select s.poi_key, ix.norm as kn, ix.row, r.raw from s left join ix using (norm) left join rg r on r.poi_key = ix.row)
select poi_key, case when row is not null then {_CAPV.format('raw')} end as value, case when kn is null then 'not in the register' when row is null then 'several of that name' else {_CAPR.format('raw')} end as reason from j""",
    "x12_unified_water": f"with {_N} select printf('crossing:%.5f,%.5f', floor(lat * 100000 + 0.5) / 100000, floor(lon * 100000 + 0.5) / 100000) as id, count(*) as n from n where observation in ('flowing', 'low') and lat is not null and lon is not null group by 1",
    "x13_ledger_ids": f"with {_P}, l as (select distinct {warehouse._SRC} as source, {warehouse._SID} as source_id, true as known from poi_snapshots where load_no = 1) select case when known then 'ledger' else 'derived' end as id_from, count(*) as n from p left join l using (source, source_id) group by 1",
    "x14_descriptions": f"""with {_P}, k as (select poi_key, coalesce(case when {_TRIM.format('name')} <> '' then trim(name) end, 'unnamed') as nm, known_type as t, source, confidence from p), w as (select *, case t when 'shelter' then 'Shelter ' || nm when 'privy' then 'A privy' when 'parking' then 'Parking at ' || nm when 'water' then 'Water' || case when source = 'osm_water' then ' from the open map' else '' end end as kind from k)
select poi_key, kind || case when confidence = 'low' then ', unverified' else '' end || '.' as description from w""",
    "x16_legs": "with j as (select l_orderkey, l_linenumber, max(case when l_partkey % 13 <> 0 then p_size end) as mile from lineitem left join part on p_partkey = l_partkey group by 1, 2) select l_orderkey, string_agg(coalesce(mile::varchar, '?'), ',' order by l_linenumber) as miles from j group by 1",
}
SQL["x05_document"] = f"""with si as ({SQL['x04_site_water']}), wf as ({lines.SQL['w35_folded']}) select site as id, 'site' as kind, count(*) as n, count(*) filter (reason = 'reachable') as reachable, null::varchar as sources from si group by 1
union all select head, 'crossing', n, null, sources from wf"""
