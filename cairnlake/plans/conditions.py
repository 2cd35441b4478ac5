"""Queries over field notes and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, times
from ..functions.plain import POI_TYPES, plain
from ..operators import notes as N
from ..session import table

NOW = "2026-10-15 00:00:00"
now = lambda: F.lit(NOW).cast("timestamp_ntz")


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Field notes without resent rows."""
    return table(spark, d, "field_notes").dropDuplicates(["id"])


def closures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "closures").dropDuplicates(["id"])


def _visible(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).where("hidden_at is null")


def w01_recent_notes(spark: SparkSession, d: str) -> DataFrame:
    """Five most recent notes a place in 90 days; a note without a place stands alone."""
    rows = _visible(spark, d).where(F.col("observed_at") >= now() - F.expr("interval 90 days"))
    return N.top_recent(rows, F.coalesce("poi_id", "id"), "observed_at", "id", 5).select("id", "poi_id", "observed_at", F.col("rank").cast("long").alias("rank"))


def a05_corroborated(spark: SparkSession, d: str) -> DataFrame:
    """Places that two accounts reported missing within 180 days and that nobody confirmed since (two accounts clear it)."""
    rows = _visible(spark, d).where(F.col("poi_id").isNotNull())
    bad = rows.where(F.col("observation").isin("not_found", "dry") & (F.col("observed_at") >= now() - F.expr("interval 180 days")))
    said = bad.groupBy("poi_id").agg(F.countDistinct("reporter_id").alias("accounts"), F.max("observed_at").alias("latest_at")).where("accounts >= 2")
    good = rows.where("observation is null or observation not in ('not_found', 'dry')").join(said.select("poi_id", "latest_at"), "poi_id").where("observed_at > latest_at")
    cleared = good.groupBy("poi_id").agg(F.countDistinct("reporter_id").alias("n")).where("n >= 2")
    return said.join(cleared, "poi_id", "left_anti")


def a07_disputes(spark: SparkSession, d: str) -> DataFrame:
    return N.disputes(_visible(spark, d), "poi_id", "reporter_id", "observed_at", F.col("observation").isin("not_found", "dry"), F.col("reporter_type") == "maintainer", now())


def a06_distinct_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (reporter, day) pairs, then distinct reporters."""
    days = notes(spark, d).where("poi_id is not null").select("poi_id", "reporter_id", F.to_date("observed_at").alias("day")).distinct()
    return days.groupBy("poi_id").agg(F.countDistinct("reporter_id").alias("accounts"), F.count(F.lit(1)).alias("account_days"))


def a15_rollup(spark: SparkSession, d: str) -> DataFrame:
    return N.roll_up(_visible(spark, d), "poi_id", "observed_at", "observation", "id", now()).withColumn("age", times.age_text(F.col("last_at"), now()))


def a16_notes_by_place(spark: SparkSession, d: str) -> DataFrame:
    return _visible(spark, d).where("poi_id is not null").groupBy("poi_id").agg(F.count(F.lit(1)).alias("n_notes"), F.countDistinct("observation").alias("n_tags"))


def a08_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records by type over the whole vocabulary; types never seen count 0."""
    counts = table(spark, d, "dim_pois").select(plain(F.col("poi_type")).alias("poi_type")).where(F.col("poi_type").isin(*POI_TYPES)).groupBy("poi_type").agg(F.count(F.lit(1)).alias("n"))
    return N.zero_filled(counts, "poi_type", "n", list(POI_TYPES))


def a09_legend(spark: SparkSession, d: str) -> DataFrame:
    """Places by type in a box, low confidence left out except for water, drawn at most 25."""
    rows = table(spark, d, "dim_pois").select("longitude", "latitude", "confidence", plain(F.col("poi_type")).alias("poi_type")).where(F.col("longitude").between(-80, -72) & F.col("latitude").between(36, 43))
    rows = rows.where(F.col("poi_type").isin(*POI_TYPES) & (F.coalesce(F.col("confidence") != "low", F.lit(False)) | (F.col("poi_type") == "water")))
    return rows.groupBy("poi_type").agg(F.count(F.lit(1)).alias("present")).withColumn("drawn", F.least("present", F.lit(25).cast("long")))


def a11_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Present and drawn in all; null unless something is not drawn."""
    t = a09_legend(spark, d).agg(F.sum("present").alias("p"), F.sum("drawn").alias("q"))
    return t.select(F.when(F.col("q") < F.col("p"), F.col("p")).alias("present"), F.when(F.col("q") < F.col("p"), F.col("q")).alias("drawn"))


def a17_visible_miles(spark: SparkSession, d: str) -> DataFrame:
    rows = notes(spark, d).where(F.col("lon").between(-78, -76) & F.col("lat").between(38, 40))
    return rows.agg(F.min("mile").alias("low"), F.max("mile").alias("high"))


def d02_staleness(spark: SparkSession, d: str) -> DataFrame:
    last = _visible(spark, d).where("poi_id is not null").groupBy("poi_id").agg(F.max("observed_at").alias("at"))
    return last.select(times.staleness(F.col("at"), now()).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def flt02_verified_closures(spark: SparkSession, d: str) -> DataFrame:
    return closures(spark, d).where("moderation_status = 'verified'").select("id", "start_mile_marker", "end_mile_marker", "reason_type", "status")


def flt03_public(spark: SparkSession, d: str) -> DataFrame:
    return closures(spark, d).where("status in ('closed', 'reroute_available') and moderation_status = 'verified'").select("id", "status")


def flt04_not_held(spark: SparkSession, d: str) -> DataFrame:
    """A three-valued hold: rows whose flag is null, another, or reviewed; not the plain negation."""
    rows = notes(spark, d)
    kept = rows.where(F.col("observation").isNull() | (F.col("observation") != "not_found") | F.col("hidden_at").isNotNull())
    return kept.groupBy("reporter_type").agg(F.count(F.lit(1)).alias("n"))


def flt08_inbox(spark: SparkSession, d: str) -> DataFrame:
    """Notes that concern a maintained stretch: named place, or a mile within the stretch while it was assigned (the last day counts whole)."""
    spans = closures(spark, d).select(F.col("id").alias("span"), "start_mile_marker", "end_mile_marker", F.to_date("reported_at").alias("from_day"), F.to_date("expected_reopen").alias("to_day"))
    rows = notes(spark, d).where("mile is not null")
    when = (F.col("observed_at") >= F.col("from_day").cast("timestamp_ntz")) & (F.col("to_day").isNull() | (F.col("observed_at") < F.date_add("to_day", 1).cast("timestamp_ntz")))
    return N.stabbing(rows, spans, "mile", "start_mile_marker", "end_mile_marker", 10.0, when, "left_semi").select("id", "observed_at")


def flt10_on_route(spark: SparkSession, d: str) -> DataFrame:
    """Warnings between two miles given in any order."""
    low, high = F.least(F.lit(900.0), F.lit(400.0)), F.greatest(F.lit(900.0), F.lit(400.0))
    return notes(spark, d).where(F.col("observation").isin("closed", "damaged") & F.col("mile").between(low, high)).select("id", "mile", "observation")


def flt13_broad(spark: SparkSession, d: str) -> DataFrame:
    span = F.abs(F.col("end_mile_marker") - F.col("start_mile_marker"))
    return closures(spark, d).select("id", F.round(span, 6).alias("span"), (span > 50).alias("broad"))


def j15_covering(spark: SparkSession, d: str) -> DataFrame:
    """Every span in force at a note's mile and time."""
    spans = closures(spark, d).select(F.col("id").alias("closure_id"), "start_mile_marker", "end_mile_marker", "closed_since", "expected_reopen")
    rows = notes(spark, d).where("mile is not null").select("id", "mile", "observed_at")
    when = F.coalesce(F.col("closed_since") <= F.col("observed_at"), F.lit(True)) & F.coalesce(F.col("expected_reopen") >= F.col("observed_at"), F.lit(True))
    return N.stabbing(rows, spans, "mile", "start_mile_marker", "end_mile_marker", 10.0, when).select("id", "closure_id")


def j23_covers(spark: SparkSession, d: str) -> DataFrame:
    """Notes of maintainers, and whether another maintainer's note lies within a mile by the same account; met by whole miles."""
    rows = notes(spark, d).where("reporter_type = 'maintainer' and mile is not null").select("id", "reporter_id", "mile").withColumn("bin", F.floor("mile"))
    near = F.explode(F.array(*[F.col("bin") + i for i in (-1, 0, 1)]))
    other = rows.select(F.col("id").alias("o"), F.col("reporter_id").alias("r"), F.col("mile").alias("m"), near.alias("b"))
    on = (rows.reporter_id == other.r) & (rows.bin == other.b) & (rows.id != other.o) & (F.abs(rows.mile - other.m) <= 1.0)
    covered = rows.join(other, on, "left_semi").select("id", F.lit(True).alias("c"))
    return rows.select("id").join(covered, "id", "left").select("id", F.coalesce("c", F.lit(False)).alias("covered"))


def k02_near_mile(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).where("mile is not null").select("id", F.round(F.abs(F.col("mile") - 700.0), 6).alias("away")).orderBy("away", "id").limit(25)


def k05_evicted(spark: SparkSession, d: str) -> DataFrame:
    """What lies beyond the twelve newest of each place."""
    return N.beyond_recent(notes(spark, d).where("poi_id is not null").select("id", "poi_id", "observed_at"), "poi_id", "observed_at", "id", 12).select("id", "poi_id")


def k06_queue(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("observation") == "not_found", 0).when(F.col("hidden_at").isNotNull(), 1).otherwise(2)
    return notes(spark, d).select("id", rank.alias("priority"), "observed_at").orderBy("priority", F.desc("observed_at"), "id").limit(200)


def k08_lanes(spark: SparkSession, d: str) -> DataFrame:
    """The nearest closure ahead of mile 700 northbound, broad advisories in a lane of their own."""
    lo, hi = F.least("start_mile_marker", "end_mile_marker"), F.greatest("start_mile_marker", "end_mile_marker")
    ahead = F.when(F.lit(700.0).between(lo, hi), F.lit(0.0)).when(lo > 700.0, lo - 700.0)
    rows = closures(spark, d).where("start_mile_marker is not null and end_mile_marker is not null")
    return N.nearest_ahead(rows, F.when(hi - lo > 50, "broad").otherwise("specific"), ahead, "id").select("lane", "id", F.round("ahead", 6).alias("ahead"))


def j11_uncontradicted(spark: SparkSession, d: str) -> DataFrame:
    """Places reported missing or dry where no two accounts saw water flow afterwards, with the accounts that said so.

    Two accounts saw it after a report if the second last of the accounts' last times is later, so a place needs one
    number instead of its pairs of notes. Resent rows change nothing.
    """
    bad, at = F.col("observation").isin("not_found", "dry"), F.col("observed_at")
    rows = table(spark, d, "field_notes").where(F.col("poi_id").isNotNull() & (bad | (F.col("observation") == "flowing")))
    said = rows.groupBy("poi_id", "reporter_id").agg(F.max(F.when(~bad, at)).alias("flowing"), F.max(F.when(bad, at)).alias("missing"), F.max(bad).alias("_bad"), F.max(bad & at.isNull()).alias("_undated"))
    last = Window.partitionBy("poi_id").orderBy(F.col("flowing").desc())
    second = said.where("reporter_id is not null and flowing is not null").withColumn("_n", F.row_number().over(last)).where("_n = 2").select("poi_id", F.col("flowing").alias("_second"))
    kept = said.where("_bad").join(second, "poi_id", "left").where("_second is null or _undated or missing >= _second")
    return kept.groupBy("poi_id").agg(F.count("reporter_id").alias("accounts"))


def st06_since(spark: SparkSession, d: str) -> DataFrame:
    """Count and newest of notices after a reader's mark, within 30 days; no row values if there are none."""
    rows = closures(spark, d).where((F.col("reported_at") <= now()) & (F.col("reported_at") >= now() - F.expr("interval 30 days")) & (F.col("reported_at") > F.lit("2026-09-25 00:00:00").cast("timestamp_ntz")))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.max("reported_at").alias("newest"))
    return out.where("n > 0")


def st07_high_water(spark: SparkSession, d: str) -> DataFrame:
    """Rows changed after a reader's high-water mark, with the next mark."""
    rows = notes(spark, d).where(F.col("posted_at") > F.lit("2026-10-01 00:00:00").cast("timestamp_ntz"))
    return rows.groupBy(F.to_date("posted_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("posted_at").alias("mark"))


def q06_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose newest load is more than their refresh time old."""
    loads = table(spark, d, "dim_pois").groupBy(F.regexp_replace(plain(F.col("source")), "[- ]", "_").alias("source")).agg(F.max("loaded_at").alias("newest"))
    rules = table(spark, d, "poi_sources")
    age = times.days_between(now(), F.col("newest"))
    return rules.join(loads, "source", "left").select("source", "newest", F.when(F.col("newest").isNull(), "missing").when(age > F.col("refresh_days"), "warn").otherwise("pass").alias("state"))


def g10_moved(spark: SparkSession, d: str) -> DataFrame:
    """How far each closure's two ends lie apart in a straight line."""
    rows = closures(spark, d).where("start_lat is not null and start_lon is not null and end_lat is not null and end_lon is not null")
    args = [F.col(c) for c in ("start_lat", "start_lon", "end_lat", "end_lon")]
    return rows.select("id", F.round(geo.haversine_m(*args), 3).alias("metres"), F.round(geo.haversine_ft(*args), 2).alias("feet"), F.round(geo.flat_m(*args), 3).alias("flat"), F.round(geo.flat_first_m(*args), 3).alias("flat_first"))


QUERIES = {f.__name__: f for f in (w01_recent_notes, a05_corroborated, a06_distinct_accounts, a07_disputes, a08_counts, a09_legend, a11_dropped, a15_rollup, a16_notes_by_place, a17_visible_miles, d02_staleness, flt02_verified_closures, flt03_public, flt04_not_held, flt08_inbox, flt10_on_route, flt13_broad, g10_moved, j11_uncontradicted, j15_covering, j23_covers, k02_near_mile, k05_evicted, k06_queue, k08_lanes, q06_freshness, st06_since, st07_high_water)}

_N = "with n as (select distinct * from field_notes) "
_C = "with c as (select distinct * from closures) "
_NOW = f"timestamp '{NOW}'"
_BAD = "observation in ('not_found', 'dry')"
_V = "with n as (select distinct * from field_notes where hidden_at is null)"
_TYPES = ", ".join(f"'{t}'" for t in POI_TYPES)
_HAV = "2 * {r} * asin(least(1.0, sqrt(power(sin((radians(end_lat) - radians(start_lat)) / 2), 2) + cos(radians(start_lat)) * cos(radians(end_lat)) * power(sin((radians(end_lon) - radians(start_lon)) / 2), 2))))"
_LEGEND = f"""legend as (select lower(trim(poi_type)) as poi_type, count(*) as present, least(count(*), 25) as drawn from dim_pois where longitude between -80 and -72 and latitude between 36 and 43
  and lower(trim(poi_type)) in ({_TYPES}) and (coalesce(confidence <> 'low', false) or lower(trim(poi_type)) = 'water') group by 1)"""

SQL = {
    "w01_recent_notes": f"""{_V} select id, poi_id, observed_at, rank from (select *, row_number() over (partition by coalesce(poi_id, id) order by observed_at desc, id) as rank from n where observed_at >= {_NOW} - interval 90 day) where rank <= 5""",
    "a05_corroborated": f"""{_V}, s as (select poi_id, count(distinct reporter_id) as accounts, max(observed_at) as latest_at from n where poi_id is not null and {_BAD} and observed_at >= {_NOW} - interval 180 day group by 1 having count(distinct reporter_id) >= 2)
select * from s where not exists (select 1 from n where n.poi_id = s.poi_id and (observation is null or not {_BAD}) and observed_at > s.latest_at group by poi_id having count(distinct reporter_id) >= 2)""",
    "a06_distinct_accounts": f"{_N} select poi_id, count(distinct reporter_id) as accounts, count(distinct (reporter_id, observed_at::date)) as account_days from n where poi_id is not null group by 1",
    "a07_disputes": f"""{_V}, s as (select poi_id, max(observed_at) filter ({_BAD}) as latest, count(distinct reporter_id) filter ({_BAD} and observed_at >= {_NOW} - interval 180 day) as acc,
    coalesce(bool_or(reporter_type = 'maintainer') filter ({_BAD} and observed_at >= {_NOW} - interval 180 day), false) as kept from n where poi_id is not null group by 1 having count(*) filter ({_BAD}) > 0),
  c as (select s.poi_id, count(distinct reporter_id) as k, bool_or(reporter_type = 'maintainer') as m from n join s on n.poi_id = s.poi_id and n.observed_at > s.latest and coalesce(not {_BAD}, true) group by 1)
select s.poi_id, latest, case when latest >= {_NOW} - interval 180 day then acc else 0 end as accounts, latest >= {_NOW} - interval 180 day and kept as maintainer_said,
  latest >= {_NOW} - interval 180 day and (kept or acc >= 2) and not coalesce(m or k >= 2, false) as reported_missing from s left join c on s.poi_id = c.poi_id""",
    "a08_counts": f"select v.t as poi_type, count(d.poi_key) as n from (select unnest([{_TYPES}]) as t) v left join dim_pois d on lower(trim(d.poi_type)) = v.t group by 1",
    "a09_legend": f"with {_LEGEND} select * from legend",
    "a11_dropped": f"with {_LEGEND}, t as (select cast(sum(present) as bigint) as p, cast(sum(drawn) as bigint) as q from legend) select case when q < p then p end as present, case when q < p then q end as drawn from t",
    "a15_rollup": f"""{_V}, r as (select *, row_number() over (partition by poi_id order by observed_at desc, id desc) as rn, observation is not null and observed_at >= {_NOW} - interval 14 day as recent from n where poi_id is not null),
  f as (select poi_id, max(observed_at) as last_at, max(case when rn = 1 then observation end) as newest, arg_min(observation, rn) filter (recent) as said from r group by 1),
  o as (select r.poi_id, arg_min(observation, rn) as against from r join f on r.poi_id = f.poi_id and recent and observation <> said group by 1)
select f.poi_id, last_at, newest, case when against is not null then said end as said, against,
  case when floor(epoch({_NOW} - last_at) / 86400) <= 0 then 'today' when floor(epoch({_NOW} - last_at) / 86400) = 1 then 'yesterday' else cast(floor(epoch({_NOW} - last_at) / 86400) as bigint) || ' days ago' end as age from f left join o on f.poi_id = o.poi_id""",
    "a16_notes_by_place": f"{_V} select poi_id, count(*) as n_notes, count(distinct observation) as n_tags from n where poi_id is not null group by 1",
    "a17_visible_miles": f"{_N} select min(mile) as low, max(mile) as high from n where lon between -78 and -76 and lat between 38 and 40",
    "d02_staleness": f"{_V}, l as (select poi_id, epoch({_NOW} - max(observed_at)) / 86400 as age from n where poi_id is not null group by 1) select case when age <= 14 then 'fresh' when age <= 60 then 'ageing' else 'stale' end as tier, count(*) as n from l group by 1",
    "flt02_verified_closures": f"{_C} select id, start_mile_marker, end_mile_marker, reason_type, status from c where moderation_status = 'verified'",
    "flt03_public": f"{_C} select id, status from c where status in ('closed', 'reroute_available') and moderation_status = 'verified'",
    "flt04_not_held": f"{_N} select reporter_type, count(*) as n from n where observation is null or observation <> 'not_found' or hidden_at is not null group by 1",
    "flt08_inbox": """with n as (select distinct * from field_notes), c as (select distinct * from closures) select id, observed_at from n where exists (select 1 from c where n.mile between least(start_mile_marker, end_mile_marker) and greatest(start_mile_marker, end_mile_marker)
  and n.observed_at >= c.reported_at::date and (expected_reopen is null or n.observed_at < c.expected_reopen::date + 1))""",
    "flt10_on_route": f"{_N} select id, mile, observation from n where observation in ('closed', 'damaged') and mile between 400 and 900",
    "flt13_broad": f"{_C} select id, round(abs(end_mile_marker - start_mile_marker), 6) as span, abs(end_mile_marker - start_mile_marker) > 50 as broad from c",
    "g10_moved": f"""{_C} select id, round({_HAV.format(r='6371008.8')}, 3) as metres, round({_HAV.format(r='20902231.0')}, 2) as feet,
  round(sqrt(power((end_lon - start_lon) * 111320 * cos(radians((start_lat + end_lat) / 2)), 2) + power((end_lat - start_lat) * 111320, 2)), 3) as flat,
  round(sqrt(power((end_lon - start_lon) * 111132 * cos(radians(start_lat)), 2) + power((end_lat - start_lat) * 111132, 2)), 3) as flat_first from c where start_lat is not null and start_lon is not null and end_lat is not null and end_lon is not null""",
    "j11_uncontradicted": f"""{_N}select poi_id, count(distinct reporter_id) as accounts from n where poi_id is not null and {_BAD} and not exists (
  select 1 from n as m where m.poi_id = n.poi_id and m.observed_at > n.observed_at and m.observation = 'flowing' group by m.poi_id having count(distinct m.reporter_id) >= 2) group by poi_id""",
    "j15_covering": """with n as (select distinct * from field_notes), c as (select distinct * from closures) select n.id, c.id as closure_id from n join c on n.mile between least(start_mile_marker, end_mile_marker) and greatest(start_mile_marker, end_mile_marker)
  and coalesce(c.closed_since <= n.observed_at, true) and coalesce(c.expected_reopen >= n.observed_at, true)""",
    "j23_covers": f"""{_N}, m as (select * from n where reporter_type = 'maintainer' and mile is not null) select id, exists (select 1 from m o where o.reporter_id = m.reporter_id and o.id <> m.id and abs(o.mile - m.mile) <= 1.0) as covered from m""",
    "k02_near_mile": f"{_N} select id, round(abs(mile - 700.0), 6) as away from n where mile is not null order by 2, 1 limit 25",
    "k05_evicted": f"{_N} select id, poi_id from (select *, row_number() over (partition by poi_id order by observed_at desc, id) as rn from n where poi_id is not null) where rn > 12",
    "k06_queue": f"{_N} select id, case when observation = 'not_found' then 0 when hidden_at is not null then 1 else 2 end as priority, observed_at from n order by 2, 3 desc, 1 limit 200",
    "k08_lanes": f"""{_C}, r as (select id, least(start_mile_marker, end_mile_marker) as lo, greatest(start_mile_marker, end_mile_marker) as hi from c), a as (select id, case when hi - lo > 50 then 'broad' else 'specific' end as lane, case when 700 between lo and hi then 0 when lo > 700 then lo - 700 end as ahead from r)
select lane, id, round(ahead, 6) as ahead from (select *, row_number() over (partition by lane order by ahead, id) as rn from a where ahead is not null) where rn = 1""",
    "q06_freshness": f"""with l as (select regexp_replace(lower(trim(source)), '[- ]', '_', 'g') as source, max(loaded_at) as newest from dim_pois group by 1)
select s.source, newest, case when newest is null then 'missing' when epoch({_NOW} - newest) / 86400 > refresh_days then 'warn' else 'pass' end as state from poi_sources s left join l using (source)""",
    "st06_since": f"{_C} select count(*) as n, max(reported_at) as newest from c where reported_at <= {_NOW} and reported_at >= {_NOW} - interval 30 day and reported_at > timestamp '2026-09-25' having count(*) > 0",
    "st07_high_water": f"{_N} select posted_at::date as day, count(*) as n, max(posted_at) as mark from n where posted_at > timestamp '2026-10-01' group by 1",
}
