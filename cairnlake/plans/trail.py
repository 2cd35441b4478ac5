"""Queries over ordered sequences: profiles, intervals, traces. A user's events in time order stand for a walk; values for levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import effort, geo, times
from ..operators import notes as N
from ..operators import sequence as S
from ..session import table

ORDER = ["ts", "event_id"]
LEVEL = "level"


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with a level that is null on errors and a part that starts on sign-ups."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.withColumns({LEVEL: F.when(F.col("event_type") != "error", F.round(F.col("value") * 10)), "part_start": F.col("event_type") == "signup"})


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Walked intervals: each event walks one to seven miles from its place on a ring."""
    e = table(spark, d, "events")
    return e.select("user_id", (F.col("event_id") % 997).cast("double").alias("start"), (F.col("event_id") % 997 + 1 + F.col("event_id") % 7).cast("double").alias("end"))


def w03_runs(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of one observation (null is a key) along each reporter's miles, broken by gaps over 50 miles."""
    rows = table(spark, d, "field_notes").where("mile is not null").select("reporter_id", "mile", "reporter_type").distinct()
    return S.equal_runs(rows, ["reporter_id"], "mile", "reporter_type", 50.0, 0.25).select("reporter_id", "reporter_type", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "n")


def w04_pinned(spark: SparkSession, d: str) -> DataFrame:
    return S.pin_to_ends(w03_runs(spark, d), ["reporter_id"], 0.0, 2200.0).select("reporter_id", "start", "end")


def w07_ascent(spark: SparkSession, d: str) -> DataFrame:
    return S.ascent_over_profile(events(spark, d), ["user_id"], ORDER, LEVEL, 30.0, "part_start").select("user_id", F.round("ascent", 3).alias("ascent"))


def w08_over_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The same over lists with gaps: the walks of each user and month as one list, null where a level is missing."""
    ordered = F.array_sort(F.collect_list(F.struct(*ORDER, F.col(LEVEL).alias("v"))))
    lists = events(spark, d).groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.transform(ordered, lambda x: x["v"]).alias("levels"))
    return lists.select("user_id", "month", F.round(S.ascent_over_gaps(F.col("levels"), 30.0), 3).alias("ascent"))


def k13_newest(spark: SparkSession, d: str) -> DataFrame:
    """Each account's log, newest first, by place in it; equal times by id."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    return table(spark, d, "events").select("event_id", place.cast("long").alias("place"))


def k14_oldest(spark: SparkSession, d: str) -> DataFrame:
    """The queue of what is claimed, oldest first: the two hundred that come next."""
    return table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "ts").orderBy("ts", "event_id").limit(200)


def w10_raw_ascent(spark: SparkSession, d: str) -> DataFrame:
    """With no dead band every rise counts; runs break at null levels."""
    return S.ascent_over_profile(events(spark, d), ["user_id"], ORDER, LEVEL, 0.0).select("user_id", F.round("ascent", 3).alias("ascent"))


def w12_descent(spark: SparkSession, d: str) -> DataFrame:
    return S.ascent_over_profile(events(spark, d), ["user_id"], ORDER, LEVEL, 0.0, sign=-1).select("user_id", F.round("ascent", 3).alias("descent"))


def w13_reversed(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", "part_start")
    return S.reversed_window(rows, ["user_id"], "event_id", "part_start").select("user_id", "event_id", "part_start", F.col("step").cast("long").alias("step"))


def w14_merged(spark: SparkSession, d: str) -> DataFrame:
    return S.merged_intervals(spans(spark, d), ["user_id"], "start", "end")


def w16_gaps(spark: SparkSession, d: str) -> DataFrame:
    return S.complement(S.merged_intervals(spans(spark, d), ["user_id"], "start", "end"), ["user_id"], 0.0, 1000.0, 0.2)


def w18_left(spark: SparkSession, d: str) -> DataFrame:
    """What is left to walk: gaps of ten miles or more, and the rest as slivers."""
    gaps = S.complement(S.merged_intervals(spans(spark, d), ["user_id"], "start", "end"), ["user_id"], 0.0, 1000.0)
    length = F.col("end") - F.col("start")
    return gaps.groupBy("user_id").agg(F.sum(F.when(length >= 10, length).otherwise(0.0)).alias("gap_miles"), F.sum(F.when(length < 10, length).otherwise(0.0)).alias("sliver_miles"), F.sum((length >= 10).cast("long")).alias("n_gaps"))


def w19_clipped(spark: SparkSession, d: str) -> DataFrame:
    return S.clip(S.merged_intervals(spans(spark, d), ["user_id"], "start", "end"), 100.0, 200.0)


def w20_overlap(spark: SparkSession, d: str) -> DataFrame:
    merged = S.merged_intervals(spans(spark, d), ["user_id"], "start", "end")
    return merged.groupBy("user_id").agg(F.sum(S.overlap(F.col("start"), F.col("end"), F.lit(100.0), F.lit(200.0))).alias("miles"))


def w21_axis(spark: SparkSession, d: str) -> DataFrame:
    """Running mile over the reporters' notes as vertices of parts, no step across parts."""
    rows = table(spark, d, "field_notes").dropDuplicates(["id"]).where("lat is not null and lon is not null").select(F.col("reporter_id").alias("part"), "id", "lat", "lon")
    w = Window.partitionBy("part").orderBy("id")
    step = geo.haversine_ft(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return S.cumulative_miles(rows.withColumn("ft", step), "part", "id", F.col("ft")).select("id", F.round("mile", 4).alias("mile"))


def w23_interpolated(spark: SparkSession, d: str) -> DataFrame:
    """The level halfway between each sample and the next."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    return events(spark, d).select("event_id", F.round((F.col("value") + F.lead("value").over(w)) / 2, 4).alias("half")).where("half is not null")


def w27_rising(spark: SparkSession, d: str) -> DataFrame:
    return S.rising_only(events(spark, d), ["user_id"], ORDER, "value").select("user_id", "event_id", "value")


def w28_implausible(spark: SparkSession, d: str) -> DataFrame:
    """Steps of more than 400 in level from one sample to the next; those at a part start are seams."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    steps = events(spark, d).select("user_id", "event_id", (F.lead(LEVEL).over(w) - F.col(LEVEL)).alias("delta"), F.lead("part_start").over(w).alias("seam"))
    return steps.where(F.abs("delta") > 400)


def w30_next_climb(spark: SparkSession, d: str) -> DataFrame:
    """The first confirmed climb of each user, from the array of all of them."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col(LEVEL).alias("v"))))
    series = events(spark, d).where(F.col(LEVEL).isNotNull()).groupBy("user_id").agg(F.transform(ordered, lambda x: F.struct(x["event_id"].alias("at"), x["v"].alias("v"))).alias("s"))
    found = series.select("user_id", S.climbs(F.col("s"), 300.0).alias("c"))
    return found.where("size(c) > 0").select("user_id", F.get("c", F.lit(0))["trough"].alias("trough"), F.get("c", F.lit(0))["peak"].alias("peak"), F.size("c").cast("long").alias("n_climbs"))


def w31_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections that end with a purchase: the row after one starts the next. First and last row of each."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    after = F.coalesce(F.lag(F.col("event_type") == "purchase").over(w), F.lit(True))
    sections = S.islands(events(spark, d), ["user_id"], ORDER, after, "section")
    return sections.groupBy("user_id", "section").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n")).withColumn("section", F.col("section").cast("long"))


def w33_walking_days(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    return events(spark, d).select("event_id", F.sum((F.col("value") >= 10).cast("long")).over(w).alias("walking_day"))


def w34_leading(spark: SparkSession, d: str) -> DataFrame:
    """How many rows come before the first error of each user."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    n = events(spark, d).withColumn("rn", F.row_number().over(w))
    return n.groupBy("user_id").agg((F.coalesce(F.min(F.when(F.col("event_type") == "error", F.col("rn"))) - 1, F.count(F.lit(1)))).cast("long").alias("leading"))


def w37_previous(spark: SparkSession, d: str) -> DataFrame:
    loads = table(spark, d, "poi_snapshots").select("load_no", "snapshot_date").distinct()
    return loads.select("load_no", F.lag("snapshot_date").over(Window.orderBy("load_no")).cast("string").alias("previous"))  # one row a load


def st01_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Sustained divergence: cue after 12 hours of values over 20, push after 25; any lower value resets."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = events(spark, d).withColumn("off", F.col("value") > 20)
    runs = S.islands(e, ["user_id"], ORDER, F.coalesce(F.col("off") != F.lag("off").over(w), F.lit(True)))
    since = F.min("ts").over(Window.partitionBy("user_id", "island"))
    hours = times.days_between(F.col("ts"), since) * 24
    return runs.where("off").select("event_id", F.when(hours >= 25, "push").when(hours >= 12, "cue").otherwise("silent").alias("alert"))


def st02_direction(spark: SparkSession, d: str) -> DataFrame:
    """Direction with hysteresis: it turns only after 40 units from the last turning point."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    series = events(spark, d).groupBy("user_id").agg(ordered.alias("s"))
    start = F.struct(F.get("s", F.lit(0))["value"].alias("anchor"), F.lit(None).cast("string").alias("way"), F.lit(0).cast("long").alias("turns"))

    def step(a, p):
        moved = p["value"] - a["anchor"]
        way = F.when(moved > 0, F.lit("NOBO")).otherwise(F.lit("SOBO"))
        return F.when(F.abs(moved) < 40, a).otherwise(F.struct(p["value"].alias("anchor"), way.alias("way"), (a["turns"] + F.when(way.eqNullSafe(a["way"]), 0).otherwise(1)).alias("turns")))

    return series.select("user_id", F.aggregate("s", start, step).alias("a")).select("user_id", "a.anchor", "a.way", "a.turns")


def st03_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of at most 30 units merge into covered ranges; jumps are rejected."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    steps = events(spark, d).select("user_id", F.lag("value").over(w).alias("start"), F.col("value").alias("end")).where(F.abs(F.col("end") - F.col("start")) <= 30)
    return S.merged_intervals(steps, ["user_id"], "start", "end")


def st04_daily(spark: SparkSession, d: str) -> DataFrame:
    """The same, afresh every day."""
    w = Window.partitionBy("user_id", "day").orderBy(*ORDER)
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    steps = e.select("user_id", "day", F.lag("value").over(w).alias("start"), F.col("value").alias("end")).where(F.abs(F.col("end") - F.col("start")) <= 30)
    merged = S.merged_intervals(steps, ["user_id", "day"], "start", "end")
    return merged.groupBy("user_id", "day").agg(F.round(F.sum(F.col("end") - F.col("start")), 4).alias("miles"))


def a18_quartiles(spark: SparkSession, d: str) -> DataFrame:
    q = events(spark, d).groupBy("user_id").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    return q.select("user_id", F.round(F.get("q", F.lit(0)), 4).alias("low"), F.round(F.get("q", F.lit(1)), 4).alias("high"))


def a19_reach(spark: SparkSession, d: str) -> DataFrame:
    """Middle half of daily totals in hundredths, only for users with at least five days."""
    days = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    q = days.groupBy("user_id").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    return q.select("user_id", F.when(F.col("n") >= 5, F.get("q", F.lit(0))).alias("low"), F.when(F.col("n") >= 5, F.get("q", F.lit(1))).alias("high"))


def a21_upper_median(spark: SparkSession, d: str) -> DataFrame:
    """The upper median of the positive steps, not interpolated."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    steps = events(spark, d).select("user_id", (F.col("value") - F.lag("value").over(w)).alias("s")).where("s > 0")
    ranked = steps.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("s"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return ranked.where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select("user_id", F.round("s", 6).alias("median"))


def a22_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Lowest and highest sample of each of 200 buckets of the axis, in axis order (ties: the first)."""
    e = events(spark, d).where(F.col(LEVEL).isNotNull()).withColumn("bucket", F.least(F.lit(199).cast("long"), F.floor(F.col("event_id") % 5000 / 5000.0 * 200)))
    both = e.groupBy("bucket").agg(F.min_by("event_id", F.struct(LEVEL, "event_id")).alias("lo"), F.max_by("event_id", F.struct(F.col(LEVEL), -F.col("event_id"))).alias("hi"))
    return both.select("bucket", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("event_id"))


def a32_totals(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    minutes = effort.naismith_minutes(F.col("value"), F.col(LEVEL))
    return e.groupBy("user_id").agg(F.round(F.sum("value"), 3).alias("miles"), F.round(F.coalesce(F.sum(LEVEL), F.lit(0.0)), 3).alias("ascent"), F.round(F.coalesce(F.sum(minutes), F.lit(0.0)), 2).alias("minutes"))


def a41_part_miles(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle miles of each reporter's notes as a line."""
    rows = table(spark, d, "field_notes").dropDuplicates(["id"]).where("lat is not null and lon is not null")
    w = Window.partitionBy("reporter_id").orderBy("observed_at", "id")
    step = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return rows.select("reporter_id", step.alias("m")).groupBy("reporter_id").agg(F.round(F.coalesce(F.sum("m"), F.lit(0.0)) / geo.METRES_PER_MILE, 3).alias("miles"))


def a42_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Total climb at several dead bands."""
    runs = S.profile_runs(events(spark, d), ["user_id"], ORDER, LEVEL)
    each = [F.struct(F.lit(float(t)).alias("threshold"), S.ascent(F.col("levels"), float(t)).alias("gain")) for t in (0, 1, 2, 3, 4, 6, 10)]
    return runs.select(F.inline(F.array(*each))).groupBy("threshold").agg(F.round(F.sum("gain"), 3).alias("gain"))


def a43_rising_total(spark: SparkSession, d: str) -> DataFrame:
    return w28_implausible(spark, d).groupBy("user_id").agg(F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0.0)).alias("rise"))


def n01_minutes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    miles, up = F.col("p_size").cast("double"), F.col("p_retailprice")
    own = effort.pace_minutes(miles, up, F.col("p_size") * 10.0, F.lit(2.5), F.lit(1000.0), F.lit(5.0))
    standard = effort.naismith_minutes(miles, up)
    grade, passes = effort.grade_gate(up, miles * 100)
    return p.select("p_partkey", F.round(standard, 4).alias("standard"), F.round(own, 4).alias("own"), F.round(effort.pace_ratio(own, standard), 5).alias("ratio"), F.round(grade, 6).alias("grade"), passes.alias("passes"), F.round(effort.day_cost(miles, 20.0), 4).alias("cost"), effort.tick_step(miles).alias("tick"))


def n08_windows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a, b = F.col("p_size").cast("double"), F.col("p_retailprice") % 50
    low, high = effort.clamped_span(a, b, F.lit(3.0), F.lit(47.0))
    r0, r1 = effort.ribbon(a, F.when(F.col("p_size") % 3 == 0, "northbound").when(F.col("p_size") % 3 == 1, "southbound"), F.lit(3.0), F.lit(47.0))
    return p.select("p_partkey", *[F.round(c, 6).alias(n) for c, n in ((low, "low"), (high, "high"), (r0, "ribbon_start"), (r1, "ribbon_end"))])


def j36_interval_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Half-open runs, the last one closed: which hundred-mile run a note lies in."""
    runs = spark.range(0, 22).select(F.col("id").alias("run"), (F.col("id") * 100).cast("double").alias("low"), (F.col("id") * 100 + 100).cast("double").alias("high"))
    rows = table(spark, d, "field_notes").dropDuplicates(["id"]).where("mile is not null").select("id", "mile")
    hit = N.stabbing(rows, runs, "mile", "low", "high", 100.0).where("mile < high or run = 21")
    return hit.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (w03_runs, w04_pinned, w07_ascent, w08_over_gaps, k13_newest, k14_oldest, w10_raw_ascent, w12_descent, w13_reversed, w14_merged, w16_gaps, w18_left, w19_clipped, w20_overlap, w21_axis, w23_interpolated, w27_rising, w28_implausible, w30_next_climb, w31_sections, w33_walking_days, w34_leading, w37_previous, st01_divergence, st02_direction, st03_steps, st04_daily, a18_quartiles, a19_reach, a21_upper_median, a22_envelope, a32_totals, a41_part_miles, a42_sweep, a43_rising_total, n01_minutes, n08_windows, j36_interval_lookup)}

_E = "e as (select *, case when event_type <> 'error' then round(value * 10) end as level, event_type = 'signup' as part_start from events)"
_SPANS = "s as (select user_id, (event_id % 997)::double as a, (event_id % 997 + 1 + event_id % 7)::double as b from events)"


def _merge(source: str, by: str) -> str:
    return f"""f as (select *, max(b) over (partition by {by} order by a, b rows between unbounded preceding and 1 preceding) as reach from {source}),
g as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by {by} order by a, b rows unbounded preceding) as i from f),
m as (select {by}, min(a) as "start", max(b) as "end" from g group by {by}, i)"""


_MERGED = f"{_SPANS}, {_merge('s', 'user_id')}"
_GAPS = f"""{_MERGED}, u as (select distinct user_id, 0.0::double as "start", 0.0::double as "end" from m union all select user_id, greatest("start", 0), least("end", 1000) from m where least("end", 1000) > greatest("start", 0)),
gap as (select user_id, "end" as "start", coalesce(lead("start") over (partition by user_id order by "start", "end"), 1000.0) as "end" from u)"""
_RAW = f"""with {_E}, l as (select user_id, level, lag(level) over (partition by user_id order by ts, event_id) as p from e)
select user_id, round(coalesce(sum(greatest({{}}, 0)), 0), 3) as {{}} from l group by 1 having count(level) > 0"""
_RUNS = """with n as (select distinct reporter_id, mile, reporter_type from field_notes where mile is not null),
f as (select *, case when reporter_type is not distinct from lag(reporter_type) over w and mile - lag(mile) over w <= 50 then 0 else 1 end as brk from n window w as (partition by reporter_id order by mile)),
i as (select *, sum(brk) over (partition by reporter_id order by mile rows unbounded preceding) as island from f),
r as (select reporter_id, any_value(reporter_type) as reporter_type, round(min(mile) - 0.25, 4) as "start", round(max(mile) + 0.25, 4) as "end", count(*) as n from i group by reporter_id, island)"""
_HAV = "2 * {r} * asin(least(1.0, sqrt(power(sin((radians(lat) - radians(pa)) / 2), 2) + cos(radians(pa)) * cos(radians(lat)) * power(sin((radians(lon) - radians(po)) / 2), 2))))"

def _climb_steps(rows: str) -> str:
    """CTE st: the state after each level of ``rows`` (k, i, v, th): a climb counts once a fall of th follows; open ones at the end."""
    return f"""st(k, i, th, gain, low, high, way) as (select k, i, th, 0.0::double, v, v, 0 from {rows} where i = 1 union all
select r.k, r.i, r.th, case when way = 1 and v <= high - r.th and v <= high then gain + high - low else gain end,
  case when way = 1 and v <= high - r.th and v <= high then v when way = 1 then low when way = -1 and v >= low + r.th and v >= low then low else least(low, v) end,
  case when way = 1 then greatest(high, v) when way = -1 and v >= low + r.th and v >= low then v when way = -1 then high else greatest(high, v) end,
  case when way = 1 then case when v <= high - r.th and v <= high then -1 else 1 end when way = -1 then case when v >= low + r.th and v >= low then 1 else -1 end
    when greatest(high, v) - least(low, v) >= r.th then case when v >= greatest(high, v) then 1 else -1 end else 0 end
from st join {rows} r on r.k = st.k and r.th = st.th and r.i = st.i + 1),
climbed as (select k, th, gain + case when way = 1 then high - low else 0 end as gain from st where (k, th, i) in (select (k, th, max(i)) from {rows} group by k, th))"""


def _runs_of(breaks: str, thresholds: str) -> str:
    return f"""{_E}, br as (select *, sum(case when {breaks} then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from e),
rw as (select (user_id, run) as k, row_number() over (partition by user_id, run, th order by ts, event_id) as i, level as v, th::double as th from br, (select unnest([{thresholds}]) as th) where level is not null)"""


_SERIES = f"{_E}, rs as (select user_id as k, event_id as at_, row_number() over (partition by user_id order by ts, event_id) as i, level as v, value from e{{}})"

SQL = {
    "w07_ascent": f"with recursive {_runs_of('level is null or part_start', '30')}, {_climb_steps('rw')} select k[1] as user_id, round(sum(gain), 3) as ascent from climbed group by 1",
    "w08_over_gaps": f"""with recursive {_E}, br as (select *, strftime(ts, '%Y-%m') as month, sum(case when level is null then 1 else 0 end) over (partition by user_id, strftime(ts, '%Y-%m') order by ts, event_id rows unbounded preceding) as run from e),
rw as (select (user_id, month, run) as k, row_number() over (partition by user_id, month, run order by ts, event_id) as i, level as v, 30.0::double as th from br where level is not null), {_climb_steps('rw')}, t as (select k[1] as user_id, k[2] as month, sum(gain) as g from climbed group by 1, 2)
select user_id, month, round(coalesce(g, 0), 3) as ascent from (select distinct user_id, month from br) left join t using (user_id, month)""",
    "k13_newest": "select event_id, row_number() over (partition by user_id order by ts desc, event_id) as place from events",
    "k14_oldest": "select event_id, ts from events where event_type = 'purchase' order by ts, event_id limit 200",
    "a42_sweep": f"with recursive {_runs_of('level is null', '0, 1, 2, 3, 4, 6, 10')}, {_climb_steps('rw')} select th as threshold, round(sum(gain), 3) as gain from climbed group by 1",
    "w30_next_climb": f"""with recursive {_SERIES.format(" where level is not null")}, st(k, i, la, lv, ha, hv, way, n, ft, fp) as (select k, i, at_, v, at_, v, 0, 0, null::bigint, null::bigint from rs where i = 1 union all
select r.k, r.i, case when way = 1 and v <= hv and v <= hv - 300 then at_ when way <> 1 and v <= lv then at_ else la end, case when way = 1 and v <= hv and v <= hv - 300 then v when way <> 1 and v <= lv then v else lv end,
  case when way = -1 then case when v > lv and v >= lv + 300 then at_ else ha end when v > hv then at_ else ha end, case when way = -1 then case when v > lv and v >= lv + 300 then v else hv end when v > hv then v else hv end,
  case when way = 1 then case when v <= hv and v <= hv - 300 then -1 else 1 end when way = -1 then case when v > lv and v >= lv + 300 then 1 else -1 end when greatest(hv, v) - least(lv, v) >= 300 then case when v >= greatest(hv, v) then 1 else -1 end else 0 end,
  n + (way = 1 and v <= hv and v <= hv - 300)::int, coalesce(ft, case when way = 1 and v <= hv and v <= hv - 300 then la end), coalesce(fp, case when way = 1 and v <= hv and v <= hv - 300 then ha end) from st join rs r on r.k = st.k and r.i = st.i + 1),
o as (select k, n + (way = 1)::int as n, coalesce(ft, case when way = 1 then la end) as ft, coalesce(fp, case when way = 1 then ha end) as fp from st where (k, i) in (select (k, max(i)) from rs group by k)) select k as user_id, ft as trough, fp as peak, n::bigint as n_climbs from o where n > 0""",
    "st02_direction": f"""with recursive {_SERIES.format("")}, st(k, i, anchor, way, turns) as (select k, i, value, null::varchar, 0::bigint from rs where i = 1 union all
select r.k, r.i, case when abs(r.value - anchor) < 40 then anchor else r.value end, case when abs(r.value - anchor) < 40 then way when r.value > anchor then 'NOBO' else 'SOBO' end,
  turns + (abs(r.value - anchor) >= 40 and (case when r.value > anchor then 'NOBO' else 'SOBO' end) is distinct from way)::int from st join rs r on r.k = st.k and r.i = st.i + 1)
select k as user_id, anchor, way, turns from st where (k, i) in (select (k, max(i)) from rs group by k)""",
    "w03_runs": f"{_RUNS} select * from r",
    "w04_pinned": f"""{_RUNS} select reporter_id, case when "start" = min("start") over w then 0.0 else "start" end as "start", case when "end" = max("end") over w then 2200.0 else "end" end as "end" from r window w as (partition by reporter_id)""",
    "w10_raw_ascent": _RAW.format("case when level is not null and p is not null then level - p end", "ascent"),
    "w12_descent": _RAW.format("case when level is not null and p is not null then p - level end", "descent"),
    "w13_reversed": f"with {_E} select user_id, event_id, coalesce(lag(part_start) over w, false) as part_start, row_number() over w as step from e window w as (partition by user_id order by event_id desc)",
    "w14_merged": f"with {_MERGED} select * from m",
    "w16_gaps": f"""with {_GAPS} select * from gap where "end" - "start" >= 0.2""",
    "w18_left": f"""with {_GAPS}, x as (select user_id, "end" - "start" as l from gap where "end" > "start") select user_id, sum(case when l >= 10 then l else 0 end) as gap_miles, sum(case when l < 10 then l else 0 end) as sliver_miles, count(*) filter (l >= 10) as n_gaps from x group by 1""",
    "w19_clipped": f"""with {_MERGED} select user_id, greatest("start", 100) as "start", least("end", 200) as "end" from m where least("end", 200) > greatest("start", 100)""",
    "w20_overlap": f"""with {_MERGED} select user_id, sum(greatest(0, least("end", 200) - greatest("start", 100))) as miles from m group by 1""",
    "w21_axis": f"""with n as (select distinct * from field_notes where lat is not null and lon is not null), p as (select reporter_id, id, lat, lon, lag(lat) over w as pa, lag(lon) over w as po from n window w as (partition by reporter_id order by id))
select id, round(sum(case when pa is null then 0 else {_HAV.format(r="20902231.0")} end) over (order by reporter_id, id) / 5280.0, 4) as mile from p""",
    "w23_interpolated": "select * from (select event_id, round((value + lead(value) over (partition by user_id order by ts, event_id)) / 2, 4) as half from events) where half is not null",
    "w27_rising": "select user_id, event_id, value from (select *, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as h from events) where h is null or value > h",
    "w28_implausible": f"with {_E} select * from (select user_id, event_id, lead(level) over w - level as delta, lead(part_start) over w as seam from e window w as (partition by user_id order by ts, event_id)) where abs(delta) > 400",
    "w31_sections": """with f as (select *, coalesce(case when lag(event_type) over (partition by user_id order by ts, event_id) = 'purchase' then 1 else case when lag(event_type) over (partition by user_id order by ts, event_id) is null then 1 else 0 end end, 1) as b from events),
s as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as section from f) select user_id, cast(section as bigint) as section, min(event_id) as first_id, max(event_id) as last_id, count(*) as n from s group by 1, 2""",
    "w33_walking_days": "select event_id, cast(sum((value >= 10)::int) over (partition by user_id order by ts, event_id) as bigint) as walking_day from events",
    "w34_leading": "with n as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) select user_id, coalesce(min(case when event_type = 'error' then rn end) - 1, count(*)) as leading from n group by 1",
    "w37_previous": "select load_no, lag(snapshot_date::varchar) over (order by load_no) as previous from (select distinct load_no, snapshot_date from poi_snapshots)",
    "st01_divergence": """with f as (select *, value > 20 as off, case when (value > 20) is distinct from lag(value > 20) over (partition by user_id order by ts, event_id) then 1 else 0 end as b from events),
i as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as i from f), h as (select *, epoch(ts - min(ts) over (partition by user_id, i)) / 3600 as h from i)
select event_id, case when h >= 25 then 'push' when h >= 12 then 'cue' else 'silent' end as alert from h where off""",
    "st03_steps": f"""with p as (select user_id, lag(value) over (partition by user_id order by ts, event_id) as x, value as y from events), s as (select user_id, least(x, y) as a, greatest(x, y) as b from p where abs(y - x) <= 30 and x <> y), {_merge("s", "user_id")} select * from m""",
    "st04_daily": f"""with p as (select user_id, ts::date as day, lag(value) over (partition by user_id, ts::date order by ts, event_id) as x, value as y from events), s as (select user_id, day, least(x, y) as a, greatest(x, y) as b from p where abs(y - x) <= 30 and x <> y), {_merge("s", "user_id, day")} select user_id, day, round(sum("end" - "start"), 4) as miles from m group by 1, 2""",
    "a18_quartiles": "select user_id, round(quantile_cont(value, 0.25), 4) as low, round(quantile_cont(value, 0.75), 4) as high from events group by 1",
    "a19_reach": "with d as (select user_id, ts::date as day, cast(sum(round(value * 100)) as bigint) as v from events group by 1, 2) select user_id, case when count(*) >= 5 then quantile_cont(v, 0.25) end as low, case when count(*) >= 5 then quantile_cont(v, 0.75) end as high from d group by 1",
    "a21_upper_median": "with s as (select user_id, value - lag(value) over (partition by user_id order by ts, event_id) as s from events), r as (select *, row_number() over (partition by user_id order by s) as rn, count(*) over (partition by user_id) as n from s where s > 0) select user_id, round(s, 6) as median from r where rn = n // 2 + 1",
    "a22_envelope": f"with {_E}, b as (select *, least(199, cast(floor(event_id % 5000 / 5000.0 * 200) as bigint)) as bucket from e where level is not null), r as (select *, row_number() over (partition by bucket order by level, event_id) as lo, row_number() over (partition by bucket order by level desc, event_id) as hi from b) select bucket, event_id from r where lo = 1 or hi = 1",
    "a32_totals": f"with {_E} select user_id, round(sum(value), 3) as miles, round(coalesce(sum(level), 0), 3) as ascent, round(coalesce(sum(value * 1.609344 / 5.0 * 60.0 + level * 0.3048 / 600.0 * 60.0), 0), 2) as minutes from e group by 1",
    "a41_part_miles": f"""with n as (select distinct * from field_notes where lat is not null and lon is not null), p as (select reporter_id, lat, lon, lag(lat) over w as pa, lag(lon) over w as po from n window w as (partition by reporter_id order by observed_at, id))
select reporter_id, round(coalesce(sum(case when pa is not null then {_HAV.format(r="6371008.8")} end), 0) / 1609.344, 3) as miles from p group by 1""",
    "a43_rising_total": f"with {_E} select user_id, sum(greatest(delta, 0)) as rise from (select user_id, lead(level) over w - level as delta from e window w as (partition by user_id order by ts, event_id)) where abs(delta) > 400 group by 1",
    "n01_minutes": """with p as (select *, p_size::double as miles, p_size * 1.609344 / 5.0 * 60.0 + p_retailprice * 0.3048 / 600.0 * 60.0 as standard, p_size / 2.5 * 60.0 + p_retailprice * 0.3048 / 900.0 * 60.0 + p_size * 10.0 * 0.3048 / 1000.0 * 5.0 as own, p_size / 6.0 as rough, pow(10, floor(log10(p_size / 6.0))) as u from part)
select p_partkey, round(standard, 4) as standard, round(own, 4) as own, round(own / standard, 5) as ratio, round(p_retailprice / greatest(miles * 100, 1), 6) as grade, miles * 100 < 10 or p_retailprice / greatest(miles * 100, 1) <= 0.15 as passes,
  round(case when miles > 20 then 2.25 else 1.0 end * power(miles - 20, 2), 4) as cost, case when rough <= u then u when rough <= u * 2 then u * 2 when rough <= u * 5 then u * 5 else u * 10 end as tick from p""",
    "n08_windows": """with q as (select p_partkey, p_size, least(p_size::double, p_retailprice % 50) as a0, greatest(p_size::double, p_retailprice % 50) as b0 from part),
r as (select *, case when b0 - a0 < 2 then (a0 + b0) / 2 - 1 else a0 end as a1, case when b0 - a0 < 2 then (a0 + b0) / 2 + 1 else b0 end as b1 from q),
s as (select *, greatest(a1, 3) as a2, case when a1 < 3 then b1 + 3 - a1 else b1 end as b2 from r)
select p_partkey, round(case when b2 > 47 then greatest(3.0, a2 - (b2 - 47)) else a2 end, 6) as low, round(least(b2, 47), 6) as high,
  round(least(greatest(p_size - case p_size % 3 when 0 then 1 when 1 then 9 else 5 end, 3), 37)::double, 6) as ribbon_start, round(least(greatest(p_size - case p_size % 3 when 0 then 1 when 1 then 9 else 5 end, 3), 37)::double + 10, 6) as ribbon_end from s""",
    "j36_interval_lookup": "select least(cast(floor(mile / 100) as bigint), 21) as run, count(*) as n from (select distinct * from field_notes) where mile is not null and mile between 0 and 2200 group by 1",
}
