"""Ordered-sequence operators: islands, intervals, turning points, running maxima. Windows only, or one fold per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number the runs of each partition: a row where ``breaks`` is true (null counts as true) starts a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int"))
    return marked.withColumn(name, F.sum("_break").over(w)).drop("_break")


def equal_runs(df: DataFrame, by: Sequence[str], at: str, key: str, most_gap: float, widen: float) -> DataFrame:
    """Contiguous stretches of one key (null is a key) along an axis, broken by gaps over ``most_gap`` and widened on both ends."""
    w = Window.partitionBy(*by).orderBy(at)
    same = F.col(key).eqNullSafe(F.lag(key).over(w)) & (F.col(at) - F.lag(at).over(w) <= most_gap)
    runs = islands(df, by, [at], ~F.coalesce(same, F.lit(False)))
    return runs.groupBy(*by, "island").agg(F.first(key).alias(key), (F.min(at) - widen).alias("start"), (F.max(at) + widen).alias("end"), F.count(F.lit(1)).alias("n"))


def pin_to_ends(runs: DataFrame, by: Sequence[str], low: float, high: float) -> DataFrame:
    """Stretch the outermost runs of each partition to the ends of the axis."""
    w = Window.partitionBy(*by)
    start = F.when(F.col("start") == F.min("start").over(w), F.lit(low)).otherwise(F.col("start"))
    end = F.when(F.col("end") == F.max("end").over(w), F.lit(high)).otherwise(F.col("end"))
    return runs.withColumns({"_s": start, "_e": end}).drop("start", "end").withColumnsRenamed({"_s": "start", "_e": "end"})


def merged_intervals(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Union of intervals per partition; touching ones merge, either order of ends is read, empty and null ones are dropped."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    spans = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) != F.col(end)) & ~F.isnan(F.col(start).cast("double")) & ~F.isnan(F.col(end).cast("double"))).select(*by, lo.alias("start"), hi.alias("end"))
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = islands(spans.withColumn("_reach", F.max("end").over(before)), by, ["start", "end"], F.col("start") > F.col("_reach"))
    return runs.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def complement(merged: DataFrame, by: Sequence[str], low: float, high: float, least: float = 0.0) -> DataFrame:
    """What merged intervals leave of [low, high], pieces of at least ``least`` (and not empty). Partitions without intervals have no rows to speak of."""
    ends = merged.groupBy(*by).agg(F.lit(low).alias("start"), F.lit(low).alias("end"))
    clipped = clip(merged, low, high)
    w = Window.partitionBy(*by).orderBy("start", "end")
    gaps = ends.unionByName(clipped).select(*by, F.col("end").alias("start"), F.coalesce(F.lead("start").over(w), F.lit(high)).alias("end"))
    return gaps.where((F.col("end") - F.col("start") >= least) & (F.col("end") > F.col("start")))


def clip(spans: DataFrame, low: float, high: float) -> DataFrame:
    """Cut spans to bounds; what falls outside is dropped."""
    out = spans.withColumns({"start": F.greatest("start", F.lit(low)), "end": F.least("end", F.lit(high))})
    return out.where("end > start")


def overlap(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Length of the common part of two spans, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(end, high) - F.greatest(start, low))


def _climbs(levels: Column, threshold: float) -> Column:
    """Array of structs (trough, peak, gain) of places in the run: every confirmed climb, and the open one at the end.

    ``levels`` is an ordered array of structs (at, v). The walk has a way (up or down, 0 until the levels first differ by
    the threshold), the tip it has reached in that way, and the base it set out from, which was the tip before. A level
    beyond the tip moves it (one level with a trough moves it too); a level that lies back from it by the threshold
    turns the walk: the tip becomes the base. A turn from up to down confirms the climb from base to tip.
    """
    done = lambda base, tip: F.struct(base["at"].alias("trough"), tip["at"].alias("peak"), (tip["v"] - base["v"]).alias("gain"))
    walk = lambda base, tip, way, climbed: F.struct(base.alias("base"), tip.alias("tip"), way.alias("way"), climbed.alias("done"))
    first = F.get(levels, F.lit(0))
    start = walk(first, first, F.lit(0), F.filter(F.array(done(first, first)), lambda _: F.lit(False)))

    def open_(s: Column, p: Column) -> Column:
        low, high = F.when(p["v"] <= s["base"]["v"], p).otherwise(s["base"]), F.when(p["v"] > s["tip"]["v"], p).otherwise(s["tip"])
        apart, rising = high["v"] - low["v"] >= threshold, p["v"] >= high["v"]
        return F.when(apart & ~rising, walk(high, low, F.lit(-1), s["done"])).otherwise(walk(low, high, F.when(apart, 1).otherwise(0), s["done"]))

    def step(s: Column, p: Column) -> Column:
        on = F.when(s["way"] == 1, p["v"] > s["tip"]["v"]).otherwise(p["v"] <= s["tip"]["v"])
        back = (s["tip"]["v"] - p["v"]) * s["way"] >= threshold
        climbed = F.when(s["way"] == 1, F.concat(s["done"], F.array(done(s["base"], s["tip"])))).otherwise(s["done"])
        under_way = F.when(on, walk(s["base"], p, s["way"], s["done"])).when(back, walk(s["tip"], p, -s["way"], climbed)).otherwise(s)
        return F.when(s["way"] == 0, open_(s, p)).otherwise(under_way)

    finish = lambda s: F.when(s["way"] == 1, F.concat(s["done"], F.array(done(s["base"], s["tip"])))).otherwise(s["done"])
    return F.aggregate(F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), start, step, finish)


def climbs(levels: Column, threshold: float) -> Column:
    """Array of structs (trough, peak): the places of every confirmed climb, and of the open one at the end, in order."""
    return F.transform(_climbs(levels, threshold), lambda c: F.struct(c["trough"].alias("trough"), c["peak"].alias("peak")))


def ascent(levels: Column, threshold: float) -> Column:
    """Confirmed climb over an ordered array of levels: what all climbs gain. Under two levels the answer is 0."""
    points = F.transform(levels, lambda v, i: F.struct(i.alias("at"), v.cast("double").alias("v")))
    total = F.aggregate(_climbs(points, threshold), F.lit(0.0), lambda a, c: a + c["gain"])
    return F.when(F.size(levels) < 2, F.lit(0.0)).otherwise(total)


def ascent_over_gaps(levels: Column, threshold: float) -> Column:
    """Confirmed climb over an array of levels with gaps: each stretch between nulls counts by itself."""
    empty = F.array().cast("array<double>")

    def add(runs: Column, v: Column) -> Column:
        last = F.element_at(runs, -1)
        return F.when(v.isNull(), F.concat(runs, F.array(empty))).otherwise(F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.concat(last, F.array(v)))))

    runs = F.aggregate(F.transform(levels, lambda v: v.cast("double")), F.array(empty), add)
    return F.aggregate(F.transform(runs, lambda r: ascent(r, threshold)), F.lit(0.0), lambda a, v: a + v)


def profile_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], level: str, part_start: str | None = None) -> DataFrame:
    """(by, run, levels): unbroken runs of a profile, split at null levels and at part starts, levels in order.

    One run is one array: a profile of a whole trail is a few megabytes, and parallelism is across runs.
    """
    null = F.col(level).isNull()
    broken = null | (F.coalesce(F.col(part_start), F.lit(False)) if part_start else F.lit(False))
    runs = islands(df, by, order, broken, "run").where(~null)
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(level).alias("_v"))))
    return runs.groupBy(*by, "run").agg(F.transform(ordered, lambda x: x["_v"]).alias("levels"))


def ascent_over_profile(df: DataFrame, by: Sequence[str], order: Sequence[str], level: str, threshold: float, part_start: str | None = None, sign: int = 1) -> DataFrame:
    """Total climb per partition, summed over unbroken runs; ``sign`` -1 gives the descent."""
    runs = profile_runs(df.withColumn(level, F.col(level) * sign), by, order, level, part_start)
    return runs.groupBy(*by).agg(F.sum(ascent(F.col("levels"), threshold)).alias("ascent"))


def rising_only(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is above everything before them: a strictly increasing axis; the others are dropped."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_high", F.max(value).over(before)).where(F.col("_high").isNull() | (F.col(value) > F.col("_high"))).drop("_high")


def reversed_window(df: DataFrame, by: Sequence[str], order: str, break_flag: str) -> DataFrame:
    """Walk the rows the other way: ``step`` counts from the end, and each break flag moves to the row that then comes after it."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    moved = F.coalesce(F.lag(break_flag).over(w), F.lit(False))
    return df.withColumn("step", F.row_number().over(w)).withColumn(break_flag, moved)


def running_totals(df: DataFrame, order: str, totals: dict[str, Column]) -> DataFrame:
    """Adds running totals over the whole table in order of ``order``, up to and with each row, without one task for all rows.

    Rows are range-partitioned and written with the number of their range; the sums of the ranges (one row each) are
    summed up in their order, and each range adds its own running totals. Equal values of ``order`` stay in one range.
    """
    ranged = cut(df.withColumns({f"_t{i}": c for i, c in enumerate(totals.values())}).repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    sums = [F.sum(f"_t{i}").alias(f"_s{i}") for i in range(len(totals))]
    w = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(*sums).select("_range", *[F.coalesce(F.sum(f"_s{i}").over(w), F.lit(0)).alias(f"_b{i}") for i in range(len(totals))])
    own = Window.partitionBy("_range").orderBy(order)
    out = ranged.join(F.broadcast(before), "_range")  # as many rows as there are partitions
    return out.select(*df.columns, *[(F.col(f"_b{i}") + F.sum(f"_t{i}").over(own)).alias(n) for i, n in enumerate(totals)])


def cumulative_miles(df: DataFrame, part: str, vertex: str, step_ft: Column) -> DataFrame:
    """Running mile over parts in order, no step across a part boundary; ``step_ft`` is the length from the vertex before in the part."""
    inside = Window.partitionBy(part).orderBy(vertex)
    own = df.withColumn("_step", F.coalesce(step_ft, F.lit(0.0)))
    own = own.withColumn("_along", F.sum("_step").over(inside))
    lengths = own.groupBy(part).agg(F.max("_along").alias("_length"))  # one row a part
    offsets = running_totals(lengths, part, {"_until": F.col("_length")}).select(part, (F.col("_until") - F.col("_length")).alias("_offset"))
    return own.join(offsets, part).withColumn("mile", (F.col("_offset") + F.col("_along")) / 5280.0).drop("_step", "_along", "_offset")
