"""Trips, sites and plans along a route: pieces and gaps, slices, windows ahead, edits of a plan's days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequence as S


def gaps_between(df: DataFrame, by: Sequence[str], start: str, end: str, tie: str) -> DataFrame:
    """Adds ``gap``: how far the start of the next row along the axis lies from the end of this one; null for the last."""
    w = Window.partitionBy(*by).orderBy(start, tie)
    return df.withColumn("gap", F.abs(F.lead(start).over(w) - F.col(end)))


def kind_rank(kind: Column, order: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(order)], F.lit(len(order)))


def composition(sites: DataFrame, records: DataFrame, key: str, kind: str, visible: Column, order: Sequence[str]) -> DataFrame:
    """(anchor, pin, kinds): the record whose pin a site shows and the kinds of its visible members, in alphabetical order.

    The anchor carries the pin if it is visible, else the first visible member by the order of kinds, then id; null if none is.
    """
    seen = records.select(F.col(key).alias("member"), F.col(kind).alias("kind"), visible.alias("seen"))
    members = sites.select("anchor", "member").join(seen, "member")
    best = F.min_by(F.when(F.col("seen"), F.col("member")), F.when(F.col("seen"), F.struct(kind_rank(F.col("kind"), order), "member")))
    out = members.groupBy("anchor").agg(best.alias("_first"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("seen"), F.col("kind")))), ",").alias("kinds"))
    own = seen.select(F.col("member").alias("anchor"), F.col("seen").alias("_own"))
    return out.join(own, "anchor").select("anchor", F.when(F.col("_own"), F.col("anchor")).otherwise(F.col("_first")).alias("pin"), "kinds")


def phrases(sites: DataFrame, records: DataFrame, key: str, kind: str, order: Sequence[str], least_m: int) -> DataFrame:
    """(anchor, nearby): one text of a site's members by the order of kinds, distance and id, with distances of at least ``least_m`` metres.

    A site reaches no further than its members' radius, so the list of one anchor is as long as the place is crowded.
    """
    rows = sites.join(records.select(F.col(key).alias("member"), F.col(kind).alias("kind")), "member")
    metres = F.greatest(F.round("metres"), F.lit(float(least_m))).cast("int")
    part = F.struct(kind_rank(F.col("kind"), order).alias("rank"), metres.alias("metres"), "member", F.concat_ws(" ", "kind", metres.cast("string")).alias("text"))
    return rows.groupBy("anchor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "; ").alias("nearby"))


def pieces(trips: DataFrame, by: Sequence[str], start: str, end: str, kind: str, low: float, high: float, least: float) -> DataFrame:
    """Trips by their kind and, as kind ``gap``, the stretches of [low, high] that none of them covers."""
    own = trips.select(*by, F.col(kind).alias("kind"), F.col(start).alias("start"), F.col(end).alias("end"))
    gaps = S.complement(S.merged_intervals(trips, by, start, end), by, low, high, least)
    return own.unionByName(gaps.select(*by, F.lit("gap").alias("kind"), "start", "end"))


def slice_between(vertices: DataFrame, part: str, mile: str, low: float, high: float) -> DataFrame:
    """Vertices of each part between two miles; a part with one there gives its neighbours too, and one with none the pair around the range, if it spans it."""
    w = Window.partitionBy(part).orderBy(mile)
    every = Window.partitionBy(part)
    m, inside = F.col(mile), F.col(mile).between(low, high)
    v = vertices.withColumns({"_in": inside, "_n": F.count(F.when(inside, 1)).over(every), "_next": F.lead(mile).over(w), "_last": F.lag(mile).over(w)})
    around = F.coalesce(F.col("_next").between(low, high), F.lit(False)) | F.coalesce(F.col("_last").between(low, high), F.lit(False))
    pair = F.coalesce((m < low) & (F.col("_next") > high), F.lit(False)) | F.coalesce((m > high) & (F.col("_last") < low), F.lit(False))
    kept = v.where(F.when(F.col("_n") >= 2, F.col("_in")).when(F.col("_n") == 1, F.col("_in") | around).otherwise(pair))
    return kept.withColumn("_k", F.count(F.lit(1)).over(every)).where("_k >= 2").select(*vertices.columns)


def mile_at_minutes(df: DataFrame, by: Sequence[str], order: Sequence[str], miles: str, minutes: str, limit: float) -> DataFrame:
    """(by, mile): how far the steps lead in so many minutes, straight within the step in which they run out; the whole way if they don't."""
    w = Window.partitionBy(*by).orderBy(*order)
    c = df.select(*by, F.col(miles).alias("_m"), F.col(minutes).alias("_t"), F.sum(miles).over(w).alias("_way"), F.sum(minutes).over(w).alias("_until"))
    before = F.col("_until") - F.col("_t")
    there = F.when((before < limit) & (F.col("_until") >= limit), F.col("_way") - F.col("_m") + F.col("_m") * (limit - before) / F.col("_t"))
    return c.groupBy(*by).agg(F.coalesce(F.min(there), F.max("_way")).alias("mile"))


def distance_ahead(start: Column, end: Column, at: Column, way: Column) -> Column:
    """Miles to the near end of a span in the direction of travel: 0 inside, null behind."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    return F.when(at.between(lo, hi), F.lit(0.0)).when((way == "northbound") & (lo > at), lo - at).when((way == "southbound") & (hi < at), at - hi)


def ticks(df: DataFrame, low: str, high: str, step: Column) -> DataFrame:
    """A row for every multiple of the step in [low, high]."""
    s = df.withColumn("_step", step)
    first, last = F.ceil(F.col(low) / F.col("_step")), F.floor(F.col(high) / F.col("_step") + 1e-9)
    return s.where(last >= first).withColumn("tick", F.explode(F.sequence(first, last))).withColumn("tick", F.col("tick") * F.col("_step")).drop("_step")


def insert_day(days: DataFrame, plan: str, n: str, date: str, after: int, values: dict[str, Column]) -> DataFrame:
    """A day more after day ``after`` of every plan that has it; later days move on by one."""
    later = (F.col(n) > after).cast("int")
    moved = days.withColumns({n: F.col(n) + later, date: F.date_add(date, later)})
    new = days.where(F.col(n) == after).withColumns({n: F.col(n) + 1, date: F.date_add(date, 1), **values})
    return moved.unionByName(new)


def remove_day(days: DataFrame, plan: str, n: str, date: str, index: int, removable: Column) -> DataFrame:
    """Day ``index`` of every plan taken out where it may be; later days move back by one."""
    out = F.max(F.when(F.col(n) == index, removable.cast("int"))).over(Window.partitionBy(plan))
    marked = days.withColumn("_out", F.coalesce(out, F.lit(0)))
    back = F.when((F.col("_out") == 1) & (F.col(n) > index), 1).otherwise(0)
    return marked.where((F.col("_out") == 0) | (F.col(n) != index)).withColumns({n: F.col(n) - back, date: F.date_sub(date, back)}).drop("_out")
