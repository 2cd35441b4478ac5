"""Day planning as a relaxation over ordered stops: one fold per hike, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
CAP_MI, OVER_WEIGHT, CAMPSITE_MARGIN = 25.0, 2.25, 0.02


def day_price(size: Column, target: Column, over: float, camp: Column) -> Column:
    """The square of what a day is off the target, more above it; ending at a campsite costs a little."""
    off = size - target
    nudge = F.when(camp, target * target * CAMPSITE_MARGIN**2).otherwise(0.0)
    return F.when(off > 0, F.lit(over)).otherwise(F.lit(1.0)) * off * off + nudge


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _reachable(recent: Column, mile: Column, cap: float) -> Column:
    """Stops from which a day may end here: those within the cap; the nearest one where there are none."""
    return _let(F.filter(recent, lambda s: F.abs(mile - s["mile"]) <= cap), lambda near: F.when(F.size(near) > 0, near).otherwise(F.slice(recent, -1, 1)))


def _days_of(stops: Column, way: Column) -> Column:
    """Days (day, from_mile, to_mile) between the places of a way."""
    return F.transform(F.sequence(F.lit(1), F.size(way) - 1), lambda k: F.struct(k.alias("day"), F.get(stops, F.get(way, k - 1))["mile"].alias("from_mile"), F.get(stops, F.get(way, k))["mile"].alias("to_mile")))


def _cheapest(stops: Column, target: Column, cap: float, over: float) -> Column:
    """Days of the cheapest way from the first stop to the last, the earlier predecessor on ties.

    The fold carries the stops still in reach with the cost of getting there, and of every stop the one before it.
    """
    at = lambda i, mile, cost: F.struct(i.alias("i"), mile.alias("mile"), cost.alias("cost"))
    start = F.struct(F.array(at(F.lit(0), F.get(stops, F.lit(0))["mile"], F.lit(0.0))).alias("recent"), F.array(F.lit(-1)).alias("back"))

    def step(acc: Column, stop: Column) -> Column:
        def reached(near: Column) -> Column:
            ways = F.transform(near, lambda s: F.struct((s["cost"] + day_price(F.abs(stop["mile"] - s["mile"]), target, over, stop["camp"])).alias("cost"), s["i"].alias("i")))
            return _let(F.array_min(ways), lambda best: F.struct(F.concat(near, F.array(at(F.size(acc["back"]), stop["mile"], best["cost"]))).alias("recent"), F.concat(acc["back"], F.array(best["i"])).alias("back")))

        return _let(_reachable(acc["recent"], stop["mile"], cap), reached)

    back = F.aggregate(F.slice(stops, 2, F.greatest(F.size(stops) - 1, F.lit(0))), start, step, lambda acc: acc["back"])
    end = F.struct(F.array(F.size(stops) - 1).alias("way"), back.alias("back"))

    def before(acc: Column, i: Column) -> Column:
        return F.when(F.get(acc["way"], F.lit(0)) == i, F.struct(F.concat(F.array(F.get(acc["back"], i)), acc["way"]).alias("way"), acc["back"].alias("back"))).otherwise(acc)

    return F.aggregate(F.reverse(F.sequence(F.lit(1), F.size(stops) - 1)), end, before, lambda acc: _days_of(stops, acc["way"]))


def _cheapest_in(stops: Column, days: int, target: Column, cap: float, over: float) -> Column:
    """The same in exactly so many days; null where there is no way. Costs stand in layers, one for each number of days."""
    none = F.lit(None).cast("double")
    at = lambda i, mile, costs: F.struct(i.alias("i"), mile.alias("mile"), costs.alias("costs"))
    layers = F.sequence(F.lit(1), F.lit(days))
    start = F.struct(
        F.array(at(F.lit(0), F.get(stops, F.lit(0))["mile"], F.concat(F.array(F.lit(0.0)), F.transform(layers, lambda _: none)))).alias("recent"),
        F.array(F.transform(layers, lambda _: F.lit(-1))).alias("back"),
        none.alias("total"),
    )

    def step(acc: Column, stop: Column) -> Column:
        def reached(near: Column) -> Column:
            priced = F.transform(near, lambda s: F.struct(s["i"].alias("i"), s["costs"].alias("costs"), F.abs(stop["mile"] - s["mile"]).alias("size")))
            priced = F.transform(priced, lambda s: F.struct(s["i"].alias("i"), s["costs"].alias("costs"), day_price(s["size"], target, over, stop["camp"]).alias("price")))

            def layer(k: Column, ways: Column) -> Column:
                had = F.filter(ways, lambda s: F.get(s["costs"], k - 1).isNotNull())
                return F.array_min(F.transform(had, lambda s: F.struct((F.get(s["costs"], k - 1) + s["price"]).alias("cost"), s["i"].alias("i"))))

            def with_best(best: Column) -> Column:
                costs = F.concat(F.array(none), F.transform(best, lambda b: b["cost"]))
                return F.struct(F.concat(near, F.array(at(F.size(acc["back"]), stop["mile"], costs))).alias("recent"), F.concat(acc["back"], F.array(F.transform(best, lambda b: F.coalesce(b["i"], F.lit(-1))))).alias("back"), F.element_at(best, -1)["cost"].alias("total"))

            return _let(_let(priced, lambda ways: F.transform(layers, lambda k: layer(k, ways))), with_best)

        return _let(_reachable(acc["recent"], stop["mile"], cap), reached)

    solved = F.aggregate(F.slice(stops, 2, F.greatest(F.size(stops) - 1, F.lit(0))), start, step, lambda acc: F.struct(acc["back"].alias("back"), acc["total"].alias("total")))
    end = F.struct(F.array(F.size(stops) - 1).alias("way"), solved.alias("solved"))

    def before(acc: Column, k: Column) -> Column:
        i = F.greatest(F.get(acc["way"], F.lit(0)), F.lit(0))
        return F.struct(F.concat(F.array(F.get(F.get(acc["solved"]["back"], i), k - 1)), acc["way"]).alias("way"), acc["solved"].alias("solved"))

    return F.aggregate(F.reverse(layers), end, before, lambda acc: F.when(acc["solved"]["total"].isNotNull(), _days_of(stops, acc["way"])))


def planned_days(stops: DataFrame, hike: str | list[str], mile: str, campsite: str, target: float, days: int | None = None, cap: float = CAP_MI, over: float = OVER_WEIGHT) -> DataFrame:
    """(hike, day, from_mile, to_mile) for every hike, from its first stop to its last.

    Days longer than the cap happen only where no stop is in reach. With ``days`` the number of days is fixed and the
    target is their mean; hikes for which that can't be done have no rows, nor have those with fewer than two stops. The
    stops of a hike (some hundred) are one row; hikes run in parallel, and a stop looks back no further than the cap.
    """
    by = [hike] if isinstance(hike, str) else hike
    rows = stops.where(F.col(mile).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(mile).cast("double").alias("mile"), F.coalesce(F.col(campsite), F.lit(False)).alias("camp")))).alias("_stops"))
    rows = rows.where(F.size("_stops") >= max(2, (days or 1) + 1))
    s = F.col("_stops")
    if days:
        way = _cheapest_in(s, days, F.abs(F.element_at(s, -1)["mile"] - F.get(s, F.lit(0))["mile"]) / days, cap, over)
    else:
        way = _cheapest(s, F.lit(float(target)), cap, over)
    return rows.select(*by, F.inline(way))


def candidate_stops(stops: DataFrame, hike: str, mile: str, campsite: str, low: float, high: float) -> DataFrame:
    """Stops of each hike strictly between two miles, and the two miles themselves as termini that are no camps."""
    inside = stops.where((F.col(mile) > low) & (F.col(mile) < high)).select(hike, mile, campsite)
    ends = stops.select(hike).distinct().select(hike, F.explode(F.array(F.lit(low), F.lit(high))).alias(mile), F.lit(False).alias(campsite))
    return inside.unionByName(ends)


def planned_via(stops: DataFrame, hike: str, mile: str, campsite: str, points: list[float], target: float) -> DataFrame:
    """Days over a route through given miles: every leg planned by itself, laid end to end."""
    legs = None
    for k, (a, b) in enumerate(zip(points, points[1:])):
        leg = candidate_stops(stops, hike, mile, campsite, a, b).withColumn("_leg", F.lit(k))
        legs = leg if legs is None else legs.unionByName(leg)
    days = planned_days(legs, [hike, "_leg"], mile, campsite, target)
    number = F.row_number().over(Window.partitionBy(hike).orderBy("_leg", "day"))
    return days.withColumn("day", number).drop("_leg")


def with_rests(days: DataFrame, hike: str, day: str, walked: str, every: int) -> DataFrame:
    """Adds a rest after every so many walking days (never after the last): ``shift`` is how many rests come before a day."""
    w = Window.partitionBy(hike).orderBy(day)
    last = F.max(day).over(Window.partitionBy(hike))
    count = F.sum(F.col(walked).cast("int")).over(w)
    out = days.withColumn("_c", count).withColumn("rest_after", F.col(walked) & (F.col("_c") % every == 0) & (F.col(day) < last))
    return out.withColumn("shift", F.sum(F.col("rest_after").cast("int")).over(w) - F.col("rest_after").cast("int")).drop("_c")


def cheapest_slot(points: DataFrame, route: str, seq: str, mile: str, new_mile: str) -> DataFrame:
    """(route, slot, cost): where a new point lengthens a route least; the later slot on ties. Slot k comes before the k-th point."""
    w = Window.partitionBy(route).orderBy(seq)
    p = points.withColumn("_prev", F.lag(mile).over(w)).withColumn("_i", F.row_number().over(w) - 1)
    new = F.col(new_mile)
    before = F.when(F.col("_prev").isNull(), F.abs(F.col(mile) - new)).otherwise(F.abs(new - F.col("_prev")) + F.abs(F.col(mile) - new) - F.abs(F.col(mile) - F.col("_prev")))
    end = p.groupBy(route).agg(F.max_by(F.abs(new - F.col(mile)), seq).alias("cost"), F.count(F.lit(1)).cast("int").alias("slot"))
    slots = p.select(route, before.alias("cost"), F.col("_i").cast("int").alias("slot")).unionByName(end)
    return slots.groupBy(route).agg(F.min_by(F.struct("slot", "cost"), F.struct("cost", -F.col("slot"))).alias("_s")).select(route, "_s.slot", "_s.cost")
