"""History of changing attributes: per-attribute change logs and their combination into versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_delivery(df: DataFrame, keys: Sequence[str], values: dict[str, Column], recency: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the values of the delivery with the greatest ``recency``.

    Deliveries that tie are told apart by their values (the greatest wins, null lowest), so the result does not depend
    on row order. It is an aggregate with map-side combination: a key with any number of deliveries never meets in one task.
    Rows with a null key are dropped. An empty table gives an empty result.
    """
    order = F.struct(*[F.col(c) for c in recency], *values.values())
    out = df.where(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0).groupBy(*keys).agg(
        F.max_by(F.struct(*[c.alias(n) for n, c in values.items()]), order).alias("_row")
    )
    return out.select(*keys, *[F.col("_row")[n].alias(n) for n in values])


def change_log(rows: DataFrame, key: str, period: str, attributes: Sequence[str]) -> DataFrame:
    """Event-sourced log: one row (key, attribute, value, first, last) per longest run of an attribute's value.

    ``rows`` has one row per key and period; periods are consecutive integers. A run ends where the value changes
    (null is a value) or where the key is absent from a period. Values come out as strings. Every attribute has
    intervals of its own. All windows share one partitioning and sort by key.
    """
    w = Window.partitionBy(key).orderBy(period)
    gap = F.coalesce(F.col(period) != F.lag(period).over(w) + 1, F.lit(True))
    starts = {f"_s{i}": (gap | ~F.col(a).eqNullSafe(F.lag(a).over(w))).cast("int") for i, a in enumerate(attributes)}
    runs = rows.select(key, period, *attributes, *[c.alias(n) for n, c in starts.items()])
    runs = runs.select(key, period, *attributes, *[F.sum(f"_s{i}").over(w).alias(f"_r{i}") for i in range(len(attributes))])
    events = runs.select(
        key,
        period,
        F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"), F.col(f"_r{i}").alias("_run")) for i, a in enumerate(attributes)])),
    )
    return events.groupBy(key, "attribute", "_run").agg(F.first("value").alias("value"), F.min(period).alias("first"), F.max(period).alias("last")).drop("_run")


def combine_log(log: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Versions (key, first, last, attribute columns) from per-attribute intervals.

    The intervals are split at the union of all their boundaries; each piece takes every attribute's value then valid
    (null where none is), and neighbouring pieces with equal values are joined again. A time in which no attribute has
    an interval belongs to no version.
    """
    starts = log.select(key, F.col("first").alias("_at"), "attribute", F.struct(F.col("value"), F.col("last").alias("until")).alias("_held"))
    ends = log.select(key, (F.col("last") + 1).alias("_at"), "attribute", F.lit(None).cast(starts.schema["_held"].dataType).alias("_held"))
    cuts = starts.unionByName(ends).groupBy(key, "_at").agg(*[F.max(F.when(F.col("attribute") == a, F.col("_held"))).alias(f"_h{i}") for i, a in enumerate(attributes)])
    w = Window.partitionBy(key).orderBy("_at")
    pieces = cuts.select(key, "_at", F.lead("_at").over(w).alias("_next"), *[F.last(f"_h{i}", ignorenulls=True).over(w).alias(f"_h{i}") for i in range(len(attributes))])
    valid = [F.coalesce(F.col(f"_h{i}")["until"] >= F.col("_at"), F.lit(False)) for i in range(len(attributes))]
    pieces = pieces.select(key, "_at", "_next", *[F.when(v, F.col(f"_h{i}")["value"]).alias(a) for i, (a, v) in enumerate(zip(attributes, valid))], F.greatest(*[v.cast("int") for v in valid], F.lit(0)).alias("_any"))
    pieces = pieces.where("_any = 1 and _next is not null")
    new = F.coalesce(F.col("_at") != F.lag("_next").over(w), F.lit(True))
    for a in attributes:
        new = new | ~F.col(a).eqNullSafe(F.lag(a).over(w))
    joined = pieces.withColumn("_new", new.cast("int")).withColumn("_version", F.sum("_new").over(w))
    return joined.groupBy(key, "_version").agg(F.min("_at").alias("first"), (F.max("_next") - 1).alias("last"), *[F.first(a).alias(a) for a in attributes]).drop("_version")


def attribute_history(df: DataFrame, key: str, period: str, attributes: dict[str, Column], recency: Sequence[str]) -> DataFrame:
    """Every version of every record with the periods in which it was valid.

    ``df`` holds full loads: one or more deliveries per key and period. Repeated deliveries are reduced to the latest;
    rows with a null key or period are dropped; an empty table gives no versions; further columns are ignored.
    """
    source = df.select(F.col(key), F.col(period).cast("int").alias("_period"), *[c.cast("string").alias(f"_v{i}") for i, c in enumerate(attributes.values())], *[F.col(c).alias(f"_by{i}") for i, c in enumerate(recency)])
    names = list(attributes)
    rows = latest_delivery(source, [key, "_period"], {n: F.col(f"_v{i}") for i, n in enumerate(names)}, [f"_by{i}" for i in range(len(recency))])
    return combine_log(change_log(rows, key, "_period", names), key, names)
