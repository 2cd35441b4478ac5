"""What changed between consecutive full snapshots: kept range-partitioned and sorted by key, merged two at a time."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, own_folder, settings
from .history import latest_delivery


def coordinate_changed(now: Column, before: Column, tolerance: float) -> Column:
    """Null in only one of the two, or further apart than the tolerance."""
    return (now.isNull() != before.isNull()) | F.coalesce(F.abs(now - before) > tolerance, F.lit(False))


#: Settings under which a kept table is joined with itself: the range alone decides where a row lies, and each range is one sorted file.
IN_RANGES = {"spark__sql__requireAllClusterKeysForCoPartition": "false", "spark__sql__legacy__bucketedTableScan__outputOrdering": "true"}


def keep_snapshots(df: DataFrame, keys: dict[str, Column], period: str, compared: Sequence[str], recency: Sequence[str], ranges: int | None = None, rows_a_range: int = 20_000) -> str:
    """Name of the kept table of all loads: range-partitioned and sorted by key, then load, one file a range.

    Deliveries of a key in a load are reduced to the latest first (map-side combined, so a key delivered over and over
    is no hot partition). What is left is partitioned by key ranges (about ``rows_a_range`` rows each, at most as many
    as there are shuffle partitions, unless ``ranges`` says how many), sorted and written into the shared folder as a
    table bucketed by the number of the range. Every later reader gets whole ranges without an exchange. Keys that are
    null in any part are dropped. Columns: the range ``_range``, the keys, the load ``_p``, the compared ones ``_c0``...
    """
    spark = df.sparkSession
    cols = [F.col(period).cast("int").alias("_p"), *[c.alias(k) for k, c in keys.items()], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(compared)], *[F.col(c).alias(f"_by{i}") for i, c in enumerate(recency)]]
    values = {f"_c{i}": F.col(f"_c{i}") for i in range(len(compared))}
    rows = latest_delivery(df.select(*cols), [*keys, "_p"], values, [f"_by{i}" for i in range(len(recency))])
    if ranges is None:
        ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_a_range)))
    by = [F.col(k) for k in keys]
    # labels of the ranges that fall into a bucket each, so that a bucket is one range and one file
    bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(ranges))
    labels = spark.range(64 * ranges).groupBy(bucket.alias("b")).agg(F.min("id").cast("int").alias("label"))
    named = F.array(*[F.lit(r["label"]) for r in labels.orderBy("b").collect()])  # one number a range
    ranged = rows.repartitionByRange(ranges, *by).withColumn("_range", F.get(named, F.pmod(F.spark_partition_id(), F.size(named))))
    name = f"cairnlake_kept_{uuid.uuid4().hex}"
    writer = ranged.select("_range", *by, "_p", *values).write.mode("append").format("parquet").option("path", own_folder(spark, "kept"))
    writer.bucketBy(ranges, "_range").sortBy("_range", *keys, "_p").saveAsTable(name)
    return name


def merged_loads(spark: SparkSession, kept: str, keys: Sequence[str], period: str, tolerances: Sequence[float]) -> DataFrame:
    """The merge behind ``changes_of_kept``, to be run under the settings ``IN_RANGES``.

    A load and the one before it are two pointers that move over the same range: a full outer merge join of the kept
    table with itself, in which the side that is behind yields an added or a removed record and equal keys are compared.
    The range stands in the join and both sides lie in the same ranges, so no row is exchanged, and a task holds one row
    of each side at a time.
    """
    loads = spark.table(kept)
    low, high = loads.agg(F.min("_p"), F.max("_p")).first()
    names = ["_range", *keys]
    values = [f"_c{i}" for i in range(len(tolerances))]
    now = loads.select(*names, "_p", F.lit(True).alias("_here"), *values)
    before = loads.select(*names, (F.col("_p") + 1).alias("_p"), F.lit(True).alias("_was"), *[F.col(c).alias(f"_w{c}") for c in values])
    met = now.hint("merge").join(before.hint("merge"), [*names, "_p"], "full_outer")
    differs = F.lit(False)
    for c, tolerance in zip(values, tolerances):
        differs = differs | coordinate_changed(F.col(c), F.col(f"_w{c}"), tolerance)
    kind = F.when(F.col("_was").isNull(), "added").when(F.col("_here").isNull(), "removed").when(differs, "changed")
    return met.where(F.col("_p").between((low or 0) + 1, high or 0)).select(F.col("_p").alias(period), *keys, kind.alias("change_kind")).where("change_kind is not null")


def changes_of_kept(spark: SparkSession, kept: str, keys: Sequence[str], period: str, tolerances: Sequence[float]) -> DataFrame:
    """Typed changes (period, keys, change_kind) of every load of a kept table against the load before, written as they come into the shared folder."""
    with settings(spark, **IN_RANGES):
        return cut(merged_loads(spark, kept, keys, period, tolerances))


def snapshot_changes(df: DataFrame, keys: dict[str, Column], period: str, compared: dict[str, float], recency: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Typed changes (period, keys, change_kind) of every period against the one before, through a kept table.

    ``compared`` gives the tolerance of each numeric column. Periods are consecutive integers between the least and
    greatest in the table; the first has no changes. Keys that are null in any part are dropped; repeated deliveries
    count once; empty tables give no changes; further columns are ignored. ``keep_snapshots`` and ``changes_of_kept``
    may be called by themselves where the kept table serves more than one reader.
    """
    spark = df.sparkSession
    kept = keep_snapshots(df, keys, period, list(compared), recency, partitions)
    return changes_of_kept(spark, kept, list(keys), period, list(compared.values()))
