"""Whole-table operators: differences, merges, uploads, assertions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_difference(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, what, a_value, b_value): keys on one side only (what only_a or only_b) and metrics that differ, null-safely."""
    x = a.select(*keys, F.struct(*[F.col(m).cast("string").alias(m) for m in metrics]).alias("_a"))
    y = b.select(*keys, F.struct(*[F.col(m).cast("string").alias(m) for m in metrics]).alias("_b"))
    j = x.join(y, keys, "full_outer")
    missing = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b")
    each = [F.struct(F.lit(m).alias("what"), F.col(f"_a.{m}").alias("a_value"), F.col(f"_b.{m}").alias("b_value")) for m in metrics]
    none = F.lit(None).cast("string")
    rows = F.when(missing.isNotNull(), F.array(F.struct(missing.alias("what"), none.alias("a_value"), none.alias("b_value")))).otherwise(F.filter(F.array(*each), lambda e: ~e["a_value"].eqNullSafe(e["b_value"])))
    return j.select(*keys, F.inline(rows))


def overlay(local: DataFrame, remote: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Local rows win, rows only the remote has survive."""
    x, y = local.select(F.col(key), F.struct(*values).alias("_l")), remote.select(F.col(key), F.struct(*values).alias("_r"))
    return x.join(y, key, "full_outer").select(key, F.coalesce("_l", "_r").alias("_v")).select(key, *[F.col(f"_v.{v}").alias(v) for v in values])


def resolve_uploads(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """Writes (id, document, deleted, is_copy) for uploaded rows against stored ones, at most two each.

    Both frames have id, document, deleted and a stamp: base_updated_at (what the device last saw) and updated_at. New
    and unseen-since rows are written; deleting twice and sending what is stored already write nothing; anything else is
    a conflict: the stored row stays and the device's goes beside it under a new id; a conflicting delete is applied and
    the stored document is kept beside it.
    """
    s = stored.select("id", F.col("document").alias("_doc"), F.col("deleted").alias("_del"), "updated_at", F.lit(True).alias("_have"))
    j = uploads.join(s, "id", "left")
    write = lambda i, doc, gone, copy: F.struct(i.alias("id"), doc.alias("document"), gone.alias("deleted"), F.lit(copy).alias("is_copy"))
    ident, copy_id, no = F.col("id"), F.md5(F.concat(F.col("id").cast("string"), F.lit("-copy"))), F.lit(False)
    own = F.array(write(ident.cast("string"), F.col("document"), F.col("deleted"), False))
    both = F.array(write(ident.cast("string"), F.lit(None).cast("string"), F.lit(True), False), write(copy_id, F.col("_doc"), no, True))
    beside = F.array(write(copy_id, F.col("document"), no, True))
    nothing = F.slice(own, 1, 0)
    seen = F.coalesce(F.col("base_updated_at") == F.col("updated_at"), no)
    same = ~F.col("deleted") & F.col("document").eqNullSafe(F.col("_doc"))
    rows = F.when(F.col("_have").isNull() | seen, own).when((F.col("_del") & F.col("deleted")) | same, nothing).when(F.col("deleted"), both).otherwise(beside)
    return j.select(F.inline(rows))


def apply_writes(stored: DataFrame, writes: DataFrame) -> DataFrame:
    """Rewrite-merge: rows with a write are replaced, the others kept; a tombstone once set keeps its time."""
    kept = stored.join(writes.select("id"), "id", "left_anti")
    return kept.unionByName(writes.select(*stored.columns))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(problem, n) of rows that break a rule; a null rule result counts as broken. One pass over the table."""
    counts = df.agg(*[F.sum((~F.coalesce(ok, F.lit(False))).cast("long")).alias(n) for n, ok in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("problem"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for n in rules])))


def row_problems(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks, in their order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drops(current: DataFrame, baseline: DataFrame, key: str, n: str, most: float = 0.10) -> DataFrame:
    """Keys that lost more than a share of their count; zero and absent baselines are passed over."""
    j = baseline.select(key, F.col(n).alias("before")).join(current.select(key, F.col(n).alias("after")), key, "left")
    after = F.coalesce("after", F.lit(0))
    return j.where(F.col("before") > 0).select(key, "before", after.alias("after"), ((F.col("before") - after) / F.col("before") > most).alias("dropped"))


def next_with_suffix(taken: DataFrame, column: str, stem: str) -> DataFrame:
    """One row: the stem if free, else the stem with the first free suffix from 2 on, however many are taken.

    Suffixes in use are numbered in order; the first that is not its own number leaves a gap before it.
    """
    number = F.when(F.col(column) == stem, F.lit(1)).otherwise(F.regexp_extract(F.col(column), "^" + re.escape(stem) + "-([1-9][0-9]*)$", 1).try_cast("long"))
    used = taken.select(number.alias("_n")).where("_n >= 1").distinct()
    ends = used.select((F.col("_n") + 1).alias("_n")).unionByName(taken.sparkSession.range(1, 2).select(F.col("id").alias("_n"))).join(used, "_n", "left_anti")
    first = ends.agg(F.min("_n").alias("_n"))
    return first.select(F.when(F.col("_n") == 1, F.lit(stem)).otherwise(F.concat(F.lit(stem + "-"), F.col("_n").cast("string"))).alias(column))


def stratified_sample(df: DataFrame, key: str, stratum: str, seed: int, n: int) -> DataFrame:
    """Deterministic sample, taken from the strata in turn. Sampling is the feature.

    No more than ``n`` rows of a stratum can be taken; each map task cuts its own to so many before the shuffle, so a
    large stratum is no hot partition.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    ranked = df.withColumn("_h", h).withColumn("round", F.row_number().over(Window.partitionBy(stratum).orderBy("_h"))).where(F.col("round") <= n)
    return ranked.orderBy("round", stratum).limit(n).drop("_h")
