"""Field conditions: ranked recency, corroboration and decay, roll-ups, coverage by stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_recent(df: DataFrame, place: Column, at: str, tie: str, k: int) -> DataFrame:
    """The k most recent rows of each place (ties: smaller ``tie``). Catalyst cuts each map task's rows to k a place before the shuffle, so a crowded place is no hot partition."""
    w = Window.partitionBy("_place").orderBy(F.desc(at), tie)
    return df.withColumn("_place", place).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_place")


def beyond_recent(df: DataFrame, place: str, at: str, tie: str, k: int) -> DataFrame:
    """What lies beyond the k most recent rows of each place.

    The k-th row of each place comes from ``top_recent``, which no crowded place burdens; every row is then compared with
    it by an equi-join that keeps one row a place, so no task ranks all rows of a place. Rows of one place are distinct
    in time and ``tie``.
    """
    last = top_recent(df, F.col(place), at, tie, k).where(F.col("rank") == k).select(place, F.col(at).alias("_at"), F.col(tie).alias("_tie"))
    older = (F.col(at) < F.col("_at")) | ((F.col(at) == F.col("_at")) & (F.col(tie) > F.col("_tie")))
    return df.join(last, place).where(older).drop("_at", "_tie")


def disputes(notes: DataFrame, place: str, who: str, at: str, disputing: Column, maintainer: Column, now: Column, decay_days: int = 180, least: int = 2) -> DataFrame:
    """Verdict per place: (latest, accounts, maintainer_said, reported_missing).

    A place is reported missing if within the window a maintainer or ``least`` accounts dispute it, unless a maintainer
    or as many accounts confirmed it after the last dispute. Past the window there is no verdict. Two aggregates with
    map-side combination; the confirming rows need the last dispute first, by a join on the place.
    """
    rows = notes.where(F.col(place).isNotNull()).select(F.col(place).alias("place"), F.col(who).alias("who"), F.col(at).alias("at"), F.coalesce(disputing, F.lit(False)).alias("bad"), F.coalesce(maintainer, F.lit(False)).alias("keeper"))
    cutoff = now - F.expr(f"interval {decay_days} days")
    live = F.col("bad") & (F.col("at") >= cutoff)
    said = rows.groupBy("place").agg(F.max(F.when(F.col("bad"), F.col("at"))).alias("latest"), F.countDistinct(F.when(live, F.col("who"))).alias("accounts"), F.max(live & F.col("keeper")).alias("maintainer_said")).where("latest is not null")
    after = rows.where("not bad").join(said.select("place", "latest"), "place").where("at > latest")
    answered = after.groupBy("place").agg(F.countDistinct("who").alias("_n"), F.max("keeper").alias("_keeper"))
    out = said.join(answered, "place", "left")
    current = F.col("latest") >= cutoff
    cleared = F.coalesce(F.col("_keeper") | (F.col("_n") >= least), F.lit(False))
    return out.select(F.col("place").alias(place), "latest", F.when(current, F.col("accounts")).otherwise(F.lit(0)).alias("accounts"), (current & F.col("maintainer_said")).alias("maintainer_said"), (current & (F.col("maintainer_said") | (F.col("accounts") >= least)) & ~cleared).alias("reported_missing"))


def roll_up(notes: DataFrame, place: str, at: str, tag: str, tie: str, now: Column, contested_days: int = 14) -> DataFrame:
    """Per place: last time, newest tag, and the pair of tags that disagree within the window (null if they don't)."""
    rows = notes.where(F.col(place).isNotNull())
    order = F.struct(F.col(at), F.col(tie))
    recent = F.col(tag).isNotNull() & (F.col(at) >= now - F.expr(f"interval {contested_days} days"))
    first = rows.groupBy(place).agg(F.max(at).alias("last_at"), F.max_by(tag, order).alias("newest"), F.max_by(F.when(recent, F.col(tag)), F.when(recent, order)).alias("said"))
    other = rows.where(recent).join(first.select(place, "said"), place).where(F.col(tag) != F.col("said")).groupBy(place).agg(F.max_by(tag, order).alias("against"))
    out = first.join(other, place, "left")
    return out.select(place, "last_at", "newest", F.when(F.col("against").isNotNull(), F.col("said")).alias("said"), "against")


def zero_filled(counts: DataFrame, key: str, n: str, vocabulary: list[str]) -> DataFrame:
    """Counts for the whole vocabulary, 0 where absent; unknown keys stay. The vocabulary is a fixed list."""
    seed = counts.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{key} string")
    return counts.join(F.broadcast(seed), key, "full_outer").select(key, F.coalesce(n, F.lit(0)).cast("long").alias(n))


def stabbing(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: float, conditions: Column | None = None, how: str = "inner") -> DataFrame:
    """Join points with the spans that hold them (closed ends, either order of ends) by equal bins, then exactly.

    Every span is written into each bin it touches; choose ``width`` near the usual length of a span. The point meets a
    span in one bin only, so nothing is doubled.
    """
    lo, hi = F.least(low, high), F.greatest(low, high)
    keyed = spans.where(F.col(low).isNotNull() & F.col(high).isNotNull()).withColumn("_bin", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    placed = points.withColumn("_bin", F.floor(F.col(at) / width))
    on = (placed["_bin"] == keyed["_bin"]) & placed[at].between(F.least(keyed[low], keyed[high]), F.greatest(keyed[low], keyed[high]))
    if conditions is not None:
        on = on & conditions
    joined = placed.join(keyed, on, how)
    return joined.drop(placed["_bin"]).drop(keyed["_bin"]) if how in ("inner", "left") else joined.drop("_bin")


def nearest_ahead(df: DataFrame, lane: Column, ahead: Column, tie: str) -> DataFrame:
    """The nearest row ahead in each lane; rows behind have a null ``ahead``."""
    return df.withColumn("lane", lane).withColumn("ahead", ahead).where("ahead is not null").groupBy("lane").agg(F.min_by(F.struct("*"), F.struct("ahead", tie)).alias("_r")).select("_r.*")
