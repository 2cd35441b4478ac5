"""Stateful operators over position and note streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A Parquet folder or file as a stream with the schema it has now."""
    folder, _, name = path.rpartition("/")
    pattern = f"{folder}/[{name[0]}]{name[1:]}"  # a pattern, as a single file is no stream source
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(pattern)


def windowed_counts(events: DataFrame, at: str, kind: str, width: str, late: str) -> DataFrame:
    """Events by window and kind; what comes later than ``late`` after the newest is left out."""
    e = events.withColumn("_ts", F.col(at).cast("timestamp")).withWatermark("_ts", late)
    out = e.groupBy(F.window("_ts", width), kind).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), kind, "n")


def first_seen(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key once within the watermark: an outbox may send again."""
    return events.withColumn("_ts", F.col(at).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")


def directions(samples: DataFrame, who: str, at: str, mile: str, threshold: float) -> DataFrame:
    """(who, anchor, way, turns) after every batch: direction that turns only after ``threshold`` from the last anchor.

    State is three values a walker; the samples of a batch are replayed in time order.
    """
    kind = samples.schema[who].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        anchor, way, turns = state.get if state.exists else (None, "", 0)
        for value in pd.concat(list(batches)).sort_values([at, mile])[mile]:
            if anchor is None:
                anchor = float(value)
            elif abs(value - anchor) >= threshold:
                now = "NOBO" if value > anchor else "SOBO"
                anchor, turns, way = float(value), turns + (now != way), now
        state.update((anchor, way, turns))
        yield pd.DataFrame({who: [key[0]], "anchor": [anchor], "way": [way or None], "turns": [turns]})

    return samples.select(who, at, mile).groupBy(who).applyInPandasWithState(step, f"{who} {kind}, anchor double, way string, turns long", "anchor double, way string, turns long", "update", "NoTimeout")


def alerts(samples: DataFrame, who: str, at: str, off: str, cue_s: float, push_s: float) -> DataFrame:
    """(who, at, alert) for every diverging sample: how long divergence has lasted decides; any good sample resets."""
    kind = samples.schema[who].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (since,) = state.get if state.exists else (None,)
        rows = []
        for t, bad in pd.concat(list(batches)).sort_values(at)[[at, off]].itertuples(index=False):
            if not bad:
                since = None
                continue
            seconds = pd.Timestamp(t).timestamp()
            since = seconds if since is None else since
            lasted = seconds - since
            rows.append((key[0], t, "push" if lasted >= push_s else "cue" if lasted >= cue_s else "silent"))
        state.update((since,))
        yield pd.DataFrame(rows, columns=[who, at, "alert"])

    return samples.select(who, F.col(at).cast("timestamp").alias(at), off).groupBy(who).applyInPandasWithState(step, f"{who} {kind}, {at} timestamp, alert string", "since double", "append", "NoTimeout")


def run_to_table(stream: DataFrame, folder: str, last_of: list[str] | None = None) -> DataFrame:
    """Run what is there now to the end and give the result as a table written in ``folder``, batch by batch.

    Nothing is collected. A batch that is run again after a failure overwrites its own rows. With ``last_of`` the rows
    are updates of these keys and the one of the latest batch counts; else they are all rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode("update" if last_of else "append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    rows = stream.sparkSession.read.schema(f"{schema}, batch long").parquet(f"{folder}/rows")
    if not last_of:
        return rows.drop("batch")
    newest = rows.groupBy(*last_of).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in last_of]), "batch").alias("_v"))
    return newest.select(*last_of, "_v.*")
