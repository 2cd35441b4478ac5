"""GeoJSON and other text sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, exists, rename

POINT = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
FEATURE = T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", POINT)])
COLLECTION = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(FEATURE))])


def read_points(spark: SparkSession, path: str, loaded_at: str) -> DataFrame:
    """Point features of GeoJSON files by a declared schema: id, properties, lon, lat, _loaded_at, _source_path.

    Features without a geometry keep null positions; so do geometries of other types.
    """
    return point_features(spark.read.schema(COLLECTION).option("multiLine", True).json(path), loaded_at)


def point_features(raw: DataFrame, loaded_at: str) -> DataFrame:
    """The features of collections, one row each; lines of one collection each are as good as whole files."""
    path = F.col("_source_path") if "_source_path" in raw.columns else F.input_file_name().alias("_source_path")
    f = raw.select(F.explode("features").alias("f"), path)
    xy = F.when(F.col("f.geometry.type") == "Point", F.col("f.geometry.coordinates"))
    return f.select(F.col("f.id").alias("id"), F.col("f.properties").alias("properties"), F.get(xy, F.lit(0)).alias("lon"), F.get(xy, F.lit(1)).alias("lat"), F.lit(loaded_at).cast("timestamp_ntz").alias("_loaded_at"), "_source_path")


def read_pages(spark: SparkSession, folder: str, loaded_at: str) -> DataFrame:
    """Features of a layer that was fetched page by page into page-<n>.json; what comes after the first page that says it is the last is left over from an older fetch and not read."""
    schema = T.StructType([*COLLECTION.fields, T.StructField("exceededTransferLimit", T.BooleanType())])
    raw = spark.read.schema(schema).json(folder).select("*", F.col("_metadata.file_path").alias("_source_path"))
    raw = raw.withColumn("_page", F.regexp_extract("_source_path", r"page-([0-9]+)\.json", 1).cast("int"))
    last = raw.where("not coalesce(exceededTransferLimit, false)").agg(F.min("_page").alias("_last"))  # one row
    kept = raw.join(F.broadcast(last), F.col("_last").isNull() | (F.col("_page") <= F.col("_last")))
    return point_features(kept.select("features", "_source_path"), loaded_at)


def registered_layers(registry: DataFrame, extras: list[tuple[str, str]]) -> DataFrame:
    """(name) of the tables that load: the registry's layers without a kind, and fixed extra ones (provider, key)."""
    more = registry.sparkSession.createDataFrame(extras, "provider string, key string")
    own = registry.where("kind is null").select("provider", "key")
    return own.unionByName(more).select(F.concat(F.lit("raw_"), "provider", F.lit("__"), "key").alias("name"))


def read_registered(spark: SparkSession, folder: str, layers: list[tuple[str, str]], loaded_at: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Layers (name, file) that exist, and the names of those that don't: a missing file is skipped, never an error."""
    found = {name: read_points(spark, f"{folder}/{file}", loaded_at) for name, file in layers if exists(spark, f"{folder}/{file}")}
    return found, [name for name, _ in layers if name not in found]


def feature(lon: Column, lat: Column, properties: Column) -> Column:
    """One feature as JSON text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry")))


def write_points(df: DataFrame, path: str, properties: list[str], lon: str = "lon", lat: str = "lat") -> None:
    """Newline-separated features, one file per partition; an empty frame still writes."""
    df.select(feature(F.col(lon), F.col(lat), F.struct(*properties)).alias("value")).write.mode("overwrite").text(path)


def document(df: DataFrame, key: str, generated_at: str, order: list[str]) -> DataFrame:
    """One row: {generated_at, key: [rows in order]} as JSON. For the small published feeds."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))
    return df.agg(F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), rows.alias(key))).alias("value"))


def read_stats(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Tab-separated statistics by header name (gzip is read as it is); a missing column is an error, blank layers are dropped."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df.where(F.trim(F.coalesce("layer", F.lit(""))) != "").select(*required)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def poly_text(ring: Column, name: Column) -> Column:
    """A polygon file: name, ring number, one corner a line, END twice."""
    corners = F.transform(ring, lambda p: F.concat(F.lit("   "), F.format_string("%.6E", p["x"]), F.lit("   "), F.format_string("%.6E", p["y"])))
    return F.concat_ws("\n", name, F.lit("1"), F.array_join(corners, "\n"), F.lit("END"), F.lit("END"))


def poly_rings(text: Column) -> Column:
    """Rings of a polygon file: an array with one array of corners (structs x, y) for each, in order.

    A ring is a heading and the corner lines up to its END. Rings whose heading starts with an exclamation mark are
    holes; they come out like the others, as the even-odd rule asks for.
    """
    row = r"[ \t]+[-+0-9.eE]+[ \t]+[-+0-9.eE]+[ \t]*\r?\n"
    blocks = F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(r"(?m)^\S[^\n]*\n((?:" + row + r")+)END"), 1)
    corner = lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y"))
    return F.transform(blocks, lambda b: F.transform(F.filter(F.split(b, r"\r?\n"), lambda s: F.trim(s) != ""), lambda s: corner(F.split(F.trim(s), r"[ \t]+"))))


def profile_samples(text: Column) -> Column:
    """Samples of a profile document; those without a finite distance are dropped."""
    schema = "array<struct<distance_mi: double, elevation_ft: double, part_start: boolean>>"
    return F.filter(F.from_json(text, schema), lambda s: s["distance_mi"].isNotNull() & ~F.isnan(s["distance_mi"]))


def guarded_write(df: DataFrame, path: str, previous: int, floor: int = 40, share: float = 0.5) -> int:
    """Write only what holds up: at least ``floor`` rows and at least ``share`` of the previous count; else nothing is replaced.

    The rows are computed once, into a new folder beside the old one, and counted there; then the folders are renamed,
    so a reader sees the old rows or the new ones and a failed run leaves the old.
    """
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    n = spark.read.schema(df.schema).parquet(new).count()
    if n < floor or n < previous * share:
        discard(spark, new)
        raise ValueError(f"refused: {n} rows, {previous} before")
    moved = rename(spark, path, old)
    rename(spark, new, path)
    if moved:
        discard(spark, old)
    return n


def tile_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"))


def html_rows(page: Column) -> Column:
    """Cells of an HTML table, an array of arrays."""
    rows = F.regexp_extract_all(page, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))))
    return F.filter(cells, lambda c: F.size(c) > 0)
