"""Session defaults, table access and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cairnlake")
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "12g"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without and gets one of its machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"cairnlake-shared-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def own_folder(spark: SparkSession, stem: str) -> str:
    """A new folder in the shared one, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def ship_file(spark: SparkSession, stem: str, data: bytes) -> str:
    """Write bytes into the shared folder, whatever its scheme, and have every executor fetch them once; returns the name ``SparkFiles.get`` takes on a worker."""
    path = f"{own_folder(spark, stem)}/{stem}-{uuid.uuid4().hex}.bin"
    files, at = _file_system(spark, path)
    out = files.create(at)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return bool(files.exists(at))


def only_file(spark: SparkSession, folder: str, to: str) -> None:
    """Move the one data file of a written folder to a path of its own."""
    files, at = _file_system(spark, folder)
    (part,) = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("part-")]
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    files.mkdirs(target.getParent())
    files.rename(part, target)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder; false if there is none."""
    files, at = _file_system(spark, path)
    return bool(files.exists(at)) and bool(files.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to)))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the plans run inside; keys have __ for the dot."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder; it outlives any executor and goes when the driver ends.

    Unlike a checkpoint it carries no partitioning of the plan before (which, in a loop of self-joins, grows with every
    round until planning never ends), and its size is known to the planner.
    """
    spark = df.sparkSession
    path = own_folder(spark, "cut")
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
