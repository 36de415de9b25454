"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Settings that a cluster job of this package is meant to run with.  Shuffle width is left to the
# caller: AQE coalesces it downwards, so it should be set for the largest stage.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = 8, app: str = "factloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FACTLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results: what the cluster names, else a local one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not _is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="factloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few given rows as a local relation, whose size the planner knows (and may broadcast).

    Rows turned into an RDD have no known size, and a join with them would shuffle the other side.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [part.split()[1] for part in schema.split(", ")]
    arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    columns = [
        pa.array([row[i] for row in rows], arrow[kind]) for i, kind in enumerate(kinds)
    ]
    return spark.createDataFrame(pa.table(columns, names=names))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spreads an input that has fewer partitions than there are cores before heavy per-row work.

    Only a small unsplittable input is moved; one with enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to reliable storage once and read it from there: survives executor loss."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as columns below the shared folder and read from there: its size is known then."""
    path = scratch(df.sparkSession, name)
    # ids are hexadecimal: a codec that codes entropy halves them
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
