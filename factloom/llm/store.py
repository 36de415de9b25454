"""Intermediate tables and connected components that survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.session import scratch


# Rows of a batch that a Python task gets at once; texts may be long, and an executor holds several batches.
BATCH_ROWS = "2000"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, with the session set for batches of texts."""
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once below the shared folder and read from there, so that its size is known."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Up to this many ids (two longs each) are sent to all tasks to pick rows; more are joined by a shuffle.
SENT_IDS = 1_000_000


def picked(df: DataFrame, ids: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """`df` with (`left_semi`) or without (`left_anti`) the rows of `ids`, which are sent if they are few."""
    few = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    return df.join(few, on, how)


def bounded_sample(df: DataFrame, key: str, size: int, id: str = "doc_id") -> DataFrame:
    """At most `size` rows of each `key`, the first ones by hash of `id`; all of a key that has no more.

    A share of each key's hashes, four times what is needed, is let through first, so that ranking a
    key's rows never gathers more than a few times `size` of them.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("__all"))
    share = F.col("__all") * (F.pmod(F.xxhash64(id), F.lit(1 << 20)) + 1) <= F.lit(4 * size * (1 << 20))
    order = Window.partitionBy(key).orderBy(F.xxhash64(id), id)
    few = df.join(counts, key).filter(share).drop("__all")
    return few.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= size).drop("__rank")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`id`, `component`: for every id in `links` (`a`, `b`: longs) the smallest id reachable from it.

    Alternates the two star steps of Kiveris et al. (2014): every node's larger (then smaller) neighbours
    are linked to its smallest one, until nothing changes; about log^2 of the longest path in rounds.
    Minima are aggregated in the map tasks and joined back, so a node with very many links is no hot
    group.  No links give an empty table.
    """
    pairs = links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
    pairs = stored(pairs.filter("a <> b").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # every node with all neighbours: the larger ones move to the smallest of the closed neighbourhood
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # every node with its smaller neighbours: they and the node itself move to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = tuple(
            pairs.agg(
                F.count("*"),
                F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)),
                F.countDistinct("a"),
            ).first()
        )
        if state == before or state[0] == state[2] and _flat(pairs):
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _flat(pairs: DataFrame) -> bool:
    """Whether every node points at a root: no node that is pointed at points on."""
    return pairs.join(pairs.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
