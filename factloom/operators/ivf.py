"""Vector search for many queries at once over an inverted-file index.

Centres are trained on a bounded sample; every vector lies in the list of its nearest centre, and a list is
kept in blocks of bounded size, one row each, so a list that holds a third of all vectors is many rows.
Queries are put in packets by their nearest list; packets and blocks are written once, and tasks take parts
of both, so no vector is copied for each list that is probed.  A packet and a block meet in one matrix
product; a task goes on only with the best rows that a query has found in all its blocks, and the exact
cosine in double precision ranks them.  With all lists probed the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.vectors import checked
from factloom.session import written

#: Vectors in a block, queries in a packet, and the sample that centres are trained on.
BLOCK = 2_048
PACKET = 1_024
SAMPLE = 20_000


@dataclass(frozen=True)
class Index:
    blocks: DataFrame  # list, block, ids, vectors
    centres: np.ndarray
    dim: int


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _train(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from starts spread over the sample; the same sample gives the same centres."""
    x = _unit(sample)
    c = x[np.unique(np.linspace(0, len(x) - 1, lists).astype(int))].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def _stacked(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_numpy()).astype(np.float64)


def _blocks(rows: DataFrame, id: str, centres: np.ndarray, size: int) -> DataFrame:
    """(list, block, ids, vectors): rows of one nearest list, about `size` of them, in order of their ids."""

    @F.pandas_udf("int")
    def nearest(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype="int32")
        x = _stacked(batch)
        best = (x @ centres.T).argmax(axis=1)
        return pd.Series(np.where(np.any(x, axis=1), best, -1))

    placed = written(rows.withColumn("list", nearest("embedding")).filter("list >= 0"), "vectors-by-list")
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
    # the blocks of a list are dealt by hash, so a hot list is spread over tasks
    dealt = placed.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64(id), F.col("n")))
    grouped = dealt.groupBy("list", "block").agg(F.sort_array(F.collect_list(F.struct(id, "embedding"))).alias("v"))
    blocks = grouped.select("list", "block", F.col(f"v.{id}").alias("ids"), F.flatten("v.embedding").alias("vectors"))
    # as many files as there are cores, so that as many tasks read them
    return blocks.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def build(vectors: DataFrame, lists: int | None = None) -> Index:
    """An index over (record_id, embedding). Zero vectors have no direction and are left out.

    `lists` defaults to the square root of the number of vectors, 4,096 at most.
    """
    given = vectors.filter(F.col("embedding").isNotNull()).select("record_id", "embedding")
    sample = given.orderBy(F.xxhash64("record_id"), "record_id").limit(SAMPLE).select("embedding").toPandas()
    dim = len(sample["embedding"].iloc[0]) if len(sample) else 0
    rows = checked(given, dim)
    lists = lists or min(4_096, max(1, int(rows.count() ** 0.5)))
    centres = _train(_stacked(sample["embedding"]), lists) if len(sample) else np.zeros((1, 0))

    return Index(written(_blocks(rows, "record_id", centres, BLOCK), "vector-blocks"), centres, dim)


class _Best:
    """The `n` best rows of each query of a packet, by score, then smaller id."""

    def __init__(self, queries: int, n: int):
        self.n = n
        self.least = np.full(queries, -np.inf)
        self.who = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)
        self.id = np.zeros(0, dtype=object)

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        own = np.isin(self.who, who)
        w, s, i = (np.concatenate(x) for x in ((self.who[own], who), (self.score[own], score), (self.id[own], ids)))
        order = np.lexsort((np.unique(i, return_inverse=True)[1], -s, w))
        w, s, i = w[order], s[order], i[order]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        place = np.arange(len(w)) - np.repeat(first, np.diff(first, append=len(w)))
        self.least[w[place == self.n - 1]] = s[place == self.n - 1]
        kept = place < self.n
        self.who, self.score, self.id = (
            np.concatenate([old[~own], new[kept]])
            for old, new in ((self.who, w), (self.score, s), (self.id, i))
        )


def _scores(n: int, dim: int, centres: np.ndarray, probes: int):
    """The `n` best rows of a task's blocks for each query of its packets."""
    # products of single precision choose; rows that these may put in the wrong order are scored exactly
    margin = dim * 2.0**-22 + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple[_Best, np.ndarray, np.ndarray | None]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                column = lambda name, k=k, batch=batch: batch.column(name)[k].values
                flat = lambda name, c=column: c(name).to_numpy(zero_copy_only=False).astype(np.float64)
                value = lambda name, k=k, batch=batch: batch.column(name)[k].as_py()
                queries = _unit(flat("queries").reshape(-1, dim))
                packet = (value("q_list"), value("q_block"))
                if packet not in kept:
                    probed = None if probes == len(centres) else _probed(queries, centres, probes)
                    kept[packet] = _Best(len(queries), n), np.array(column("query_ids").to_pylist(), dtype=object), probed
                best, _, probed = kept[packet]
                asking = np.arange(len(queries)) if probed is None else np.flatnonzero(probed[:, value("list")])
                own = flat("vectors").reshape(-1, dim)
                norm = np.linalg.norm(own, axis=1)
                near = queries[asking].astype(np.float32) @ (own / norm[:, None]).astype(np.float32).T
                least = best.least[asking]
                new = np.isinf(least)
                if near.shape[1] > n and new.any():
                    least[new] = np.partition(near[new], -n, axis=1)[:, -n] - margin
                q, c = np.nonzero(near >= (least - margin).astype(np.float32)[:, None])
                if not len(q):
                    continue
                q = asking[q]
                # as in the search for one query: the product with the unit query, divided by the norm
                score = (queries[q] * own[c]).sum(axis=1) / norm[c]
                ids = np.array(column("ids").to_pylist(), dtype=object)
                some = score >= best.least[q]
                if some.any():
                    best.add(q[some], score[some], ids[c[some]])
        for best, asked, _ in kept.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked[best.who], pa.string()), pa.array(best.id, pa.string()), pa.array(best.score, pa.float64())],
                names=["query_id", "record_id", "score"],
            )

    return run


def _probed(queries: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Whether a query looks into a list."""
    order = np.argsort(-(queries @ centres.T), axis=1, kind="stable")[:, :probes]
    out = np.zeros((len(queries), len(centres)), dtype=bool)
    np.put_along_axis(out, order, True, axis=1)
    return out


def search_many(index: Index, queries: DataFrame, n: int = 5, probes: int | None = None) -> DataFrame:
    """(query_id, rank, record_id, score): the `n` nearest rows by cosine for each (query_id, embedding).

    Each query looks into the `probes` lists nearest to it (default: an eighth of them, 8 at least); None of
    them is left out with `probes` as large as the number of lists, and the result is exact then. Equal scores
    go to the smaller id. A query of another length is an error, one without direction finds nothing.
    """
    lists = len(index.centres)
    probes = min(lists, probes or max(8, lists // 8))
    centres = index.centres

    @F.pandas_udf("array<int>")
    def wanted(packets: pd.Series) -> pd.Series:
        """The lists that some query of a packet looks into."""
        asked = (np.asarray(p, dtype=np.float64).reshape(-1, centres.shape[1]) for p in packets)
        return pd.Series([np.flatnonzero(_probed(x, centres, probes).any(axis=0)).tolist() for x in asked], dtype=object)

    asked = checked(queries.select("query_id", "embedding"), index.dim)
    spark = queries.sparkSession
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    packets = _blocks(asked, "query_id", centres, PACKET).toDF("q_list", "q_block", "query_ids", "queries")
    packets = written(packets, "query-packets")
    spark.conf.set(rows, "16")  # a row is a packet beside a block
    try:
        if probes == lists:
            met = packets.crossJoin(index.blocks)
        else:
            packets = written(packets.withColumn("lists", wanted("queries")), "query-packets-lists")
            met = packets.join(index.blocks, F.array_contains("lists", F.col("list")))
        met = met.select("q_list", "q_block", "query_ids", "queries", "list", "ids", "vectors")
        run = _scores(n, index.dim, centres, probes)
        found = written(met.mapInArrow(run, "query_id string, record_id string, score double"), "found")
    finally:
        spark.conf.set(rows, before)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "record_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return best.select("query_id", "rank", "record_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, pairs of the exact search, those that were found, and their share."""
    right = found.select("query_id", "record_id").withColumn("hit", F.lit(1))
    both = exact.select("query_id", "record_id").join(right, ["query_id", "record_id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"),
        F.count(F.lit(1)).alias("pairs"),
        F.count("hit").alias("hits"),
        F.coalesce(F.count("hit") / F.count(F.lit(1)), F.lit(1.0)).alias("recall"),
    )
