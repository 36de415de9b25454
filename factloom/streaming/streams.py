"""The continuous forms: records in, dedup, classification, commit, current facts, usage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factloom.functions.columns import blank_to_null, is_current, target_node
from factloom.operators.build import Commit, Parts, commit_parts, merge_parts
from factloom.operators.records import apply_triage, classify_policy
from factloom.schema import SUPERSEDING_LABELS
from factloom.streaming.snapshots import Snapshots

SLOT = ["from_id", "edge_label", "fact_type", "to_node"]


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    format: str = "json",
    glob: str | None = None,
    files_per_batch: int | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """New files of a folder as a stream; the checkpoint is the cursor.

    JSON files hold one object or one list each, or one object per line if `multi_line` is off. With
    `files_per_batch` the oldest files come first, and of one moment those whose entry in the folder sorts first.
    """
    reader = spark.readStream.format(format).schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
        # a folder is listed in any order, the entries of a pattern in that of their names
        reader, path = reader.option("basePath", path), f"{path}/[^_.]*"
    if format == "json":
        reader = reader.option("multiLine", multi_line)
    return reader.load(path)


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What the batches of a folder have left; empty at first."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not here.getFileSystem(spark._jsc.hadoopConfiguration()).exists(here):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    return rows.option("recursiveFileLookup", "false").parquet(path).drop("batch")


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key by creation time, then id; one row of a key is kept at a time."""
    best: pa.Table | None = None
    order = [("_key", "ascending"), ("created_at", "ascending"), ("record_id", "ascending")]
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if best is None else pa.concat_tables([best, rows])
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_end"))
        codes = rows["_key"].combine_chunks().dictionary_encode().indices.to_numpy()
        best = rows.take(np.flatnonzero(np.diff(codes, prepend=-1)))
    if best is not None:
        yield from best.to_batches()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_of_keys(records: DataFrame) -> DataFrame:
    """A stream's records whose key has not come before, however late; those without a key all stay.

    Of a micro-batch the first record of a key by creation time, then id, goes on. Keys are the only state,
    in a keyed store on disk (RocksDB) with its changes in the checkpoint: a micro-batch looks up the keys it
    holds, whatever the number of records that have landed. Records without a key pass by the state.
    """
    records.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    key = blank_to_null("dedup_key")
    keyed = records.filter(key.isNotNull()).withColumn("_key", F.col("dedup_key"))
    # within a micro-batch the first row stays; then the state lets a key pass once
    first = keyed.repartition("_key").mapInArrow(_first_of_each, keyed.schema).dropDuplicates(["_key"])
    return first.drop("_key").unionByName(records.filter(key.isNull()))


def stream_dedup(
    records: DataFrame, path: str, checkpoint: str, once: bool = True, every: str = "5 seconds"
) -> StreamingQuery:
    """Records whose key has not landed yet (see `first_of_keys`), in a folder of their own per batch.

    Every micro-batch owns the folder `batch=<id>`, so a replay leaves the same rows; none reads what
    has landed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return to_batches(first_of_keys(records), write, checkpoint, once=once, every=every)


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All records that `stream_dedup` has let land."""
    return _batches(spark, path, schema)


def stream_classify(records: DataFrame, policy: Column | str, noise: Column | None = None) -> DataFrame:
    """Labels that need no decision: noise by rule, else the source's policy."""
    explicit = F.col("classification")
    if noise is not None:
        explicit = F.coalesce(explicit, F.when(noise, "noise"))
    return records.withColumn("classification", classify_policy(policy, explicit))


LATEST_DECISION = ("decided_at", "classification", "op_area")


def _latest_decision(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct(*LATEST_DECISION)).alias("_last")
    return rows.groupBy("record_id").agg(last).select("record_id", "_last.*")


def stream_decisions(decisions: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Triage decisions (record_id, classification, op_area, decided_at) as they come; the latest counts.

    They may come before or after their record: both are kept, and `read_triaged` puts them together.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = _latest_decision(batch.select("record_id", *LATEST_DECISION))
        Snapshots(batch.sparkSession, path, _latest_decision).commit(batch_id, rows)

    return to_batches(decisions, write, checkpoint, once=once)


def read_triaged(records: DataFrame, path: str) -> DataFrame:
    """Landed records with the decisions that `stream_decisions` has kept; undecided ones go on waiting."""
    kept = Snapshots(records.sparkSession, path).read()
    if kept is None:
        return records
    return apply_triage(records, kept, final=False)


def _start(writer, checkpoint: str, once: bool, every: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def to_table(
    stream: DataFrame, path: str, checkpoint: str, once: bool = True, every: str = "5 seconds"
) -> StreamingQuery:
    """An append-only table of Parquet files; each input row lands exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer, checkpoint, once, every)


def to_batches(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    once: bool = True,
    every: str = "5 seconds",
) -> StreamingQuery:
    return _start(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint, once, every)


def stream_commit(
    extractions: DataFrame,
    base: str,
    checkpoint: str,
    recorded_at: Column,
    mode: str = "literal",
    once: bool = True,
) -> StreamingQuery:
    """Mentions, alias sightings and claims of extractions, as tables under `base`.

    Extractions with a `classification` count only if it is relevant. Each table is a store of
    `Snapshots`, so few folders are read however many batches came, and a replayed batch leaves the same
    rows. `read_committed` merges them: the latest value of every property, the first claim of every fact.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Three tables come from one micro-batch; what is lost of the kept rows is read again.
        if "classification" in batch.columns:
            batch = batch.filter("classification = 'relevant'")
        kept = batch.persist()
        parts = commit_parts(kept, recorded_at, mode=mode)
        for name in PARTS:
            _part(batch.sparkSession, base, name).commit(batch_id, getattr(parts, name))
        kept.unpersist()

    return to_batches(extractions, write, checkpoint, once=once)


PARTS = ("mentions", "aliases", "claims")


def _part(spark: SparkSession, base: str, name: str) -> Snapshots:
    """Equal sightings and claims of merged batches are one; mentions hold maps and stay as they are."""
    return Snapshots(spark, f"{base}/{name}", None if name == "mentions" else DataFrame.distinct)


def read_committed(spark: SparkSession, base: str) -> Commit:
    """The graph tables of all batches: the rows that one batch of all extractions would give."""
    return merge_parts(Parts(*[_part(spark, base, name).read() for name in PARTS]))


def current_facts(facts: DataFrame) -> DataFrame:
    """The newest fact of each superseding slot; the same code serves a stream and a table.

    Late facts with an older event time change nothing, newer ones replace the row of their slot.
    """
    live = facts.filter(F.col("edge_label").isin(*SUPERSEDING_LABELS) & is_current())
    newest = F.max(F.struct("source_at", "edge_id", "fact", "confidence", "source_record"))
    return (
        live.withColumn("to_node", target_node())
        .groupBy(*SLOT)
        .agg(newest.alias("r"))
        .select(*SLOT, "r.*")
    )


def stream_current_facts(
    facts: DataFrame, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Slots of each micro-batch as upsert rows; merged folders keep the newest row of a slot.

    The folders are the state: no slot is held in the memory of executors between the micro-batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        Snapshots(batch.sparkSession, path, _newest).commit(batch_id, current_facts(batch))

    return to_batches(facts, write, checkpoint, once=once)


def read_current_facts(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every slot from its upsert rows, of which a folder has one."""
    kept = Snapshots(spark, path)
    rows = kept.read()
    return rows if len(kept.runs()) == 1 else _newest(rows)


def _newest(rows: DataFrame) -> DataFrame:
    newest = F.max(F.struct("source_at", "edge_id", "fact", "confidence", "source_record"))
    return rows.groupBy(*SLOT).agg(newest.alias("r")).select(*SLOT, "r.*")


def stream_usage(
    calls: DataFrame, path: str, checkpoint: str, width: str = "1 hour", once: bool = True
) -> StreamingQuery:
    """Sums of each micro-batch per model and time window; late calls count like all others."""

    def write(batch: DataFrame, batch_id: int) -> None:
        Snapshots(batch.sparkSession, path, _usage_sums).commit(batch_id, usage_windows(batch, width))

    return to_batches(calls, write, checkpoint, once=once)


def usage_windows(calls: DataFrame, width: str = "1 hour") -> DataFrame:
    """Calls and tokens per model and time window."""
    return (
        calls.groupBy(F.window("created_at", width).alias("w"), "model")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "model",
            "calls",
            "input_tokens",
            "output_tokens",
        )
    )


def _usage_sums(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens")]
    return rows.groupBy("window_start", "window_end", "model").agg(*sums)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The windows of all batches so far, the open ones too."""
    return _usage_sums(Snapshots(spark, path).read())
