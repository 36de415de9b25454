"""Streams over the given tables, run to the end of the input and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import is_current
from factloom.operators import build, usage
from factloom.operators.records import read_records, save_records, write_records
from factloom.plans.batch import rebuild_graph
from factloom.plans.catalog import query
from factloom.session import scratch
from factloom.sources import files, typed
from factloom.sources.tables import TABLE_SCHEMAS, Tables
from factloom.schema import RECORD_TYPES, SUPERSEDING_LABELS
from factloom.sources import records as src
from factloom.streaming import streams

SEC = "'%Y-%m-%d %H:%M:%S'"


class StreamTables(Tables):
    """The same views with chosen tables read as streams."""

    def __init__(self, tables: Tables, *streamed: str):
        super().__init__(tables.spark, tables.folder)
        self.streamed = streamed

    def raw(self, name: str) -> DataFrame:
        if name not in self.streamed:
            return super().raw(name)
        # a table is one file or a folder of files; as a pattern its path stands for either
        df = streams.stream_files(self.spark, f"{self.folder}/{{{name}.parquet}}", TABLE_SCHEMAS[name], "parquet")
        zoned = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoned}) if zoned else df


def _landed(stream: DataFrame, t: Tables, name: str) -> DataFrame:
    """Runs a stream over what is there now into a table and reads the table."""
    out, cursor = scratch(t.spark, name), scratch(t.spark, f"{name}-cursor")
    streams.to_table(stream, out, cursor).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query("stream_records", "SS1", "SELECT record_id, type, dedup_key FROM records")
def _stream_records(t: Tables):
    landed = _landed(StreamTables(t, "events", "documents").records(), t, "records")
    return landed.select("record_id", "type", "dedup_key")


@query(
    "stream_dedup",
    "SS2",
    """SELECT record_id, type, dedup_key FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key
        ORDER BY created_at NULLS LAST, record_id) AS rn FROM records)
    WHERE rn = 1 OR coalesce(trim(dedup_key), '') = ''""",
)
def _stream_dedup(t: Tables):
    live = StreamTables(t, "documents", "events").records()
    out, cursor = scratch(t.spark, "dedup"), scratch(t.spark, "dedup-cursor")
    streams.stream_dedup(live, out, cursor).awaitTermination()
    return streams.read_landed(t.spark, out, live.schema).select("record_id", "type", "dedup_key")


@query(
    "stream_classify",
    "SS3",
    """SELECT type, CASE WHEN classification IS NOT NULL THEN classification
        WHEN contains(source, '9') THEN 'noise' ELSE 'pending_triage' END AS classification,
      count(*) AS n FROM records GROUP BY ALL""",
)
def _stream_classify(t: Tables):
    live = StreamTables(t, "documents", "events").records()
    labelled = streams.stream_classify(live, "required", noise=F.contains("source", F.lit("9")))
    landed = _landed(labelled, t, "classified")
    return landed.groupBy("type", "classification").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_decisions",
    "SS3",
    """SELECT type, CASE WHEN r.classification IS NOT NULL THEN r.classification
        WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 1 THEN 'relevant' ELSE 'noise' END
        ELSE 'pending_triage' END AS classification, count(*) AS n,
      count(*) FILTER (r.classification IS NULL AND l.doc_id IS NOT NULL) AS decided
    FROM records r LEFT JOIN labels l ON r.record_id = 'document_' || l.doc_id GROUP BY 1, 2""",
)
def _stream_decisions(t: Tables):
    """Records and decisions as two streams; a record without a decision goes on waiting."""
    live = StreamTables(t, "documents", "events").records()
    landed = _landed(streams.stream_classify(live, "required"), t, "triage")
    told = StreamTables(t, "labels").raw("labels").select(
        F.concat(F.lit("document_"), "doc_id").alias("record_id"),
        F.when(F.col("quality") == 1, "relevant").otherwise("noise").alias("classification"),
        F.when(F.col("toxic") == 1, "intention").alias("op_area"),
        F.timestamp_seconds(F.col("doc_id")).alias("decided_at"),
    )
    out, cursor = scratch(t.spark, "decisions"), scratch(t.spark, "decisions-cursor")
    streams.stream_decisions(told, out, cursor).awaitTermination()
    done = streams.read_triaged(landed, out)
    decided = F.count_if(F.col("metadata")["op_area"].isNotNull()).alias("decided")
    return done.groupBy("type", "classification").agg(F.count(F.lit(1)).alias("n"), decided)


@query(
    "stream_commit",
    "SS4",
    """SELECT DISTINCT record_id AS source_record, edge_label, fact_type, fact FROM ex_facts
    WHERE from_entity <> 'Somebody'""",
)
def _stream_commit(t: Tables):
    base, cursor = scratch(t.spark, "commit"), scratch(t.spark, "commit-cursor")
    live = StreamTables(t, "lineitem").extractions()
    recorded = F.lit("2024-06-01").cast("timestamp")
    streams.stream_commit(live, base, cursor, recorded).awaitTermination()
    facts = streams.read_committed(t.spark, base).facts
    return facts.select("source_record", "edge_label", "fact_type", "fact")


@query(
    "stream_current_facts",
    "SS5",
    f"""SELECT from_id, edge_label, fact_type, to_node, edge_id, fact,
      strftime(source_at, {SEC}) AS source_at
    FROM (SELECT *, coalesce(to_id, 'day:' || CAST(to_day AS VARCHAR)) AS to_node,
        row_number() OVER (PARTITION BY from_id, edge_label, fact_type, to_id, to_day
          ORDER BY source_at DESC, edge_id DESC) AS rn
      FROM facts WHERE edge_label IN ('AFFILIATED', 'ASSERTED')) WHERE rn = 1""",
)
def _stream_current(t: Tables):
    out, cursor = scratch(t.spark, "current"), scratch(t.spark, "current-cursor")
    live = StreamTables(t, "orders", "lineitem", "customer", "supplier", "nation").facts()
    kept = live.filter(F.col("edge_label").isin(*SUPERSEDING_LABELS) & is_current())
    streams.stream_current_facts(kept, out, cursor).awaitTermination()
    found = streams.read_current_facts(t.spark, out)
    return found.select(
        "from_id", "edge_label", "fact_type", "to_node", "edge_id", "fact", "source_at"
    )


@query(
    "stream_usage",
    "SS6",
    f"""SELECT strftime(ws, {SEC}) AS window_start, strftime(ws + INTERVAL 1 HOUR, {SEC}) AS window_end,
      model, calls, input_tokens, output_tokens
    FROM (SELECT date_trunc('hour', created_at) AS ws, model, count(*) AS calls,
        CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM model_calls GROUP BY 1, 2)""",
)
def _stream_usage(t: Tables):
    out, cursor = scratch(t.spark, "usage"), scratch(t.spark, "usage-cursor")
    streams.stream_usage(StreamTables(t, "conversations").model_calls(), out, cursor).awaitTermination()
    return streams.read_usage(t.spark, out)


# -- sinks: written in the shared folder and read back ----------------------------------------


@query(
    "write_records",
    "SNK4",
    f"""WITH first AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY created_at NULLS LAST, record_id)
        AS rn FROM records)
    SELECT record_id, type, coalesce(classification, 'pending_triage') AS classification, md5(raw) AS raw_md5,
      strftime(created_at, {SEC}) AS created_at FROM first WHERE rn = 1 OR coalesce(trim(dedup_key), '') = ''""",
)
def _write_records(t: Tables):
    """Loaded in two parts and the first part again: every key lands once."""
    path, rows = scratch(t.spark, "record-table"), t.records()
    for part in ("type = 'document'", "type <> 'document'", "type = 'document'"):
        write_records(rows.filter(part), path, policy="required")
    found = read_records(t.spark, path)
    return found.select("record_id", "type", "classification", F.md5("raw").alias("raw_md5"), "created_at")


@query(
    "write_typed_table",
    "SRC12 SNK4",
    """SELECT doc_id AS github_id, 'feat/' || lang AS branch, 'rev' || (doc_id % 5) AS reviewer
    FROM documents WHERE doc_id % 2 = 0""",
)
def _write_typed(t: Tables):
    prs = src.flatten_pull_requests(t.code_nodes().filter(F.col("pull_request").isNotNull()))
    rows = src.records_from(
        "github_pr", prs, F.lit("2024-02-01").cast("timestamp"), "codehost", "0.1.2"
    )
    folder = typed.write_typed_table(
        save_records(rows, policy="skip"),
        scratch(t.spark, "typed"),
        "codehost",
        "github_pr",
        "0.1.2",
        RECORD_TYPES["github_pr"],
    )
    written = t.spark.read.parquet(folder)
    return written.select("github_id", "branch", F.col("reviewers")[0].alias("reviewer"))


@query(
    "write_facts",
    "SNK5",
    """SELECT edge_label, count(*) AS n, min(edge_id) AS first_edge FROM facts GROUP BY 1""",
)
def _write_facts(t: Tables):
    path = scratch(t.spark, "facts")
    files.write_facts(t.facts(), path)
    return t.spark.read.parquet(path).groupBy("edge_label").agg(
        F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("first_edge")
    )


@query(
    "rebuild_graph",
    "SNK5 GB3",
    """SELECT edge_label, fact_type, count(*) AS n FROM (
      SELECT DISTINCT f.record_id, edge_label, fact_type, fact FROM ex_facts f
      JOIN ex_base b USING (record_id)
      WHERE from_entity <> 'Somebody' AND b.l_linenumber <= 3) GROUP BY ALL""",
)
def _rebuild(t: Tables):
    x = t.extractions()
    line = F.split_part("record_id", F.lit("_"), F.lit(3)).cast("int")
    rows = x.select(
        "record_id",
        F.col("record_type").alias("type"),
        "content",
        "metadata",
        "created_at",
        F.when(line <= 3, "relevant").otherwise("noise").alias("classification"),
    )
    base = scratch(t.spark, "graph")
    rebuild_graph(rows, x, base, "1998-01-01", F.lit("2024-06-01").cast("timestamp"))
    facts = t.spark.read.parquet(f"{base}/facts")
    return facts.groupBy("edge_label", "fact_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "write_usage_report",
    "SNK2 AG2 AG3",
    """SELECT 'model' AS part, model AS key, count(*) AS n FROM priced GROUP BY model
    UNION ALL SELECT 'record', coalesce(record_id, session_id), count(*) FROM priced GROUP BY 2
    UNION ALL SELECT 'calls', run_id, count(*) FROM priced GROUP BY run_id""",
)
def _usage_report(t: Tables):
    path = scratch(t.spark, "usage-report")
    calls = usage.priced(t.model_calls(), t.prices())
    summary = usage.usage_summary(calls).filter("level = 'model'")
    files.write_usage_report(summary, usage.usage_by_record(calls), calls, path)

    def part(name, folder, schema, key, n):
        df = t.spark.read.schema(schema).json(f"{path}/{folder}")
        return df.select(F.lit(name).alias("part"), F.col(key).alias("key"), F.expr(n).alias("n"))

    per_call = part("calls", "calls", "run_id string", "run_id", "1")
    return (
        part("model", "summary", "model string, calls long", "model", "calls")
        .unionByName(part("record", "per_record", "key string, turns long", "key", "turns"))
        .unionByName(per_call.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")))
    )


@query(
    "write_eval_results",
    "SNK1",
    """SELECT 'v1' AS engine_version, o_orderpriority AS dataset_version,
      count(*) AS matched FROM orders GROUP BY 2""",
)
def _eval_results(t: Tables):
    path = scratch(t.spark, "eval")
    scores = t.raw("orders").groupBy(
        F.lit("v1").alias("engine_version"), F.col("o_orderpriority").alias("dataset_version")
    ).agg(F.count(F.lit(1)).alias("matched"))
    files.write_eval_results(scores, path)
    schema = "matched long, engine_version string, dataset_version string"
    return t.spark.read.schema(schema).json(path).select(
        "engine_version", "dataset_version", "matched"
    )


@query(
    "json_records",
    "SRC1",
    "SELECT doc_id, source, length(text) AS chars FROM documents",
)
def _json_records(t: Tables):
    """Documents as JSON files that hold a list each, read back as records."""
    path = scratch(t.spark, "json")
    row = F.struct("doc_id", "source", "text")
    lists = t.raw("documents").groupBy(F.floor(F.col("doc_id") / 200)).agg(
        F.to_json(F.collect_list(row)).alias("value")
    )
    writer = lists.select("value").write.option("maxRecordsPerFile", 1)
    writer.option("lineSep", " ").format("text").save(path)
    back = files.read_json_records(
        t.spark, path, "doc_id long, source string, text string", glob="part-*"
    )
    return back.select("doc_id", "source", F.length("text").alias("chars"))


@query(
    "er_truth",
    "SRC15",
    """SELECT CAST(NULL AS VARCHAR) AS slice, c_name AS canonical_name, unnest([c_name,
      'Cust ' || c_custkey]) AS surface_form FROM customer
    UNION ALL SELECT 'b' || (c_custkey // 100), c_name, c_name FROM customer""",
)
def _er_truth(t: Tables):
    """Ground-truth documents of 100 expected entities each, read back as rows."""
    path = scratch(t.spark, "truth")
    forms = F.array("c_name", F.concat(F.lit("Cust "), "c_custkey"))
    whole = F.struct(
        F.col("c_name").alias("canonical_name"), forms.alias("surface_forms")
    )
    part = F.struct(
        F.col("c_name").alias("canonical_name"), F.array("c_name").alias("surface_forms")
    )
    block = F.floor(F.col("c_custkey") / 100).alias("block")
    docs = t.raw("customer").groupBy(block).agg(
        F.collect_list(whole).alias("global"), F.collect_list(part).alias("entities")
    )
    slices = F.array(
        F.struct(F.concat(F.lit("b"), "block").alias("record"), F.col("entities"))
    )
    text = F.to_json(F.struct("global", slices.alias("timeslices")))
    writer = docs.select(text.alias("value")).write.option("maxRecordsPerFile", 1)
    writer.format("text").save(path)
    return files.read_er_truth(t.spark, path)


@query(
    "dataset_sequence",
    "SRC15",
    """SELECT s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS position,
      'records/' || s_suppkey || '.json' AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'email' ELSE 'linear_issue' END AS type,
      'data/' || s_nationkey || '/er.json' AS er_truth
    FROM supplier""",
)
def _dataset_sequence(t: Tables):
    """A dataset of records per nation, with its config and its ordered list as YAML files, read back."""
    item = F.concat(
        F.lit("- file: records/"), "s_suppkey", F.lit(".json\n  type: "),
        F.when(F.col("s_suppkey") % 2 == 0, "email").otherwise("linear_issue"), F.lit("\n"),
    )
    listed = F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("text"))))
    sets = t.raw("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("sequence")
    )
    config = F.concat(
        F.lit("version: 1\nname: 'n"), "nation", F.lit("'\nground_truth:\n  entity_resolution: data/"), "nation",
        F.lit("/er.json\n"),
    )
    path = scratch(t.spark, "dataset")
    for name, text in (("sequence", F.col("sequence")), ("config", config)):
        files_of = sets.select("nation", text.alias("value")).write.option("maxRecordsPerFile", 1)
        files_of.partitionBy("nation").text(f"{path}/{name}")
    nation = F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation")
    told = files.read_config_yaml(t.spark, f"{path}/config").filter("nested AND key = 'entity_resolution'")
    told = told.select(nation, F.col("value").alias("er_truth"))
    rows = files.read_sequence_yaml(t.spark, f"{path}/sequence")
    return rows.join(told, "nation").select("nation", "position", "file", "type", "er_truth")


@query(
    "fact_truth",
    "SRC15 ST2",
    """SELECT 'AFFILIATED' AS edge_label, 'subsidiary' AS fact_type, s_name AS from_entity,
      'nation ' || s_nationkey AS to_entity, CASE WHEN s_suppkey % 3 = 0 THEN 'inferred' ELSE 'stated' END AS confidence,
      CASE WHEN s_suppkey % 2 = 0 THEN '1998-01-01' END AS valid_until, 'edge_label,from_entity' AS matched_on
    FROM supplier""",
)
def _fact_truth(t: Tables):
    """Expected facts and the fields they are matched on, as one JSON document, read back."""
    fact = F.struct(
        F.lit("AFFILIATED").alias("edge_label"), F.lit("subsidiary").alias("fact_type"),
        F.col("s_name").alias("from_entity"), F.concat(F.lit("nation "), "s_nationkey").alias("to_entity"),
        F.when(F.col("s_suppkey") % 3 == 0, "inferred").otherwise("stated").alias("confidence"),
        F.when(F.col("s_suppkey") % 2 == 0, "1998-01-01").alias("valid_until"),
    )
    fields = F.array(F.lit("edge_label"), F.lit("from_entity")).alias("match_on")
    docs = t.raw("supplier").groupBy(F.floor(F.col("s_suppkey") / 500)).agg(F.collect_list(fact).alias("expected_facts"))
    path = scratch(t.spark, "fact-truth")
    docs.select(F.to_json(F.struct("expected_facts", fields)).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found, on = files.read_fact_truth(t.spark, path)
    return found.withColumn("matched_on", F.lit(",".join(on)))


@query(
    "alias_sources",
    "AG7",
    """SELECT DISTINCT resolved_to AS entity_id, name AS surface_form, record_id FROM ex_entities
    WHERE resolved_to <> 'new' AND lower(name) <> lower(canonical_name)""",
)
def _alias_sources(t: Tables):
    ids = build.with_entity_ids(t.extractions())
    return build.alias_sources(build.alias_rows(ids))
