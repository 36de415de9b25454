"""Files in and out: JSON records, seed files, evaluation datasets, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.columns import stable_id

# --- fixed values: the seed file format -------------------------------------------------------
SECTIONS = ("people", "companies", "projects", "facts", "aliases")
SENTENCES = {
    "employee": "is employed at",
    "contractor": "is a contractor at",
    "advisor": "is an advisor to",
    "board_member": "is a board member of",
    "founder": "founded",
    "investor": "is an investor in",
    "legal_counsel": "is legal counsel for",
    "consultant": "is a consultant for",
    "owner": "owns",
    "contributor": "contributes to",
    "reviewer": "reviews",
    "stakeholder": "is a stakeholder in",
    "subsidiary": "is a subsidiary of",
    "sub_project": "is a sub-project of",
}
# --- end of fixed values ----------------------------------------------------------------------


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType | str, glob: str = "*.json"
) -> DataFrame:
    """JSON files under a path; a file holds a list of objects or one object."""
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .json(path)
    )


def read_seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of seed files with the section they stand in: (record_id, position, section, cells)."""
    whole = spark.read.text(path, wholetext=True).filter(F.trim("value") != "")
    return seed_lines(whole.select(F.col("value").alias("raw")))


def seed_records(raw: DataFrame, source: str = "ingest_expert") -> DataFrame:
    """Whole seed files as records that need no triage."""
    return raw.select(
        stable_id("ingest", "raw").alias("record_id"),
        F.lit("ingest").alias("type"),
        F.lit(source).alias("source"),
        F.col("raw").alias("content"),
        F.lit("relevant").alias("classification"),
    )


def seed_lines(raw: DataFrame) -> DataFrame:
    """Cuts each file at its section headers, so that no ordering across rows is needed."""
    header = r"(?m)^##[ \t]+"
    parts = raw.select(
        stable_id("ingest", "raw").alias("record_id"),
        F.posexplode(F.split(F.concat(F.lit("\n"), "raw"), header)).alias("_part", "_text"),
    ).filter("_part > 0")
    head = F.split_part("_text", F.lit("\n"), F.lit(1))
    named = parts.withColumn("section", F.lower(F.trim(head)))
    lines = named.select(
        "record_id",
        "section",
        "_part",
        F.posexplode(F.split("_text", "\n")).alias("_line", "line"),
    ).filter("_line > 0")
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    kept = lines.filter((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#")))
    return kept.select(
        "record_id",
        (F.shiftleft(F.col("_part").cast("long"), 32) + F.col("_line")).alias("position"),
        "section",
        cells.alias("cells"),
    )


def seed_entities(lines: DataFrame) -> DataFrame:
    """Declared entities and aliases in the shape of extracted entities.

    Sections other than the known ones declare a deployment's own entity types, named after them.
    """
    cell = F.col("cells")

    def at(i: int) -> Column:
        return F.nullif(F.get(cell, F.lit(i)), F.lit(""))

    kind = (
        F.when(F.col("section") == "people", "person")
        .when(F.col("section") == "companies", "company")
        .when(F.col("section") == "projects", "project")
        .otherwise(F.col("section"))
    )
    declared = lines.filter(~F.col("section").isin("facts", "aliases")).select(
        "record_id",
        "position",
        at(0).alias("name"),
        kind.alias("type"),
        F.when(F.col("section") == "people", at(1)).alias("role"),
        F.when(F.col("section") == "people", at(2)).alias("email"),
        F.when(F.col("section") == "companies", at(1)).alias("domain"),
        at(0).alias("canonical_name"),
    )
    forms = lines.filter(F.col("section") == "aliases").select(
        "record_id",
        "position",
        at(0).alias("canonical_name"),
        F.explode(F.filter(F.slice(cell, F.lit(2), F.size(cell)), lambda c: c != "")).alias("name"),
    )
    kinds = declared.groupBy("record_id", F.col("name").alias("canonical_name")).agg(
        F.min("type").alias("type")
    )
    none = F.lit(None).cast("string")
    aliases = forms.join(kinds, ["record_id", "canonical_name"], "left").select(
        "record_id",
        "position",
        "name",
        "type",
        none.alias("role"),
        none.alias("email"),
        none.alias("domain"),
        "canonical_name",
    )
    return declared.unionByName(aliases)


def seed_facts(lines: DataFrame) -> DataFrame:
    """Declared facts. A fourth cell is the fact text as it stands; else a sentence is made."""
    cell = F.col("cells")
    label = F.upper(F.split_part(cell[1], F.lit("/"), F.lit(1)))
    kind = F.lower(F.split_part(cell[1], F.lit("/"), F.lit(2)))
    verb = None
    for name, words in SENTENCES.items():
        verb = F.when(kind == name, words) if verb is None else verb.when(kind == name, words)
    verb = verb.otherwise(F.concat(F.lit("has a "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" link to")))
    written = F.nullif(F.get(cell, F.lit(3)), F.lit(""))
    return lines.filter((F.col("section") == "facts") & (F.size(cell) >= 3)).select(
        "record_id",
        "position",
        label.alias("edge_label"),
        kind.alias("fact_type"),
        F.coalesce(written, F.concat_ws(" ", cell[0], verb, cell[2])).alias("fact"),
        cell[0].alias("from_entity"),
        cell[2].alias("to_entity"),
        F.lit("stated").alias("confidence"),
        F.lit(None).cast("string").alias("valid_until"),
    )


SEQUENCE_SCHEMA = "file string, type string"
ER_TRUTH_SCHEMA = (
    "global array<struct<canonical_name:string,surface_forms:array<string>>>, "
    "timeslices array<struct<record:string,"
    "entities:array<struct<canonical_name:string,surface_forms:array<string>>>>>"
)
FACT_TRUTH_SCHEMA = (
    "expected_facts array<struct<edge_label:string,fact_type:string,from_entity:string,"
    "to_entity:string,confidence:string,valid_until:string>>, match_on array<string>"
)


def read_config_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Flat `key: value` lines of small YAML files as (path, key, value), nested keys dotted.

    Covers what dataset files use: one level of nesting and scalar values.
    """
    whole = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.posexplode(F.split("value", "\n")).alias("position", "line"),
    )
    pattern = r"^(\s*)([A-Za-z_][\w-]*):\s*(.*?)\s*$"
    return whole.filter(F.rlike("line", F.lit(pattern))).select(
        "path",
        "position",
        (F.length(F.regexp_extract("line", pattern, 1)) > 0).alias("nested"),
        F.regexp_extract("line", pattern, 2).alias("key"),
        F.regexp_replace(F.regexp_extract("line", pattern, 3), r"^[\"']|[\"']$", "").alias("value"),
    )


def read_sequence_yaml(spark: SparkSession, path: str) -> DataFrame:
    """The ordered record list of an evaluation dataset: (position, file, type).

    Each `- file:` item is cut out of the text as a whole, so order is the item's place in its file.
    """
    given = spark.read.text(path, wholetext=True)
    # a folder with a dataset per partition keeps its columns
    sets = [c for c in given.columns if c != "value"]
    items = given.select(
        *sets,
        F.posexplode(F.split(F.concat(F.lit("\n"), "value"), r"\n\s*-\s+")).alias("position", "item"),
    )

    def value(key: str) -> Column:
        found = F.regexp_extract("item", rf"(?m)^\s*{key}:\s*[\"']?([^\"'\n]*?)[\"']?\s*$", 1)
        return F.nullif(found, F.lit(""))

    rows = items.filter("position > 0").select(
        *sets, (F.col("position") - 1).alias("position"), value("file").alias("file"), value("type").alias("type")
    )
    return rows.filter(F.col("file").isNotNull())


def read_er_truth(spark: SparkSession, path: str) -> DataFrame:
    """Expected entities as (slice, canonical_name, surface_form); the whole truth has slice null."""
    doc = spark.read.schema(ER_TRUTH_SCHEMA).option("multiLine", True).json(path)
    whole = doc.select(F.lit(None).cast("string").alias("slice"), F.explode("global").alias("e"))
    parts = doc.select(F.explode("timeslices").alias("t")).select(
        F.col("t.record").alias("slice"), F.explode("t.entities").alias("e")
    )
    return whole.unionByName(parts).select(
        "slice", "e.canonical_name", F.explode_outer("e.surface_forms").alias("surface_form")
    )


def read_fact_truth(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Expected facts and the fields they are matched on."""
    doc = spark.read.schema(FACT_TRUTH_SCHEMA).option("multiLine", True).json(path)
    fields = doc.select("match_on").first()
    return doc.select(F.explode("expected_facts").alias("f")).select("f.*"), list(fields[0] or [])


# -- sinks ------------------------------------------------------------------------------------


def write_eval_results(scores: DataFrame, path: str) -> None:
    """Scores as JSON under their engine_version and dataset_version; a repeated run replaces its own."""
    (
        scores.withColumn("run_at", F.current_timestamp())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("engine_version", "dataset_version")
        .json(path)
    )


def write_usage_report(
    summary: DataFrame, per_record: DataFrame, per_call: DataFrame, path: str
) -> None:
    """The three parts of a usage report as JSON folders of their own."""
    for name, part in (("summary", summary), ("per_record", per_record), ("calls", per_call)):
        part.write.mode("overwrite").json(f"{path}/{name}")


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts by label, so that a query for one label reads one folder."""
    (
        facts.write.mode("overwrite")
        .partitionBy("edge_label")
        .parquet(path)
    )
