"""Record quality and record queries: dedup, classification, upserts, filters, communications."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.columns import (
    METADATA_KEY,
    blank_to_null,
    contains_ignoring_case,
)
from factloom.operators.facts import newest_first
from factloom.operators.grouped import containing, top_per_key
from factloom.schema import RECORDS
from factloom.session import written

# -- dedup and upsert -------------------------------------------------------------------------


def dedup_records(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """First row per dedup key among the new rows, and none whose key is already stored.

    The key counts across record types. Rows without a key are all kept; each is its own group, so
    they do not meet in one task.
    """
    keyed = new.withColumn(
        "_key",
        F.coalesce(
            F.concat(F.lit("k"), blank_to_null("dedup_key")), F.concat(F.lit("r"), "record_id")
        ),
    )
    if stored is not None:
        seen = stored.filter(blank_to_null("dedup_key").isNotNull()).select(
            F.concat(F.lit("k"), "dedup_key").alias("_key")
        )
        keyed = keyed.join(seen, "_key", "left_anti")
    blank = keyed.filter(F.startswith("_key", F.lit("r")))
    first = top_per_key(
        keyed.filter(F.startswith("_key", F.lit("k"))),
        ["_key"],
        [F.col("created_at").asc_nulls_last(), F.col("record_id")],
        1,
    )
    return first.unionByName(blank).drop("_key")


def upsert_issues(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored issues brought up to date: fields change, record id and creation time stay.

    `stored` has record_id, linear_id, created_at and fields; `incoming` has linear_id, updated_at
    and the same fields. The newest incoming row of an issue counts. `is_new` marks new issues.
    """
    fields = [
        c for c in incoming.columns if c in stored.columns and c not in ("linear_id", "created_at")
    ]
    ties = F.xxhash64(*[F.col(c).cast("string") for c in fields])
    latest = top_per_key(
        incoming, ["linear_id"], [F.col("updated_at").desc_nulls_last(), ties], 1
    ).withColumn("_arrived", F.lit(True))
    old, new = stored.alias("o"), latest.alias("n")
    merged = old.join(new, F.col("o.linear_id") == F.col("n.linear_id"), "full_outer")
    arrived = F.col("n._arrived").isNotNull()

    def pick(c: str) -> Column:
        return F.when(arrived, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    is_new = F.col("o.linear_id").isNull()
    linear_id = F.coalesce("o.linear_id", "n.linear_id")
    return merged.select(
        F.coalesce(
            "o.record_id", F.concat(F.lit("issue_"), F.left(F.sha2(linear_id, 256), F.lit(20)))
        ).alias("record_id"),
        linear_id.alias("linear_id"),
        F.coalesce("o.created_at", "n.created_at").alias("created_at"),
        *[pick(c) for c in fields],
        F.when(is_new, "new").when(arrived, "updated").otherwise("kept").alias("change"),
    )


# -- classification ---------------------------------------------------------------------------


def classify_policy(policy: Column | str, explicit: Column | str = "classification") -> Column:
    """An explicit label wins; else the source's policy decides; else there is no label yet."""
    given = F.col(explicit) if isinstance(explicit, str) else explicit
    rule = F.lit(policy) if isinstance(policy, str) else policy
    by_policy = F.when(rule == "skip", "relevant").when(rule == "required", "pending_triage")
    return F.coalesce(given, by_policy)


def mark_manual(records: DataFrame, manual: DataFrame) -> DataFrame:
    """Records that a person hands in are relevant, whatever a filter said about them.

    What the person adds in `human_context`, where `manual` has that column, becomes the record's (the
    largest of several); a blank one changes nothing.
    """
    told = "human_context" in manual.columns and "human_context" in records.columns
    context = F.max(blank_to_null("human_context")) if told else F.lit(None).cast("string")
    ids = manual.groupBy("record_id").agg(F.lit(True).alias("_manual"), context.alias("_context"))
    label = F.when(F.col("_manual"), "relevant").otherwise(F.col("classification"))
    joined = records.join(ids, "record_id", "left").withColumn("classification", label)
    if told:
        joined = joined.withColumn("human_context", F.coalesce("_context", "human_context"))
    return joined.select(*records.columns)


def extraction_text(records: DataFrame) -> Column:
    """The text that is extracted and grounded: the content and what a person added to it."""
    content = F.coalesce("content", F.lit(""))
    if "human_context" not in records.columns:
        return content
    # The wording is a fixed value.
    added = F.concat(content, F.lit("\n\nAdditional context from human:\n"), F.col("human_context"))
    return F.when(F.coalesce("human_context", F.lit("")) != "", added).otherwise(content)


def write_records(
    new: DataFrame, path: str, policy: Column | str | None = None, at: Column | None = None
) -> int:
    """Appends records to the record table at `path`, a folder per type, and returns how many are new.

    Keys that the table has already stay out, and so do ids, so a repeated load adds nothing. New rows
    without a creation time get `at` (default: now); columns of `RECORDS` that are missing are null.
    """
    spark = new.sparkSession
    full = new.select(
        *[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORDS]
    )
    stored = read_records(spark, path)
    fresh = save_records(full, stored.select("dedup_key"), policy)
    fresh = fresh.join(stored.select("record_id"), "record_id", "left_anti")
    arrived = F.current_timestamp() if at is None else at
    fresh = fresh.withColumns(
        {"created_at": F.coalesce("created_at", arrived), "indexed": F.coalesce("indexed", F.lit(False))}
    )
    # written beside the table first: what is appended must not read the folder it goes to
    fresh = written(fresh.select(*RECORDS.fieldNames()), "new-records")
    fresh.write.mode("append").partitionBy("type").parquet(path)
    return fresh.count()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The record table at `path`, empty before the first write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], RECORDS)
    return spark.read.schema(RECORDS).parquet(path).select(*RECORDS.fieldNames())


def apply_triage(records: DataFrame, decisions: DataFrame, final: bool = True) -> DataFrame:
    """Decisions to labels for records that wait for triage.

    Of several decisions the latest by `decided_at` counts, where that column is given. A waiting
    record without a decision becomes uncertain, or goes on waiting if this is not `final`. `op_area` goes into the metadata only
    where the source did not set it, `reality` if the decision names none.
    """
    waiting = F.col("classification") == "pending_triage"
    order = [c for c in ("decided_at",) if c in decisions.columns]
    verdict = decisions.groupBy("record_id").agg(
        F.max(F.struct(*order, "classification", "op_area")).alias("_verdict")
    )
    joined = records.join(verdict, "record_id", "left")
    decided = F.coalesce(waiting, F.lit(False)) & F.col("_verdict").isNotNull()
    unset = F.col("metadata")["op_area"].isNull()
    area = F.coalesce(F.col("_verdict.op_area"), F.lit("reality"))
    bag = F.coalesce("metadata", F.expr("cast(map() as map<string,string>)"))
    without = F.map_filter(bag, lambda k, _: k != "op_area")
    return joined.withColumns(
        {
            "metadata": F.when(
                decided & unset, F.map_concat(without, F.create_map(F.lit("op_area"), area))
            ).otherwise(F.col("metadata")),
            "classification": F.when(decided, F.col("_verdict.classification"))
            .when(waiting & F.lit(final), "uncertain")
            .otherwise(F.col("classification")),
        }
    ).select(*records.columns)


def save_records(
    new: DataFrame, stored: DataFrame | None = None, policy: Column | str | None = None
) -> DataFrame:
    """The record sink's transform: dedup, then the source's policy for rows without a label."""
    fresh = dedup_records(new, stored)
    if policy is None:
        return fresh
    return fresh.withColumn("classification", classify_policy(policy))


# -- queries ----------------------------------------------------------------------------------


def query_records(
    records: DataFrame,
    record_type: str | None = None,
    source: str | None = None,
    expert: str | None = None,
    classification: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    metadata: dict | None = None,
    limit: int = 50,
) -> DataFrame:
    """Records under simple conditions, newest first. Metadata keys that are no names are ignored."""
    kept = records
    for column, wanted in (
        ("type", record_type),
        ("expert_name", expert),
        ("classification", classification),
    ):
        if wanted is not None:
            kept = kept.filter(F.col(column) == wanted)
    if source is not None:
        kept = kept.filter(contains_ignoring_case("source", source))
    if since is not None:
        kept = kept.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        kept = kept.filter(F.col("created_at") <= F.lit(until).cast("timestamp"))
    for key, value in (metadata or {}).items():
        if METADATA_KEY.match(key):
            kept = kept.filter(F.col("metadata")[key] == str(value))
    return (
        kept.select(
            "record_id",
            "type",
            "source",
            "classification",
            "expert_name",
            "expert_version",
            "created_at",
            "metadata",
            F.left("content", F.lit(300)).alias("snippet"),
        )
        .orderBy(*newest_first("created_at", "record_id"))
        .limit(limit)
    )


def record_by_id(records: DataFrame, record_id: str) -> DataFrame:
    return records.filter(F.col("record_id") == record_id)


def with_typed(records: DataFrame, typed: DataFrame, how: str = "inner") -> DataFrame:
    """Records beside their row in a typed table."""
    return records.select("record_id", "source", "created_at").join(typed, "record_id", how)


def typed_by_key(records: DataFrame, typed: DataFrame, column: str, value: str) -> DataFrame:
    """The typed row with a source's own key, and its record."""
    return with_typed(records, typed.filter(F.col(column) == value))


def list_typed(records: DataFrame, typed: DataFrame, limit: int = 20) -> DataFrame:
    """Newest typed rows. Only narrow record columns are ordered; wide typed rows join the result."""
    few = (
        records.select("record_id", "source", "created_at")
        .join(typed.select("record_id"), "record_id", "left_semi")
        .orderBy(*newest_first("created_at", "record_id"))
        .limit(limit)
    )
    return few.join(typed, "record_id")


def list_records(records: DataFrame, limit: int = 20) -> DataFrame:
    return (
        records.select("record_id", "type", "source", "classification", "created_at", "indexed")
        .orderBy(*newest_first("created_at", "record_id"))
        .limit(limit)
    )


def pending_records(
    records: DataFrame, mail: DataFrame, issues: DataFrame, limit: int = 10
) -> DataFrame:
    """Newest unclassified records with their mail and issue columns side by side."""
    waiting = (
        records.filter(F.col("classification").isNull())
        .select("record_id", "type", "source", "created_at")
        .orderBy(*newest_first("created_at", "record_id"))
        .limit(limit)
    )
    ids = waiting.select("record_id")
    letters = mail.select("record_id", "sender", "subject", "body")
    tickets = issues.select(
        "record_id",
        "identifier",
        F.col("title").alias("issue_title"),
        F.col("status").alias("issue_status"),
        F.col("priority").alias("issue_priority"),
        F.col("assignee").alias("issue_assignee"),
    )
    return waiting.join(letters.join(ids, "record_id", "left_semi"), "record_id", "left").join(
        tickets.join(ids, "record_id", "left_semi"), "record_id", "left"
    )


def pending_extraction(records: DataFrame) -> DataFrame:
    """Relevant records that were not extracted yet; order by `created_at` to work oldest first."""
    done = F.coalesce("indexed", F.lit(False))
    return records.filter((F.col("classification") == "relevant") & ~done)


def next_for_extraction(records: DataFrame, limit: int) -> DataFrame:
    return (
        pending_extraction(records)
        .orderBy(F.col("created_at").asc_nulls_first(), "record_id")
        .limit(limit)
    )


# -- communications ---------------------------------------------------------------------------

MAIL_COLUMNS = ("sender", "recipients", "subject", "received_at")


def mail_view(records: DataFrame) -> DataFrame:
    return records.filter(F.col("type") == "email").select(
        "record_id", *[F.col("metadata")[c].alias(c) for c in MAIL_COLUMNS]
    )


def communications(
    mail: DataFrame, name: str, email: str | None = None, since: str | None = None, limit: int = 20
) -> DataFrame:
    """Newest mail that one entity sent or received, found by name or by address."""
    hit = F.lit(False)
    for needle in {n for n in (name, email) if n}:
        for column in ("sender", "recipients"):
            found = contains_ignoring_case(column, needle)
            hit = hit | F.coalesce(found, F.lit(False))
    kept = mail.filter(hit)
    if since is not None:
        kept = kept.filter(F.col("received_at") >= since)
    return kept.orderBy(*newest_first("received_at", "record_id")).limit(limit)


def communications_of_all(
    mail: DataFrame, entities: DataFrame, since: str | None = None, per_entity: int = 20
) -> DataFrame:
    """`communications` for every entity at once.

    Addresses repeat, so each distinct address text is matched once against the names and addresses of
    the entities, by `containing`. Mail to very many recipients is no large row there: its text is cut into
    segments, and hits name it by its hash.
    """
    kept = mail if since is None else mail.filter(F.col("received_at") >= since)
    needles = entities.select(
        "entity_id", F.explode(F.array_distinct(F.array("name", "email"))).alias("_needle")
    ).filter(blank_to_null("_needle").isNotNull())
    needles = needles.withColumn("_needle", F.lower("_needle"))
    sides = kept.select(
        "record_id", "received_at", F.explode(F.array("sender", "recipients")).alias("_text")
    )
    sides = sides.filter(F.col("_text").isNotNull()).withColumn("_text", F.lower("_text"))
    sides = sides.withColumn("_hash", F.sha2("_text", 256))
    texts = sides.groupBy("_hash").agg(F.min("_text").alias("_text"))
    hits = containing(needles, "_needle", texts, "_text").select("entity_id", "_hash").distinct()
    found = sides.drop("_text").join(hits, "_hash").select("entity_id", "record_id", "received_at").distinct()
    return top_per_key(
        found, ["entity_id"], newest_first("received_at", "record_id"), per_entity
    )
