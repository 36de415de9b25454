"""Queries that answer a whole question: context, relationship, state, activity."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from factloom.functions.columns import is_current, moment
from factloom.operators import facts as fq
from factloom.operators.grouped import top_per_key
from factloom.operators.records import communications
from factloom.operators.traverse import direct_facts, shortest_path

FORMATS = ("chronological", "clustered")
RELATED_RECORDS = 20  # fixed values
RELATED_SNIPPET = 200


class NotFound(LookupError):
    """No entity matches a name."""


def resolve_one(entities: DataFrame, name: str) -> Row:
    """The best match of a name, one row to the driver."""
    found = fq.search_entities(entities, name, limit=1).first()
    if found is None:
        raise NotFound(name)
    return found


def neighbours(facts: DataFrame, entities: DataFrame, entity_id: str, include_stale: bool = False):
    """One-hop neighbours of an entity without days: (node, name, node_type, first_label)."""
    pool = facts if include_stale else facts.filter(is_current())
    touching = pool.filter((F.col("from_id") == entity_id) | (F.col("to_id") == entity_id))
    seen = fq.facts_both_ways(touching).filter(
        (F.col("entity_id") == entity_id)
        & F.col("other_id").isNotNull()
        & (F.col("other_id") != entity_id)
    )
    grouped = seen.groupBy(F.col("other_id").alias("node")).agg(
        F.min_by("edge_label", "edge_id").alias("first_label")
    )
    names = entities.select(
        F.col("entity_id").alias("node"), "name", F.col("entity_type").alias("node_type")
    )
    return grouped.join(names, "node").select("node", "name", "node_type", "first_label")


@dataclass(frozen=True)
class EntityContext:
    entity: Row
    facts: DataFrame
    connections: DataFrame
    related_records: DataFrame


def entity_context(
    facts: DataFrame,
    entities: DataFrame,
    records: DataFrame,
    name: str,
    format: str = "chronological",
    include_stale: bool = False,
) -> EntityContext:
    """Facts, neighbours and newest source records of the entity that a name means."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    entity = resolve_one(entities, name)
    seen = fq.facts_for_entity(facts, entities, entity.entity_id, include_stale=include_stale)
    if format == "chronological":
        told = fq.chronological(seen)
    else:
        told = fq.in_cluster_order(fq.facts_by_label(seen))
    return EntityContext(
        entity=entity,
        facts=told,
        connections=neighbours(facts, entities, entity.entity_id, include_stale),
        related_records=related_records(seen, records),
    )


def related_records(seen: DataFrame, records: DataFrame) -> DataFrame:
    cited = seen.select(F.col("source_record").alias("record_id")).distinct()
    return (
        records.join(cited, "record_id", "left_semi")
        .select(
            "record_id",
            "type",
            "source",
            "created_at",
            F.left("content", F.lit(RELATED_SNIPPET)).alias("snippet"),
        )
        .orderBy(*fq.newest_first("created_at", "record_id"))
        .limit(RELATED_RECORDS)
    )


@dataclass(frozen=True)
class Relationship:
    entity_a: Row
    entity_b: Row
    direct_facts: DataFrame
    path: DataFrame


def relationship(facts: DataFrame, entities: DataFrame, a: str, b: str) -> Relationship:
    """How two named entities connect: facts between them and a shortest path."""
    first, second = resolve_one(entities, a), resolve_one(entities, b)
    return Relationship(
        first,
        second,
        direct_facts(facts, first.entity_id, second.entity_id),
        shortest_path(facts, entities, first.entity_id, second.entity_id),
    )


def resolver_context(
    facts: DataFrame, entities: DataFrame, chosen: DataFrame, max_facts: int = 10, max_links: int = 10
) -> DataFrame:
    """Newest facts and neighbour names of the chosen entities: (entity_id, part, text, detail)."""
    told = fq.top_facts_per_entity(facts, max_facts, chosen).select(
        "entity_id",
        F.lit("fact").alias("part"),
        F.col("fact").alias("text"),
        F.col("edge_label").alias("detail"),
    )
    linked = fq.top_connections_per_entity(facts, entities, max_links, chosen).select(
        "entity_id",
        F.lit("connection").alias("part"),
        F.col("connection").alias("text"),
        F.col("connection_type").alias("detail"),
    )
    return told.unionByName(linked)


def entity_card(facts: DataFrame, entities: DataFrame, name: str) -> tuple[Row, DataFrame, DataFrame]:
    """An entity with all its facts, stale ones too, and its neighbours with their first label."""
    entity = resolve_one(entities, name)
    seen = fq.facts_for_entity(facts, entities, entity.entity_id, include_stale=True)
    return entity, seen, neighbours(facts, entities, entity.entity_id, include_stale=True)


def current_state(facts: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    entity = resolve_one(entities, name)
    return fq.facts_for_entity(facts, entities, entity.entity_id, edge_label="AFFILIATED")


def open_commitments(
    facts: DataFrame, entity_id: str | None = None, before: date | str | None = None
) -> DataFrame:
    """Current commitments with a deadline, optionally of one entity or due before a day."""
    kept = fq.filter_facts(facts, edge_label="ASSERTED", fact_type="commitment").filter(
        F.col("valid_until").isNotNull()
    )
    if entity_id is not None:
        kept = kept.filter((F.col("from_id") == entity_id) | (F.col("to_id") == entity_id))
    if before is not None:
        kept = kept.filter(F.col("valid_until") < F.lit(before).cast("date"))
    return kept


def open_blockers(facts: DataFrame, entity_id: str | None = None) -> DataFrame:
    """Current blockers with no later resolution of the same entity.

    Only the latest resolution of an entity matters, so it is one aggregate and an equi-join.
    """
    kept = facts if entity_id is None else facts.filter(F.col("from_id") == entity_id)
    blockers = fq.filter_facts(kept, edge_label="ASSERTED", fact_type="blocker")
    solved = (
        fq.filter_facts(kept, edge_label="TRANSITIONED", fact_type="resolution")
        .groupBy("from_id")
        .agg(F.max("source_at").alias("_solved_at"))
    )
    later = F.col("_solved_at") > F.col("source_at")
    return (
        blockers.join(solved, "from_id", "left")
        .filter(~F.coalesce(later, F.lit(False)))
        .select(*facts.columns)
    )


def recent_activity(
    facts: DataFrame,
    entities: DataFrame,
    mail: DataFrame,
    name: str,
    since: datetime | str,
) -> DataFrame:
    """Transitions, references and mail of an entity since a moment, newest first."""
    entity = resolve_one(entities, name)
    seen = fq.facts_for_entity(facts, entities, entity.entity_id, since=since)
    moved = F.col("edge_label") == "TRANSITIONED"
    told = (F.col("edge_label") == "ASSERTED") & (F.col("fact_type") == "reference")
    events = seen.filter(moved | told).select(
        F.when(moved, "transition").otherwise("reference").alias("kind"),
        F.col("source_at").alias("at"),
        F.col("fact").alias("text"),
        F.col("edge_id").alias("ref"),
    )
    letters = communications(mail, entity.name, entity.email).select(
        F.lit("mail").alias("kind"),
        moment("received_at").alias("at"),
        F.col("subject").alias("text"),
        F.col("record_id").alias("ref"),
    )
    fresh = letters.filter(F.col("at") >= F.lit(since).cast("timestamp"))
    return events.unionByName(fresh).orderBy(*fq.newest_first("at", "kind", "ref"))


def recent_activity_counts(facts: DataFrame, since: datetime | str) -> DataFrame:
    """Transitions and references since a moment, per entity and kind."""
    moved = F.col("edge_label") == "TRANSITIONED"
    told = (F.col("edge_label") == "ASSERTED") & (F.col("fact_type") == "reference")
    kept = fq.filter_facts(facts, since=since).filter(moved | told)
    kind = F.when(moved, "transition").otherwise("reference").alias("kind")
    return kept.groupBy("from_id", kind).agg(
        F.count(F.lit(1)).alias("n"), F.max("source_at").alias("last_at")
    )


def canonical_facts(facts: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """Facts in the published shape: ends as structs, no target for a day, the record's link."""
    links = records.select(
        F.col("record_id").alias("source_record"), F.col("metadata")["url"].alias("source_url")
    )

    def end(prefix: str) -> Column:
        return F.struct(
            F.col(f"{prefix}_name").alias("name"),
            F.initcap(F.col(f"{prefix}_type")).alias("type"),
        )

    named = fq.with_names(facts, entities, whole=True).join(links, "source_record", "left")
    return named.select(
        "edge_id",
        "edge_label",
        "fact_type",
        "fact",
        "confidence",
        "source_at",
        "recorded_at",
        "valid_until",
        "source_record",
        "source_url",
        F.coalesce("stale", F.lit(False)).alias("stale"),
        "replaced_by",
        end("from").alias("from_entity"),
        F.when(F.col("to_day").isNull(), end("to")).alias("to_entity"),
    )


def newest_records_per_entity(facts: DataFrame, records: DataFrame, k: int = 20) -> DataFrame:
    """The newest source records of every entity's facts."""
    cited = (
        fq.facts_both_ways(facts.filter(is_current()))
        .select("entity_id", F.col("source_record").alias("record_id"))
        .distinct()
    )
    dated = cited.join(records.select("record_id", "created_at"), "record_id")
    return top_per_key(dated, ["entity_id"], fq.newest_first("created_at", "record_id"), k)
