"""Checks of extractor output. They report; they do not reject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import blank_to_null, grounding
from factloom.schema import FACT_TYPES

LOW_GROUNDING = 0.6  # fixed value


def unknown_resolutions(extractions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions resolved to an id that no entity has."""
    resolved = extractions.select("record_id", F.explode("entities").alias("e")).select(
        "record_id", F.col("e.name").alias("name"), F.col("e.resolved_to").alias("entity_id")
    )
    named = resolved.filter(
        blank_to_null("entity_id").isNotNull() & (F.col("entity_id") != "new")
    )
    return named.join(entities.select("entity_id"), "entity_id", "left_anti")


def checked_facts(extractions: DataFrame) -> DataFrame:
    """Facts with their checks; the names they may refer to come from the same row."""
    known = F.transform("entities", lambda e: F.lower(e["name"]))
    facts = extractions.select(
        "record_id", "content", known.alias("_known"), F.posexplode("facts").alias("position", "f")
    )

    def unknown(column: str):
        name = F.lower(F.coalesce(F.col(column), F.lit("")))
        return (name != "") & ~F.array_contains("_known", name)

    label = F.coalesce("f.edge_label", F.lit(""))
    return facts.select(
        "record_id",
        "position",
        F.col("f.edge_label").alias("edge_label"),
        F.col("f.fact_type").alias("fact_type"),
        F.col("f.fact").alias("fact"),
        F.col("f.from_entity").alias("from_entity"),
        F.col("f.to_entity").alias("to_entity"),
        label.isin(*FACT_TYPES).alias("label_ok"),
        unknown("f.from_entity").alias("from_unknown"),
        unknown("f.to_entity").alias("to_unknown"),
        F.when(blank_to_null("f.fact").isNotNull(), grounding("f.fact", "content")).alias(
            "grounding"
        ),
    )


def fact_errors(extractions: DataFrame) -> DataFrame:
    """One row per error: (record_id, position, error, detail). A bad label ends a fact's checks."""
    c = checked_facts(extractions)
    low = F.coalesce(F.col("grounding") < LOW_GROUNDING, F.lit(False))

    def error(when, name, detail):
        return F.struct(
            when.alias("is"), F.lit(name).alias("error"), F.col(detail).alias("detail")
        )

    errors = F.array(
        error(~F.col("label_ok"), "invalid_label", "edge_label"),
        error(F.col("label_ok") & F.col("from_unknown"), "unknown_from", "from_entity"),
        error(F.col("label_ok") & F.col("to_unknown"), "unknown_to", "to_entity"),
        error(F.col("label_ok") & low, "low_grounding", "fact"),
    )
    found = c.select(
        "record_id", "position", F.explode_outer(F.filter(errors, lambda e: e["is"])).alias("e")
    ).filter(F.col("e").isNotNull())
    return found.select("record_id", "position", "e.error", "e.detail")


def novel_fact_types(extractions: DataFrame, vocab: DataFrame) -> DataFrame:
    """Types outside the vocabulary under a valid label: proposals, not errors."""
    c = checked_facts(extractions).filter(
        F.col("label_ok") & blank_to_null("fact_type").isNotNull()
    )
    return c.select("record_id", "position", "edge_label", "fact_type").join(
        vocab.select("edge_label", "fact_type"), ["edge_label", "fact_type"], "left_anti"
    )
