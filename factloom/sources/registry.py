"""The source registry as a versioned dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.grouped import top_per_key
from factloom.schema import ENTITY_TYPES
from factloom.session import small_table

KEY = ["name", "version"]


def active_versions(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("enabled"))


def all_versions(registry: DataFrame, name: str | None = None) -> DataFrame:
    kept = registry if name is None else registry.filter(F.col("name") == name)
    return kept.orderBy("name", F.col("installed_at").desc(), F.col("version").desc())


def one_version(registry: DataFrame, name: str, version: str) -> DataFrame:
    return registry.filter((F.col("name") == name) & (F.col("version") == version))


def latest_version_per_name(registry: DataFrame) -> DataFrame:
    order = [F.col("installed_at").desc_nulls_last(), F.col("version").desc()]
    return top_per_key(registry, ["name"], order, 1)


def apply_registration(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """Upserts a batch by (name, version); at most one version of a name stays enabled.

    A known version keeps its installation time. If the batch enables a version, older enabled ones
    of the name are switched off; the batch's newest enabled version wins.
    """
    fields = [c for c in registry.columns if c not in (*KEY, "installed_at")]
    old, new = registry.alias("o"), batch.alias("n")
    same = (F.col("o.name") == F.col("n.name")) & (F.col("o.version") == F.col("n.version"))
    merged = old.join(new, same, "full_outer").select(
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in KEY],
        F.coalesce("o.installed_at", "n.installed_at").alias("installed_at"),
        *[
            F.when(F.col("n.name").isNotNull(), F.col(f"n.{c}"))
            .otherwise(F.col(f"o.{c}"))
            .alias(c)
            for c in fields
        ],
        F.col("n.name").isNotNull().alias("_in_batch"),
    )
    winner = (
        merged.filter("enabled")
        .groupBy("name")
        .agg(F.max(F.struct("_in_batch", "installed_at", "version")).alias("_w"))
        .select("name", F.col("_w.version").alias("_winner"))
    )
    return (
        merged.join(winner, "name", "left")
        .withColumn("enabled", F.col("version").eqNullSafe(F.col("_winner")))
        .select(*registry.columns)
    )


def replace_children(children: DataFrame, batch_keys: DataFrame, fresh: DataFrame) -> DataFrame:
    """Child rows of re-registered versions are replaced as a whole."""
    return children.join(batch_keys.select(*KEY), KEY, "left_anti").unionByName(fresh)


def disable(registry: DataFrame, name: str) -> DataFrame:
    return registry.withColumn(
        "enabled", F.when(F.col("name") == name, F.lit(False)).otherwise(F.col("enabled"))
    )


def enable_latest_disabled(registry: DataFrame, name: str) -> DataFrame:
    """Switches on the most recently installed disabled version of a name."""
    order = [F.col("installed_at").desc_nulls_last(), F.col("version").desc()]
    off = registry.filter((F.col("name") == name) & ~F.col("enabled"))
    pick = off.orderBy(*order).limit(1).select(*KEY, F.lit(True).alias("_on"))
    return (
        registry.join(pick, KEY, "left")
        .withColumn("enabled", F.col("enabled") | F.coalesce("_on", F.lit(False)))
        .select(*registry.columns)
    )


def remove(
    registry: DataFrame, name: str, *children: DataFrame
) -> tuple[DataFrame, ...]:
    """The registry and its child tables without any version of a name."""
    return tuple(df.filter(F.col("name") != name) for df in (registry, *children))


def active_entity_types(entity_types: DataFrame, registry: DataFrame) -> DataFrame:
    """Entity types that the enabled version of each source declares."""
    return entity_types.join(active_versions(registry).select(*KEY), KEY, "left_semi")


def vocab_collisions(
    proposed: DataFrame, entity_types: DataFrame, registry: DataFrame, records_claimed: DataFrame
) -> DataFrame:
    """Names of a proposed source that are taken: (kind, source, proposed_name, taken_by).

    `proposed` has (kind, source, proposed_name) with kind entity_type, record_type or source_type;
    `records_claimed` has (kind, source, claimed_name) of the installed sources.
    """
    spark = proposed.sparkSession
    base = small_table(
        spark,
        [("entity_type", None, t) for t in ENTITY_TYPES],
        "kind string, source string, claimed_name string",
    )
    declared = active_entity_types(entity_types, registry).select(
        F.lit("entity_type").alias("kind"),
        F.col("name").alias("source"),
        F.col("type_name").alias("claimed_name"),
    )
    taken = base.unionByName(declared).unionByName(
        records_claimed.select("kind", "source", "claimed_name")
    )
    taken = taken.select(
        "kind", F.col("source").alias("taken_by"), F.lower("claimed_name").alias("_low")
    ).distinct()
    mine = proposed.withColumn("_low", F.lower("proposed_name"))
    hits = mine.join(taken, ["kind", "_low"])
    foreign = F.coalesce(F.col("taken_by") != F.col("source"), F.lit(True))
    return hits.filter(foreign).select("kind", "source", "proposed_name", "taken_by")
