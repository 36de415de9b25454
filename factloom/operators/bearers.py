"""Which bearers of a name are one entity: connected components over name, identifier and alias evidence.

A mention without an identifier (an email, a domain) has an entity of its own in the committed tables.  It
belongs to the one entity of its type that bears its name with an identifier, or that has its name as an
alias.  Where several could be meant, it stays apart and says so.  The answer is a function of all
committed rows, so it is the same in whatever order the batches came, and later evidence can undo it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import blank_to_null, stable_id, target_node
from factloom.operators.build import Commit
from factloom.operators.grouped import connected


def _identifier():
    email = F.when(F.col("entity_type") == "person", F.col("email"))
    return blank_to_null(F.coalesce(email, F.when(F.col("entity_type") == "company", F.col("domain"))))


def evidence(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, candidates, target): for each entity without an identifier whom it may be.

    `candidates` counts the entities of its type that bear its name with an identifier or have it as an
    alias; `target` is the one if there is exactly one. Names and aliases are compared as they are written.
    """
    named = entities.select("entity_id", "entity_type", "name", _identifier().alias("identifier"))
    holders = named.filter(F.col("identifier").isNotNull()).select("entity_type", "name", "entity_id")
    known_as = aliases.select("entity_id", F.col("surface_form").alias("form"))
    by_alias = named.join(known_as, "entity_id").select("entity_type", F.col("form").alias("name"), "entity_id")
    # a name may have very many bearers: they are counted before they meet the mention
    bearers = (
        holders.unionByName(by_alias)
        .groupBy("entity_type", "name")
        .agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("low"), F.max("entity_id").alias("high"))
    )
    loose = named.filter(F.col("identifier").isNull()).drop("identifier")
    met = loose.join(bearers, ["entity_type", "name"], "left")
    # an entity that has its own name as an alias is no candidate for itself
    itself = F.coalesce((F.col("low") == F.col("entity_id")) | (F.col("high") == F.col("entity_id")), F.lit(False))
    own = known_as.select(F.col("entity_id"), F.col("form").alias("name")).distinct().withColumn("own", F.lit(True))
    met = met.join(own, ["entity_id", "name"], "left")
    others = F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(False)).cast("long")
    other = F.when(itself & (F.col("low") == F.col("entity_id")), F.col("high")).otherwise(F.col("low"))
    return met.select("entity_id", others.alias("candidates"), F.when(others == 1, other).alias("target"))


def bearers(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, canonical_id, outcome, candidates) for every entity.

    Entities with exactly one candidate are linked to it; whoever is connected is one entity, which has
    the id of its member with an identifier (the smallest id if there is none, or if a chain of aliases
    connects several). `outcome` is `own`, `joined`, or `ambiguous` for more than one candidate.
    """
    found = evidence(entities, aliases)
    links = found.filter(F.col("target").isNotNull()).select(
        F.col("entity_id").alias("a"), F.col("target").alias("b")
    )
    parts = connected(links)
    member = parts.join(entities.select(F.col("entity_id").alias("id"), _identifier().alias("known")), "id")
    heads = member.groupBy("component").agg(
        F.min(F.struct(F.col("known").isNull().alias("loose"), F.col("id")))["id"].alias("canonical_id")
    )
    joined = parts.join(heads, "component").select(F.col("id").alias("entity_id"), "canonical_id")
    out = entities.select("entity_id").join(found, "entity_id", "left").join(joined, "entity_id", "left")
    canonical = F.coalesce("canonical_id", "entity_id")
    outcome = (
        F.when(F.col("candidates") > 1, "ambiguous")
        .when(canonical != F.col("entity_id"), "joined")
        .otherwise("own")
    )
    return out.select(
        "entity_id", canonical.alias("canonical_id"), outcome.alias("outcome"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


@dataclass(frozen=True)
class Unified(Commit):
    bearers: DataFrame


def unified(made: Commit, mode: str = "literal") -> Unified:
    """Committed tables with the bearers of one name as one entity.

    A joined entity gives its properties where the canonical one (or an earlier created member) has none,
    and the earliest creation time. Aliases and facts move to the canonical entity; facts that become equal
    (see `commit_facts` for `mode`) are one, with the sources of all.
    """
    who = bearers(made.entities, made.aliases)
    to = who.filter("outcome = 'joined'").select("entity_id", "canonical_id")

    def moved(df: DataFrame, column: str) -> DataFrame:
        names = to.select(F.col("entity_id").alias(column), F.col("canonical_id").alias("_to"))
        return df.join(names, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

    own = made.entities.withColumn("_id", F.col("entity_id"))
    own = moved(own, "entity_id").withColumn("_rank", F.struct(F.col("_id") != F.col("entity_id"), "created_at", "_id"))
    bag = F.coalesce("metadata", F.expr("cast(map() as map<string,string>)"))
    head = own.groupBy("entity_id").agg(
        F.min_by("entity_type", "_rank").alias("entity_type"),
        F.min_by("name", "_rank").alias("name"),
        F.min_by("email", F.when(F.col("email").isNotNull(), F.col("_rank"))).alias("email"),
        F.min_by("domain", F.when(F.col("domain").isNotNull(), F.col("_rank"))).alias("domain"),
        F.min("created_at").alias("created_at"),
    )
    values = own.select("entity_id", "_rank", F.explode(bag).alias("key", "value")).groupBy("entity_id", "key")
    bags = (
        values.agg(F.min_by("value", "_rank").alias("value"))
        .groupBy("entity_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))
    )
    entities = head.join(bags, "entity_id", "left").select(*made.entities.columns)

    # the sightings of an alias by several members: the first one's details, the latest time
    details = [c for c in made.aliases.columns if c not in ("entity_id", "surface_form", "resolved_at")]
    aliases = (
        moved(made.aliases, "entity_id")
        .groupBy("entity_id", "surface_form")
        .agg(F.min(F.struct("created_at", *[c for c in details if c != "created_at"])).alias("f"),
             F.max("resolved_at").alias("resolved_at"))
        .select("entity_id", "surface_form", *[f"f.{c}" for c in details], "resolved_at")
        .select(*made.aliases.columns)
    )

    facts = moved(moved(made.facts, "from_id"), "to_id")
    identity = ["from_id", target_node(), "edge_label", "fact_type", "fact"]
    if mode == "literal":
        identity.append("source_record")
    renamed = facts.withColumn("_new", stable_id("edge", *identity)).withColumnRenamed("edge_id", "_old")
    others = [c for c in made.facts.columns if c != "edge_id"]
    first = renamed.groupBy(F.col("_new").alias("edge_id")).agg(
        F.min_by(F.struct(*others), F.struct("source_at", "source_record", "_old")).alias("r")
    )
    edges = renamed.select(F.col("_old").alias("edge_id"), "_new")
    sources = (
        made.fact_sources.join(edges, "edge_id")
        .groupBy(F.col("_new").alias("edge_id"), "record_id")
        .agg(F.min_by("confidence", "edge_id").alias("confidence"))
    )
    return Unified(
        **{**vars(replace(made, entities=entities, aliases=aliases)),
           "alias_sources": moved(made.alias_sources, "entity_id").distinct(),
           "facts": first.select("edge_id", "r.*").select(*made.facts.columns),
           "fact_sources": sources.select(*made.fact_sources.columns),
           "records": None},
        bearers=who,
    )
