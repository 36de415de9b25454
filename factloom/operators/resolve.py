"""Names to entities, all mentions at once.

The cascade: identifier, exact name, alias, containment. Each distinct mention is resolved once, and
each step sees only the mentions that the steps before it left open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import blank_to_null, normalised_company
from factloom.operators.facts import (
    closeness,
    top_connections_per_entity,
    top_facts_per_entity,
)
from factloom.operators.grouped import containing, near_names, top_per_key
from factloom.session import durable

MAX_CANDIDATES = 5  # fixed values
MAX_FUZZY = 3


def normalise_names(mentions: DataFrame) -> DataFrame:
    """Company names without their legal suffix; an optional step before resolution."""
    short = F.when(F.col("entity_type") == "company", normalised_company("name"))
    return mentions.withColumn("name", F.coalesce(short, F.col("name")))


def _identifiers(entities: DataFrame) -> DataFrame:
    """(entity_type, key) to the one entity with that email or domain; the smallest id of several."""
    keyed = entities.select(
        "entity_type",
        F.lower(
            F.when(F.col("entity_type") == "person", F.col("email")).when(
                F.col("entity_type") == "company", F.col("domain")
            )
        ).alias("key"),
        "entity_id",
    ).filter(blank_to_null("key").isNotNull())
    return keyed.groupBy("entity_type", "key").agg(F.min("entity_id").alias("entity_id"))


def find_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_type, name, identifier) to one entity: by exact name, else by identifier."""
    wanted = mentions.select("entity_type", "name", "identifier").distinct()
    names = entities.groupBy("entity_type", F.lower("name").alias("_name")).agg(
        F.min("entity_id").alias("_by_name")
    )
    ids = _identifiers(entities).select(
        "entity_type", F.col("key").alias("_key"), F.col("entity_id").alias("_by_id")
    )
    keyed = wanted.withColumns({"_name": F.lower("name"), "_key": F.lower("identifier")})
    joined = keyed.join(names, ["entity_type", "_name"], "left").join(
        ids, ["entity_type", "_key"], "left"
    )
    return joined.select(
        "entity_type",
        "name",
        "identifier",
        F.coalesce("_by_name", "_by_id").alias("entity_id"),
        F.when(F.col("_by_name").isNotNull(), "name")
        .when(F.col("_by_id").isNotNull(), "identifier")
        .alias("via"),
    )


def _candidates(keyed: DataFrame, out: str, limit: int) -> DataFrame:
    """(entity_type, key) to the ids of its first entities, smallest first, and the number of all.

    Only bounded rows per key leave the map tasks, however many entities share a name.
    """
    each = keyed.distinct()
    few = top_per_key(each, ["entity_type", "key"], [F.col("entity_id")], limit)
    lists = few.groupBy("entity_type", "key").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    totals = each.groupBy("entity_type", "key").agg(F.count(F.lit(1)).alias("total"))
    both = lists.join(totals, ["entity_type", "key"])
    return both.select("entity_type", "key", F.struct("ids", "total").alias(out))


def resolve_entities(
    mentions: DataFrame,
    entities: DataFrame,
    aliases: DataFrame,
    max_candidates: int = MAX_CANDIDATES,
    max_fuzzy: int = MAX_FUZZY,
    near: float | None = None,
) -> DataFrame:
    """Distinct mentions with the entities they may mean.

    Returns one row per candidate: entity_type, name, identifier, match (definitive, candidates or
    none), via, entity_id, n_candidates. The candidates of a name or alias are the first
    `max_candidates` by id, those of containment the closest `max_fuzzy`; `n_candidates` counts all of
    them, also those that are not listed. With `near`, a mention that is contained nowhere is compared
    with all names by their trigrams (`near_names`), and those as similar as that are candidates via
    `near_name`, the most similar ones first. A mention that nothing matches has one row with match `none`.

    The outcome of the equi-joins is written once; the later steps read only what they left.
    """
    keys = ["entity_type", "name", "identifier"]
    wanted = (
        mentions.select(*keys)
        .distinct()
        .withColumns({"_id": F.lower(blank_to_null("identifier")), "key": F.lower("name")})
    )
    one_of = F.struct(F.array("entity_id").alias("ids"), F.lit(1).cast("long").alias("total"))
    ids = _identifiers(entities).select(
        "entity_type", F.col("key").alias("_id"), one_of.alias("_by_id")
    )
    exact = _candidates(
        entities.select("entity_type", F.lower("name").alias("key"), "entity_id"), "_exact", max_candidates
    )
    forms = (
        aliases.filter(F.col("surface_form").isNotNull())
        .select("entity_id", F.lower("surface_form").alias("key"))
        .join(entities.select("entity_id", "entity_type"), "entity_id")
    )
    alias = _candidates(forms.select("entity_type", "key", "entity_id"), "_alias", max_candidates)
    equal = durable(
        wanted.join(ids, ["entity_type", "_id"], "left")
        .join(exact, ["entity_type", "key"], "left")
        .join(alias, ["entity_type", "key"], "left")
        .select(
            *keys,
            "key",
            F.coalesce("_by_id", "_exact", "_alias").alias("found"),
            F.when(F.col("_by_id").isNotNull(), "identifier")
            .when(F.col("_exact").isNotNull(), "exact_name")
            .when(F.col("_alias").isNotNull(), "alias")
            .alias("step"),
        )
    )
    one = F.col("found.total") == 1
    decided = equal.filter(F.col("step").isNotNull()).select(
        *keys,
        F.when(one, "definitive").otherwise("candidates").alias("match"),
        F.when(one, F.col("step"))
        .otherwise(F.concat("step", F.lit("_ambiguous")))
        .alias("via"),
        F.explode("found.ids").alias("entity_id"),
        F.col("found.total").alias("n_candidates"),
    )
    open_ = equal.filter(F.col("step").isNull()).select(*keys, "key")
    found = _fuzzy(open_, entities, max_fuzzy).withColumn("_via", F.lit("fuzzy_name"))
    if near is not None:
        found = durable(found)
        left = open_.join(found, ["entity_type", "key"], "left_anti")
        found = found.unionByName(_near(left, entities, near, max_fuzzy).withColumn("_via", F.lit("near_name")))
    hit = F.col("entity_id").isNotNull()
    last = open_.join(found, ["entity_type", "key"], "left").select(
        *keys,
        F.when(hit, "candidates").otherwise("none").alias("match"),
        F.when(hit, F.col("_via")).alias("via"),
        "entity_id",
        F.coalesce("n_candidates", F.lit(0).cast("long")).alias("n_candidates"),
    )
    return decided.unionByName(last)


def _fuzzy(open_: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """The closest entities whose name, email or domain contains the open name, and the number of all.

    Closeness depends on the names alone, so of the entities that share a text and a name `limit` are
    enough, and every distinct text is searched once. Entities of one name that hold a needle in
    different texts are told apart by counting each name's bearers once per needle.
    """
    needles = open_.filter(F.col("key") != "").select("entity_type", "key").distinct()
    kinds = needles.agg(F.collect_set("entity_type").alias("kinds")).scalar()
    pool = entities.filter(
        F.col("name").isNotNull() & F.array_contains(kinds, F.col("entity_type"))
    )
    spelled = pool.select(
        "entity_type",
        "entity_id",
        F.lower("name").alias("_name"),
        F.explode(
            F.array_distinct(F.transform(F.array("name", "email", "domain"), lambda x: F.lower(x)))
        ).alias("_text"),
    ).filter(F.col("_text").isNotNull())
    spelled = spelled.withColumn("_hash", F.sha2("_text", 256))
    texts = spelled.groupBy("entity_type", "_hash").agg(F.min("_text").alias("_text"))
    hits = durable(containing(needles, "key", texts, "_text", on=["entity_type"]))
    bearers = top_per_key(
        spelled, ["entity_type", "_hash", "_name"], [F.col("entity_id")], limit
    )
    named = hits.join(bearers, ["entity_type", "_hash"]).select("entity_type", "key", "entity_id", "_name").distinct()
    order = [*closeness("_name", F.col("key")), F.col("entity_id")]
    few = top_per_key(named, ["entity_type", "key"], order, limit)
    all_hits = hits.join(spelled.select("entity_type", "_hash", "entity_id"), ["entity_type", "_hash"])
    totals = all_hits.groupBy("entity_type", "key").agg(F.count_distinct("entity_id").alias("n_candidates"))
    return few.join(totals, ["entity_type", "key"]).select("entity_type", "key", "entity_id", "n_candidates")


def _near(open_: DataFrame, entities: DataFrame, share: float, limit: int) -> DataFrame:
    """The entities with the most similar names, and the number of all that are similar enough."""
    needles = open_.filter(F.col("key") != "").select("entity_type", "key").distinct()
    own = entities.select("entity_type", F.lower("name").alias("_name"), "entity_id").filter("_name <> ''")
    similar = near_names(
        needles, "key", own.select("entity_type", "_name").distinct(), "_name", share, on=["entity_type"]
    )
    similar = durable(similar)
    bearers = top_per_key(own, ["entity_type", "_name"], [F.col("entity_id")], limit)
    order = [F.col("similarity").desc(), F.col("_name"), F.col("entity_id")]
    few = top_per_key(similar.join(bearers, ["entity_type", "_name"]), ["entity_type", "key"], order, limit)
    counts = own.groupBy("entity_type", "_name").agg(F.count(F.lit(1)).alias("n"))
    totals = similar.join(counts, ["entity_type", "_name"]).groupBy("entity_type", "key")
    totals = totals.agg(F.sum("n").alias("n_candidates"))
    return few.join(totals, ["entity_type", "key"]).select("entity_type", "key", "entity_id", "n_candidates")


def with_brief_context(
    resolved: DataFrame, facts: DataFrame, entities: DataFrame, k: int = 3
) -> DataFrame:
    """Candidates with their newest facts and first connections as context rows.

    Adds (context, text); an entity without context keeps one row with null context. `resolved` is
    read three times, so pass a written table or a durable one.
    """
    chosen = resolved.filter(F.col("entity_id").isNotNull()).select("entity_id").distinct()
    told = top_facts_per_entity(facts, k, chosen).select(
        "entity_id",
        F.lit("fact").alias("context"),
        F.concat(F.lit("["), "edge_label", F.lit("] "), "fact").alias("text"),
    )
    linked = top_connections_per_entity(facts, entities, k, chosen).select(
        "entity_id",
        F.lit("connection").alias("context"),
        F.concat("connection", F.lit(" ("), "connection_type", F.lit(")")).alias("text"),
    )
    return resolved.join(told.unionByName(linked), "entity_id", "left")
