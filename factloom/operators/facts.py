"""Fact and entity queries over the bi-temporal graph."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.columns import (
    blank_to_null,
    contains_ignoring_case,
    display_name,
    is_current,
    target_node,
)
from factloom.operators.grouped import HOT_KEYS, apart, join_hot, top_per_key
from factloom.schema import ALIAS_LABEL, ENTITY_TYPES, EXPIRING_TYPES, FACT_TYPES, OP_AREAS
from factloom.session import small_table

ANY_DAY = "(Day)"


def newest_first(at: str, *ties: str) -> list[Column]:
    """Newest rows lead and rows without a time lead them all, as in the stores we replace."""
    return [F.col(at).desc_nulls_first(), *[F.col(t) for t in ties]]


# -- names ------------------------------------------------------------------------------------


def _spread_null(key: str) -> Column:
    """A join key whose nulls, which many rows may have, meet nothing and are dealt out evenly."""
    return F.coalesce(F.col(key), F.concat(F.lit("none of "), F.col("edge_id")))


def with_names(facts: DataFrame, entities: DataFrame, whole: bool = False) -> DataFrame:
    """Every fact with the names and types of its two ends; a day shows as its date.

    `whole` is for facts of a whole graph: subjects are counted first (`join_hot`), and facts about days are
    not moved to look for a target.
    """
    near = entities.select(
        F.col("entity_id").alias("from_id"),
        F.col("name").alias("from_name"),
        F.col("entity_type").alias("from_type"),
    )
    far = entities.select(
        F.col("entity_id").alias("_far"),
        F.col("name").alias("_to_name"),
        F.col("entity_type").alias("_to_type"),
    )
    if whole:
        known = join_hot(facts, near, "from_id")
        none = F.lit(None).cast("string")
        linked = known.filter(F.col("to_id").isNotNull()).join(far, F.col("to_id") == F.col("_far"), "left")
        open_ended = known.filter(F.col("to_id").isNull()).withColumns({"_to_name": none, "_to_type": none})
        joined = linked.drop("_far").unionByName(open_ended)
    else:
        joined = facts.join(near, "from_id").join(far, _spread_null("to_id") == F.col("_far"), "left")
    return joined.select(
        *[F.col(c) for c in facts.columns],
        "from_name",
        "from_type",
        display_name("_to_name", "to_day").alias("to_name"),
        F.when(F.col("to_day").isNotNull(), "day").otherwise(F.col("_to_type")).alias("to_type"),
    )


def name_few(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """`with_names` for a result that a limit has already made small.

    The two ends become rows, so the small side can be broadcast to one scan of the entities; a
    left join would have to shuffle all entities for the sake of a few rows.
    """
    ends = rows.select(
        F.struct(*rows.columns).alias("_row"),
        F.explode(
            F.array(
                F.struct(F.lit("from").alias("side"), F.col("from_id").alias("entity_id")),
                F.struct(F.lit("to").alias("side"), F.col("to_id").alias("entity_id")),
            )
        ).alias("_end"),
    ).select("_row", "_end.side", "_end.entity_id")
    found = ends.join(entities.select("entity_id", "name", "entity_type"), "entity_id")

    def pick(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    named = found.groupBy(F.col("_row.edge_id").alias("_edge")).agg(
        F.first("_row").alias("_row"),
        pick("from", "name").alias("from_name"),
        pick("from", "entity_type").alias("from_type"),
        pick("to", "name").alias("_to_name"),
        pick("to", "entity_type").alias("_to_type"),
        F.max(F.col("side") == "from").alias("_known"),
    ).filter("_known")
    return named.select(
        "_row.*",
        "from_name",
        "from_type",
        display_name("_to_name", F.col("_row.to_day")).alias("to_name"),
        F.when(F.col("_row.to_day").isNotNull(), "day")
        .otherwise(F.col("_to_type"))
        .alias("to_type"),
    )


# -- filters ----------------------------------------------------------------------------------


def filter_facts(
    facts: DataFrame,
    edge_label: str | None = None,
    fact_type: str | None = None,
    op_area: str | None = None,
    source_type: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    include_stale: bool = False,
    strict_current: bool = False,
) -> DataFrame:
    """Conjunction of simple conditions; all of them reach the scan. Both time bounds are inclusive."""
    kept = facts.filter(F.col("fact").isNotNull())
    for column, wanted in (
        ("edge_label", edge_label),
        ("fact_type", fact_type),
        ("op_area", op_area),
        ("source_type", source_type),
    ):
        if wanted is not None:
            kept = kept.filter(F.col(column) == wanted)
    if since is not None:
        kept = kept.filter(F.col("source_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        kept = kept.filter(F.col("source_at") <= F.lit(until).cast("timestamp"))
    if not include_stale:
        kept = kept.filter(is_current())
        if strict_current:
            kept = kept.filter(F.col("replaced_by").isNull())
    return kept


def as_facts(aliases: DataFrame) -> DataFrame:
    """Aliases in the shape of facts, for callers that count them as such."""
    from factloom.functions.columns import stable_id

    none = F.lit(None)
    return aliases.select(
        stable_id("alias", "entity_id", "surface_form").alias("edge_id"),
        F.col("entity_id").alias("from_id"),
        F.col("entity_id").alias("to_id"),
        none.cast("date").alias("to_day"),
        F.lit(ALIAS_LABEL).alias("edge_label"),
        none.cast("string").alias("fact_type"),
        F.concat("surface_form", F.lit(" identified as this entity")).alias("fact"),
        "confidence",
        "source_record",
        "source_type",
        none.cast("timestamp").alias("source_at"),
        none.cast("timestamp").alias("recorded_at"),
        none.cast("boolean").alias("stale"),
        none.cast("string").alias("replaced_by"),
        none.cast("date").alias("valid_until"),
        none.cast("string").alias("op_area"),
    )


def query_facts(
    facts: DataFrame,
    entities: DataFrame,
    subject: str | None = None,
    target: str | None = None,
    limit: int | None = 50,
    aliases: DataFrame | None = None,
    **conditions,
) -> DataFrame:
    """The fact query: exact names for the two ends, simple conditions, newest first.

    At most `limit` facts come back, all of them if it is None.

    A name is turned into the set of its entity ids first (a semi-join that filters the fact scan);
    names of the result are looked up after the limit.
    """
    pool = facts if aliases is None else facts.unionByName(as_facts(aliases))
    kept = filter_facts(pool, **conditions)
    if subject is not None:
        ids = entities.filter(F.col("name") == subject).select(F.col("entity_id").alias("from_id"))
        kept = kept.join(ids, "from_id", "left_semi")
    if target == ANY_DAY:
        kept = kept.filter(F.col("to_day").isNotNull())
    elif target is not None:
        ids = entities.filter(F.col("name") == target).select(
            F.col("entity_id").alias("_node")
        )
        day = F.to_date(F.try_to_timestamp(F.lit(target)))
        days = facts.sparkSession.range(1).select(
            F.concat(F.lit("day:"), day.cast("string")).alias("_node")
        )
        wanted = ids.unionByName(days.filter(F.col("_node").isNotNull()))
        kept = (
            kept.withColumn("_node", target_node())
            .join(wanted, "_node", "left_semi")
            .drop("_node")
        )
    if limit is None:
        return with_names(kept, entities).orderBy(*newest_first("source_at", "edge_id"))
    top = kept.orderBy(*newest_first("source_at", "edge_id")).limit(limit)
    return name_few(top, entities).orderBy(*newest_first("source_at", "edge_id"))


# -- facts of one entity, day, record, slot ---------------------------------------------------


def facts_both_ways(facts: DataFrame) -> DataFrame:
    """Each fact seen from both of its ends; a fact from an entity to itself is seen once."""
    out = F.struct(
        F.col("from_id").alias("entity_id"),
        F.col("to_id").alias("other_id"),
        F.col("to_day").alias("other_day"),
    )
    back = F.struct(
        F.col("to_id").alias("entity_id"),
        F.col("from_id").alias("other_id"),
        F.lit(None).cast("date").alias("other_day"),
    )
    has_back = F.col("to_id").isNotNull() & (F.col("to_id") != F.col("from_id"))
    ends = F.when(has_back, F.array(out, back)).otherwise(F.array(out))
    others = [c for c in facts.columns if c not in ("from_id", "to_id", "to_day")]
    # One scan whose rows are doubled, not a union of two scans.
    return facts.select(F.explode_outer(ends).alias("_end"), *others).select("_end.*", *others)


def _name_other(rows: DataFrame, entities: DataFrame) -> DataFrame:
    names = entities.select(
        F.col("entity_id").alias("_far"),
        F.col("name").alias("_other"),
        F.col("entity_type").alias("_other_type"),
    )
    joined = rows.join(names, _spread_null("other_id") == F.col("_far"), "left")
    return joined.select(
        *rows.columns,
        display_name("_other", "other_day").alias("other_name"),
        F.when(F.col("other_day").isNotNull(), "day")
        .otherwise(F.col("_other_type"))
        .alias("other_type"),
    )


def facts_for_entity(
    facts: DataFrame,
    entities: DataFrame,
    entity_id: str,
    edge_label: str | None = None,
    fact_type: str | None = None,
    since: datetime | str | None = None,
    include_stale: bool = False,
) -> DataFrame:
    """All facts at an entity, in either direction, with the other end shown."""
    touching = facts.filter((F.col("from_id") == entity_id) | (F.col("to_id") == entity_id))
    kept = filter_facts(
        touching,
        edge_label=edge_label,
        fact_type=fact_type,
        since=since,
        include_stale=include_stale,
    )
    seen = facts_both_ways(kept).filter(F.col("entity_id") == entity_id)
    return _name_other(seen, entities)


def facts_for_entities(
    facts: DataFrame, entities: DataFrame, chosen: DataFrame, include_stale: bool = False
) -> DataFrame:
    """`facts_for_entity` for a whole table of entity ids."""
    kept = facts_both_ways(filter_facts(facts, include_stale=include_stale))
    wanted = kept.join(chosen.select("entity_id").distinct(), "entity_id")
    return _name_other(wanted, entities)


def facts_for_day(facts: DataFrame, entities: DataFrame, day: date | str) -> DataFrame:
    """Facts anchored to a day, stale ones included."""
    kept = facts.filter(
        F.col("fact").isNotNull() & (F.col("to_day") == F.lit(day).cast("date"))
    )
    names = entities.select(
        F.col("entity_id").alias("from_id"),
        F.coalesce("name", F.lit("?")).alias("entity_name"),
        "entity_type",
    )
    return kept.join(names, "from_id")


def facts_by_source(facts: DataFrame, entities: DataFrame, record_id: str) -> DataFrame:
    """Facts whose primary source is the record."""
    kept = facts.filter((F.col("source_record") == record_id) & F.col("fact").isNotNull())
    return with_names(kept, entities)


def facts_by_any_source(
    facts: DataFrame, fact_sources: DataFrame, entities: DataFrame, record_id: str
) -> DataFrame:
    """Facts that the record confirms in any place of their source list."""
    cited = fact_sources.filter(F.col("record_id") == record_id).select("edge_id").distinct()
    kept = facts.filter(F.col("fact").isNotNull()).join(cited, "edge_id", "left_semi")
    return with_names(kept, entities)


def facts_for_slot(
    facts: DataFrame,
    from_id: str,
    edge_label: str,
    fact_type: str,
    to: str,
    include_stale: bool = False,
) -> DataFrame:
    """All edges of one (from, label, type, to) slot; `to` is an entity id or `day:<date>`."""
    kept = facts.filter(
        (F.col("from_id") == from_id)
        & (F.col("edge_label") == edge_label.upper())
        & (F.col("fact_type") == fact_type)
        & (target_node() == to)
    )
    return kept if include_stale else kept.filter(is_current())


def existing_fact(
    facts: DataFrame, from_id: str, edge_label: str, fact_type: str, to: str
) -> DataFrame:
    """The one edge that occupies a slot now: current and not replaced; the oldest id of several."""
    slot = facts_for_slot(facts, from_id, edge_label, fact_type, to)
    return slot.filter(F.col("replaced_by").isNull()).orderBy("edge_id").limit(1)


def expired_commitments(facts: DataFrame, entities: DataFrame, today: date | str) -> DataFrame:
    kept = facts.filter(is_expired(today))
    return with_names(kept, entities)


def is_expired(today: date | str) -> Column:
    """Current commitments and promises whose day has passed; the day itself still counts."""
    return (
        (F.col("edge_label") == "ASSERTED")
        & F.col("fact_type").isin(*EXPIRING_TYPES)
        & (F.col("valid_until") < F.lit(today).cast("date"))
        & is_current()
    )


def source_counts(fact_sources: DataFrame) -> DataFrame:
    """Per fact: how many records confirm it, and whether one of them states it outright."""
    return fact_sources.groupBy("edge_id").agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.coalesce(F.bool_or(F.col("confidence") == "stated"), F.lit(False)).alias("has_stated"),
    )


def inferred_multi_source(facts: DataFrame, fact_sources: DataFrame) -> DataFrame:
    """Current facts that are only inferred although several records confirm them."""
    weak = facts.filter(
        F.col("fact").isNotNull() & (F.col("confidence") == "inferred") & is_current()
    )
    counts = source_counts(
        fact_sources.join(weak.select("edge_id"), "edge_id", "left_semi")
    ).filter("n_sources > 1")
    return weak.join(counts, "edge_id")


def as_of(
    facts: DataFrame, known_at: datetime | str, true_at: datetime | str | None = None
) -> DataFrame:
    """What the graph said at a transaction time about an event time: the newest row per slot.

    Transitions are events, not states, so all of them up to the two bounds are kept.
    """
    known = facts.filter(F.col("recorded_at") <= F.lit(known_at).cast("timestamp"))
    if true_at is not None:
        known = known.filter(F.col("source_at") <= F.lit(true_at).cast("timestamp"))
    slots = known.withColumn(
        "_node",
        F.when(F.col("edge_label") == "TRANSITIONED", F.col("edge_id")).otherwise(target_node()),
    )
    newest = top_per_key(
        slots,
        ["from_id", "edge_label", "fact_type", "_node"],
        [F.col("source_at").desc_nulls_last(), F.col("edge_id").desc()],
        1,
    )
    return newest.drop("_node")


# -- entities ---------------------------------------------------------------------------------


def search_entities(
    entities: DataFrame, query: str, entity_type: str | None = None, limit: int = 5
) -> DataFrame:
    """Entities whose name, email or domain contains the text; best matches first."""
    pool = entities.filter(F.col("name").isNotNull())
    if entity_type is not None:
        pool = pool.filter(F.col("entity_type") == entity_type)
    hit = F.lit(False)
    for column in ("name", "email", "domain"):
        hit = hit | F.coalesce(contains_ignoring_case(column, query), F.lit(False))
    return pool.filter(hit).orderBy(*closeness("name", F.lit(query)), "entity_id").limit(limit)


def closeness(name: Column | str, query: Column) -> list[Column]:
    """Order of fuzzy matches: equal, then starting with the text, then shorter names."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    wanted = F.lower(query)
    return [
        F.when(low == wanted, 0).when(F.startswith(low, wanted), 1).otherwise(2).asc(),
        F.length(low).asc(),
    ]


def entity_by_id(entities: DataFrame, entity_id: str) -> DataFrame:
    return entities.filter(F.col("entity_id") == entity_id)


def find_by_alias(aliases: DataFrame, entities: DataFrame, text: str) -> DataFrame:
    """Entities with an alias that contains the text, one row per alias."""
    low = text.lower()
    statement = F.lower(F.concat("surface_form", F.lit(" identified as this entity")))
    hit = aliases.filter(
        F.contains(statement, F.lit(low)) | (F.lower("surface_form") == low)
    ).select("entity_id", "surface_form")
    return hit.join(entities, "entity_id")


def check_alias(
    aliases: DataFrame, entities: DataFrame, entity_type: str, surface_form: str
) -> DataFrame:
    """The entity of a type that is known under exactly this surface form, if any."""
    hit = aliases.filter(F.lower("surface_form") == surface_form.lower()).select("entity_id")
    typed = entities.filter(F.col("entity_type") == entity_type)
    return typed.join(hit, "entity_id", "left_semi").orderBy("entity_id").limit(1)


# -- whole-graph views ------------------------------------------------------------------------


def graph_facts(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Flat current facts by name; a day has no target name."""
    current = with_names(filter_facts(facts), entities, whole=True)
    return current.select(
        "edge_id",
        "edge_label",
        F.coalesce("fact_type", F.lit("")).alias("fact_type"),
        F.col("from_name").alias("from_entity"),
        F.when(F.col("to_day").isNull(), F.col("to_name")).alias("to_entity"),
        "fact",
        F.coalesce("confidence", F.lit("")).alias("confidence"),
        "valid_until",
        "source_record",
    )


def graph_entities(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every entity with each of its other surface forms, one row per form (one row if none)."""
    forms = aliases.filter(F.col("surface_form").isNotNull()).select("entity_id", "surface_form")
    joined = entities.select("entity_id", "entity_type", "name").join(forms, "entity_id", "left")
    same = F.lower("surface_form") == F.lower("name")
    return joined.withColumn("alias", F.when(~same, F.col("surface_form"))).drop("surface_form")


def schema_vocabulary(vocab: DataFrame, records: DataFrame, entity_types=ENTITY_TYPES) -> DataFrame:
    """All names a query may filter on, as (kind, label, name) rows."""
    spark = vocab.sparkSession
    fixed = [("entity_type", None, t) for t in entity_types]
    fixed += [("op_area", None, a) for a in OP_AREAS]
    fixed += [("edge_label", None, label) for label in FACT_TYPES]
    named = small_table(spark, fixed, "kind string, label string, name string")
    types = vocab.select(
        F.lit("fact_type").alias("kind"), F.col("edge_label").alias("label"), "fact_type"
    ).toDF("kind", "label", "name")
    sources = (
        records.filter(F.col("type").isNotNull())
        .select("type")
        .distinct()
        .select(
            F.lit("source_type").alias("kind"), F.lit(None).cast("string").alias("label"), "type"
        )
        .toDF("kind", "label", "name")
    )
    return named.unionByName(types).unionByName(sources)


def graph_stats(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Counts of the whole graph as (measure, name, total, current) rows.

    One pass over the facts: grouping sets give totals per label, per type and overall.
    """
    base = facts.filter(F.col("fact").isNotNull()).select(
        "edge_label",
        F.col("fact_type"),
        is_current().cast("long").alias("current"),
        "to_day",
    )
    sets = base.groupingSets(
        [["edge_label"], ["fact_type"], []], "edge_label", "fact_type"
    ).agg(
        F.grouping("edge_label").alias("g_label"),
        F.grouping("fact_type").alias("g_type"),
        F.count(F.lit(1)).alias("total"),
        F.sum("current").alias("current"),
    )
    counts = sets.filter((F.col("g_type") == 1) | F.col("fact_type").isNotNull()).select(
        F.when(F.col("g_label") == 0, "edge_label")
        .when(F.col("g_type") == 0, "fact_type")
        .otherwise("facts")
        .alias("measure"),
        F.when(F.col("g_label") == 0, F.col("edge_label"))
        .when(F.col("g_type") == 0, F.col("fact_type"))
        .otherwise(F.lit(""))
        .alias("name"),
        F.col("total"),
        F.col("current"),
    )
    days = base.agg(F.countDistinct("to_day").alias("total")).select(
        F.lit("days").alias("measure"),
        F.lit("").alias("name"),
        "total",
        F.col("total").alias("current"),
    )
    kinds = entities.rollup("entity_type").agg(
        F.count(F.lit(1)).alias("total"), F.grouping("entity_type").alias("g")
    )
    per_type = kinds.select(
        F.when(F.col("g") == 1, "entities").otherwise("entity_type").alias("measure"),
        F.when(F.col("g") == 1, F.lit("")).otherwise(F.col("entity_type")).alias("name"),
        "total",
        F.col("total").alias("current"),
    )
    return counts.unionByName(days).unionByName(per_type)


def facts_by_label(seen: DataFrame) -> DataFrame:
    """Facts of entities with the size of their (entity, label) cluster.

    The cluster is a column and not a nested list, so a very large cluster stays many rows; its size
    is an aggregate joined back, so no task has to hold a cluster.
    """
    sizes = seen.groupBy("entity_id", "edge_label").agg(F.count(F.lit(1)).alias("cluster_size"))
    return seen.join(sizes, ["entity_id", "edge_label"])


def in_cluster_order(clustered: DataFrame) -> DataFrame:
    return clustered.orderBy("entity_id", "edge_label", *newest_first("source_at", "edge_id"))


def chronological(seen: DataFrame) -> DataFrame:
    """Oldest first; facts without a time lead."""
    return seen.orderBy(F.col("source_at").asc_nulls_first(), "edge_id")


def _top_of_chosen(
    rows: DataFrame, chosen: DataFrame | None, top: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """`top` of the rows at the chosen entities.

    Few chosen ids (counted first) are sent to the rows. Of many, the top rows of all entities meet the ids:
    they are the same, and far fewer rows are moved.
    """
    if chosen is None:
        return top(rows)
    ids = chosen.select("entity_id").distinct()
    if ids.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return top(rows.join(F.broadcast(ids), "entity_id", "left_semi"))
    return top(rows).join(ids, "entity_id", "left_semi")


def top_facts_per_entity(
    facts: DataFrame, k: int = 10, chosen: DataFrame | None = None
) -> DataFrame:
    """The newest `k` current facts at each entity.

    Only the facts of hot entities are limited before they are moved: that takes sorting them.
    """
    seen = facts_both_ways(filter_facts(facts))
    order = newest_first("source_at", "edge_id")

    def top(rows: DataFrame) -> DataFrame:
        found = [top_per_key(part, ["entity_id"], order, k) for part in apart(rows, "entity_id")]
        return reduce(DataFrame.unionByName, found)

    return _top_of_chosen(seen, chosen, top)


def _connection_ends(entities: DataFrame) -> DataFrame:
    return entities.filter(blank_to_null("name").isNotNull()).select(
        F.col("entity_id").alias("other_id"),
        F.col("name").alias("connection"),
        F.col("entity_type").alias("connection_type"),
    )


def connection_names(
    facts: DataFrame, entities: DataFrame, chosen: DataFrame | None = None
) -> DataFrame:
    """Distinct (entity, name, type) of the current one-hop neighbours; days are not neighbours."""
    pairs = facts_both_ways(facts.filter(is_current() & F.col("to_id").isNotNull()))
    pairs = pairs.filter(F.col("other_id") != F.col("entity_id")).select("entity_id", "other_id")
    if chosen is not None:
        pairs = pairs.join(chosen.select("entity_id").distinct(), "entity_id")
    named = pairs.distinct().join(_connection_ends(entities), "other_id")
    return named.groupBy("entity_id", "connection").agg(
        F.min_by("connection_type", "other_id").alias("connection_type")
    )


def top_connections_per_entity(
    facts: DataFrame, entities: DataFrame, k: int = 10, chosen: DataFrame | None = None
) -> DataFrame:
    """The first `k` neighbour names of each entity in their order, as `connection_names` gives them.

    Edges collapse before they are doubled, and entities keep the rows of their first `k` names before these
    are grouped, so that one shuffle by entity serves both.
    """
    linked = facts.filter(is_current() & (F.col("from_id") != F.col("to_id")))
    edges = linked.select("from_id", "to_id", F.lit(None).cast("date").alias("to_day")).distinct()
    pairs = facts_both_ways(edges).select("entity_id", "other_id")

    def top(rows: DataFrame) -> DataFrame:
        named = join_hot(rows, _connection_ends(entities), "other_id")
        rank = F.dense_rank().over(Window.partitionBy("entity_id").orderBy("connection"))
        first = named.withColumn("_rank", rank).filter(F.col("_rank") <= k)
        return first.groupBy("entity_id", "connection").agg(
            F.min_by("connection_type", "other_id").alias("connection_type")
        )

    return _top_of_chosen(pairs, chosen, top)
