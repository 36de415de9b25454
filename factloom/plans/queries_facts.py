"""Fact, entity and curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import curate, facts
from factloom.plans.catalog import query
from factloom.schema import vocabulary
from factloom.sources.tables import Tables

SEC = "'%Y-%m-%d %H:%M:%S'"
NAMED = """named AS (
  SELECT f.*, a.name AS from_name, a.entity_type AS from_type,
         coalesce(b.name, CAST(f.to_day AS VARCHAR), '?') AS to_name,
         CASE WHEN f.to_day IS NOT NULL THEN 'day' ELSE b.entity_type END AS to_type
  FROM {source} f JOIN entities a ON a.entity_id = f.from_id
  LEFT JOIN entities b ON b.entity_id = f.to_id)"""
FACT_COLUMNS = "edge_id from_name to_name edge_label fact_type fact confidence op_area".split()
BRIEF = (
    "edge_id, from_name, to_name, edge_label, fact_type, fact, confidence, op_area, "
    f"strftime(source_at, {SEC}) AS source_at, CAST(valid_until AS VARCHAR) AS valid_until"
)


def brief(df):
    return df.select(*FACT_COLUMNS, "source_at", "valid_until")


@query(
    "query_facts",
    "FLT2 JN3 TK1",
    f"""WITH {NAMED.format(source="facts")}
    SELECT {BRIEF} FROM named
    WHERE edge_label = 'ASSERTED' AND fact_type = 'commitment' AND op_area = 'intention'
      AND source_at >= TIMESTAMP '1995-01-01' AND source_at <= TIMESTAMP '1997-12-31'
    ORDER BY named.source_at DESC NULLS FIRST, edge_id LIMIT 50""",
)
def _query_facts(t: Tables):
    return brief(
        facts.query_facts(
            t.facts(),
            t.entities(),
            edge_label="ASSERTED",
            fact_type="commitment",
            op_area="intention",
            since="1995-01-01",
            until="1997-12-31",
        )
    )


@query(
    "query_facts_subject_day",
    "FLT2",
    f"""WITH {NAMED.format(source="facts")}
    SELECT {BRIEF} FROM named
    WHERE from_name = 'Customer#000000007' AND to_day IS NOT NULL AND source_type = 'order'
    ORDER BY named.source_at DESC NULLS FIRST, edge_id LIMIT 50""",
)
def _query_facts_subject(t: Tables):
    return brief(
        facts.query_facts(
            t.facts(),
            t.entities(),
            subject="Customer#000000007",
            target=facts.ANY_DAY,
            source_type="order",
        )
    )


@query(
    "query_facts_target_name",
    "FLT2",
    f"""WITH {NAMED.format(source="facts")}
    SELECT {BRIEF} FROM named
    WHERE to_name = 'red plate' ORDER BY named.source_at DESC NULLS FIRST, edge_id LIMIT 50""",
)
def _query_facts_target(t: Tables):
    return brief(facts.query_facts(t.facts(), t.entities(), target="red plate"))


@query(
    "query_facts_target_date",
    "FLT2",
    f"""WITH {NAMED.format(source="facts")}
    SELECT {BRIEF} FROM named WHERE to_day = DATE '1997-05-28'
    ORDER BY named.source_at DESC NULLS FIRST, edge_id LIMIT 50""",
)
def _query_facts_date(t: Tables):
    return brief(facts.query_facts(t.facts(), t.entities(), target="1997-05-28"))


@query(
    "query_facts_with_aliases",
    "FLT2",
    """SELECT fact, from_name, edge_label, confidence FROM (
      SELECT a.surface_form || ' identified as this entity' AS fact, e.name AS from_name,
             'IDENTIFIED_AS' AS edge_label, a.confidence
      FROM aliases a JOIN entities e USING (entity_id) WHERE e.name = 'red plate'
      UNION ALL
      SELECT f.fact, e.name, f.edge_label, f.confidence
      FROM facts f JOIN entities e ON e.entity_id = f.from_id WHERE e.name = 'red plate')""",
)
def _query_facts_aliases(t: Tables):
    found = facts.query_facts(
        t.facts(), t.entities(), subject="red plate", aliases=t.aliases(), limit=None
    )
    return found.select("fact", "from_name", "edge_label", "confidence")


@query(
    "facts_for_entity",
    "FLT3 FLT4 ST4",
    f"""SELECT f.edge_id, f.edge_label, f.fact_type, f.fact,
      strftime(f.source_at, {SEC}) AS source_at,
      coalesce(o.name, CAST(f.other_day AS VARCHAR), '?') AS other_name
    FROM (
      SELECT *, to_id AS other_id, to_day AS other_day FROM facts WHERE from_id = 'nation:5'
      UNION ALL
      SELECT *, from_id, NULL FROM facts WHERE to_id = 'nation:5' AND from_id <> 'nation:5') f
    LEFT JOIN entities o ON o.entity_id = f.other_id""",
)
def _facts_for_entity(t: Tables):
    found = facts.facts_for_entity(t.facts(), t.entities(), "nation:5")
    return found.select("edge_id", "edge_label", "fact_type", "fact", "source_at", "other_name")


@query(
    "facts_for_entity_filtered",
    "FLT3",
    f"""SELECT edge_id, fact, strftime(source_at, {SEC}) AS source_at,
      CAST(to_day AS VARCHAR) AS other_name
    FROM facts WHERE from_id = 'person:7' AND edge_label = 'ASSERTED'
      AND fact_type = 'commitment' AND source_at >= TIMESTAMP '1996-01-01'""",
)
def _facts_for_entity_filtered(t: Tables):
    found = facts.facts_for_entity(
        t.facts(),
        t.entities(),
        "person:7",
        edge_label="ASSERTED",
        fact_type="commitment",
        since="1996-01-01",
    )
    return found.select("edge_id", "fact", "source_at", "other_name")


@query(
    "facts_for_day",
    "FLT5",
    """SELECT f.edge_id, f.edge_label, f.fact_type, f.fact, e.name AS entity_name, e.entity_type
    FROM facts f JOIN entities e ON e.entity_id = f.from_id
    WHERE f.to_day = DATE '1997-05-28'""",
)
def _facts_for_day(t: Tables):
    found = facts.facts_for_day(t.facts(), t.entities(), "1997-05-28")
    return found.select("edge_id", "edge_label", "fact_type", "fact", "entity_name", "entity_type")


@query(
    "facts_by_source",
    "FLT6",
    f"""WITH {NAMED.format(source="facts")}
    SELECT edge_id, edge_label, fact, from_name, from_type, to_name, to_type, stale
    FROM named WHERE source_record = 'order_33'""",
)
def _facts_by_source(t: Tables):
    found = facts.facts_by_source(t.facts(), t.entities(), "order_33")
    return found.select(
        "edge_id", "edge_label", "fact", "from_name", "from_type", "to_name", "to_type", "stale"
    )


@query(
    "facts_by_any_source",
    "FLT7",
    f"""WITH {NAMED.format(source="facts")}
    SELECT edge_id, fact, from_name, to_name, source_record FROM named
    WHERE edge_id IN (SELECT edge_id FROM fact_sources WHERE record_id = 'order_33')""",
)
def _facts_by_any_source(t: Tables):
    found = facts.facts_by_any_source(t.facts(), t.fact_sources(), t.entities(), "order_33")
    return found.select("edge_id", "fact", "from_name", "to_name", "source_record")


@query(
    "facts_for_slot",
    "FLT8",
    """SELECT edge_id, fact, confidence, source_record FROM facts
    WHERE from_id = 'company:3' AND edge_label = 'AFFILIATED' AND fact_type = 'subsidiary'
      AND to_id = (SELECT 'nation:' || s_nationkey FROM supplier WHERE s_suppkey = 3)""",
)
def _facts_for_slot(t: Tables):
    nation = t.raw("supplier").filter("s_suppkey = 3").first().s_nationkey
    found = facts.facts_for_slot(
        t.facts(), "company:3", "affiliated", "subsidiary", f"nation:{nation}"
    )
    return found.select("edge_id", "fact", "confidence", "source_record")


@query(
    "existing_fact",
    "FLT8",
    """SELECT edge_id, fact FROM facts
    WHERE from_id = 'person:7' AND edge_label = 'ASSERTED' AND fact_type = 'commitment'
      AND to_day = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = 7)
    ORDER BY edge_id LIMIT 1""",
)
def _existing_fact(t: Tables):
    day = t.raw("orders").filter("o_custkey = 7").agg(F.max(F.to_date("o_orderdate"))).first()[0]
    found = facts.existing_fact(t.facts(), "person:7", "ASSERTED", "commitment", f"day:{day}")
    return found.select("edge_id", "fact")


@query(
    "expired_commitments",
    "FLT9",
    f"""WITH {NAMED.format(source="facts")}
    SELECT edge_id, fact, CAST(valid_until AS VARCHAR) AS valid_until, source_record,
      from_name, to_name
    FROM named WHERE edge_label = 'ASSERTED' AND fact_type IN ('commitment', 'promise')
      AND valid_until < DATE '1998-01-01'""",
)
def _expired(t: Tables):
    found = facts.expired_commitments(t.facts(), t.entities(), "1998-01-01")
    return found.select("edge_id", "fact", "valid_until", "source_record", "from_name", "to_name")


@query(
    "inferred_multi_source",
    "FLT10",
    """SELECT edge_id, fact, n_sources, has_stated FROM facts JOIN (
      SELECT edge_id, count(*) AS n_sources, bool_or(confidence = 'stated') AS has_stated
      FROM fact_sources GROUP BY edge_id) s USING (edge_id)
    WHERE confidence = 'inferred' AND n_sources > 1""",
)
def _inferred(t: Tables):
    found = facts.inferred_multi_source(t.facts(), t.fact_sources())
    return found.select("edge_id", "fact", "n_sources", "has_stated")


@query(
    "facts_as_of",
    "JN14",
    f"""SELECT edge_id, from_id, edge_label, fact_type, fact,
      strftime(source_at, {SEC}) AS source_at
    FROM (SELECT *, row_number() OVER (
        PARTITION BY from_id, edge_label, fact_type,
          CASE WHEN edge_label = 'TRANSITIONED' THEN edge_id
               ELSE coalesce(to_id, CAST(to_day AS VARCHAR)) END
        ORDER BY source_at DESC, edge_id DESC) AS rn
      FROM facts WHERE recorded_at <= TIMESTAMP '1998-06-30'
        AND source_at <= TIMESTAMP '1998-01-31') WHERE rn = 1""",
)
def _as_of(t: Tables):
    found = facts.as_of(t.facts(), "1998-06-30", "1998-01-31")
    return found.select("edge_id", "from_id", "edge_label", "fact_type", "fact", "source_at")


@query(
    "search_entities",
    "FLT11",
    """SELECT entity_id, name, entity_type FROM entities
    WHERE contains(lower(name), '00001') OR contains(lower(coalesce(email, '')), '00001')
       OR contains(lower(coalesce(domain, '')), '00001')
    ORDER BY CASE WHEN lower(name) = '00001' THEN 0 WHEN starts_with(lower(name), '00001') THEN 1
             ELSE 2 END, length(name), entity_id LIMIT 10""",
)
def _search(t: Tables):
    found = facts.search_entities(t.entities(), "00001", limit=10)
    return found.select("entity_id", "name", "entity_type")


@query(
    "search_entities_typed",
    "FLT11",
    """SELECT entity_id, name FROM entities
    WHERE entity_type = 'project' AND contains(lower(name), 'hot r')
    ORDER BY CASE WHEN lower(name) = 'hot r' THEN 0 WHEN starts_with(lower(name), 'hot r') THEN 1
             ELSE 2 END, length(name), entity_id LIMIT 5""",
)
def _search_typed(t: Tables):
    found = facts.search_entities(t.entities(), "Hot R", entity_type="project", limit=5)
    return found.select("entity_id", "name")


@query(
    "find_by_alias",
    "FLT13",
    """SELECT a.entity_id, a.surface_form, e.name FROM aliases a JOIN entities e USING (entity_id)
    WHERE contains(lower(a.surface_form || ' identified as this entity'), 'cust 39')
       OR lower(a.surface_form) = 'cust 39'""",
)
def _find_by_alias(t: Tables):
    found = facts.find_by_alias(t.aliases(), t.entities(), "CUST 39")
    return found.select("entity_id", "surface_form", "name")


@query(
    "check_alias",
    "FLT13",
    """SELECT e.entity_id, e.name FROM aliases a JOIN entities e USING (entity_id)
    WHERE e.entity_type = 'person' AND lower(a.surface_form) = 'cust 39'
    ORDER BY e.entity_id LIMIT 1""",
)
def _check_alias(t: Tables):
    return facts.check_alias(t.aliases(), t.entities(), "person", "cust 39").select(
        "entity_id", "name"
    )


@query(
    "entity_lookup",
    "FLT14",
    f"""SELECT entity_id, entity_type, name, email, domain,
      strftime(created_at, {SEC}) AS created_at FROM entities WHERE entity_id = 'company:3'""",
)
def _entity(t: Tables):
    return facts.entity_by_id(t.entities(), "company:3").drop("metadata")


@query(
    "graph_facts",
    "FLT24 ST4",
    f"""WITH {NAMED.format(source="facts")}
    SELECT edge_id, edge_label, fact_type, from_name AS from_entity,
      CASE WHEN to_day IS NULL THEN to_name END AS to_entity, fact, confidence,
      CAST(valid_until AS VARCHAR) AS valid_until, source_record FROM named""",
)
def _graph_facts(t: Tables):
    return facts.graph_facts(t.facts(), t.entities())


@query(
    "graph_entities",
    "FLT24",
    """SELECT e.entity_id, e.entity_type, e.name,
      CASE WHEN lower(a.surface_form) <> lower(e.name) THEN a.surface_form END AS alias
    FROM entities e LEFT JOIN aliases a USING (entity_id)""",
)
def _graph_entities(t: Tables):
    return facts.graph_entities(t.entities(), t.aliases())


@query(
    "schema_vocabulary",
    "FLT21 SRC16",
    """SELECT 'source_type' AS kind, CAST(NULL AS VARCHAR) AS label, type AS name
      FROM (SELECT DISTINCT type FROM records)
    UNION ALL SELECT 'op_area', NULL, unnest(['reality', 'intention'])
    UNION ALL SELECT 'entity_type', NULL, unnest(['person', 'company', 'project', 'event'])
    UNION ALL SELECT 'edge_label', NULL, unnest(['AFFILIATED', 'ASSERTED', 'TRANSITIONED'])
    UNION ALL SELECT 'fact_type', 'AFFILIATED', unnest(['employee', 'contractor', 'advisor',
      'board_member', 'founder', 'investor', 'legal_counsel', 'consultant', 'owner',
      'contributor', 'reviewer', 'stakeholder', 'subsidiary', 'sub_project', 'other'])
    UNION ALL SELECT 'fact_type', 'ASSERTED', unnest(['commitment', 'promise', 'decision',
      'evaluation', 'opinion', 'concern', 'blocker', 'request', 'update', 'risk', 'goal',
      'reference', 'other'])
    UNION ALL SELECT 'fact_type', 'TRANSITIONED', unnest(['status_change', 'stage_change',
      'role_change', 'ownership_change', 'resolution', 'completion', 'cancellation', 'other'])
    UNION ALL SELECT DISTINCT 'fact_type', 'ASSERTED', 'priority_'
      || lower(split_part(o_orderpriority, '-', 1)) FROM orders""",
)
def _vocabulary(t: Tables):
    kinds = F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)))
    added = F.concat(F.lit("priority_"), kinds).alias("fact_type")
    good = t.raw("orders").select(F.lit("ASSERTED").alias("edge_label"), added)
    unknown = t.raw("nation").select(
        F.lit("CLAIMED").alias("edge_label"), F.col("n_name").alias("fact_type")
    )
    known = t.raw("region").select(
        F.lit("AFFILIATED").alias("edge_label"), F.lit("owner").alias("fact_type")
    )
    additions = good.unionByName(unknown).unionByName(known)
    return facts.schema_vocabulary(vocabulary(t.spark, additions), t.records())


@query(
    "graph_stats",
    "AG1",
    """SELECT 'edge_label' AS measure, edge_label AS name, count(*) AS total, count(*) AS current
      FROM facts GROUP BY edge_label
    UNION ALL SELECT 'fact_type', fact_type, count(*), count(*) FROM facts GROUP BY fact_type
    UNION ALL SELECT 'facts', '', count(*), count(*) FROM facts
    UNION ALL SELECT 'days', '', count(DISTINCT to_day), count(DISTINCT to_day) FROM facts
    UNION ALL SELECT 'entity_type', entity_type, count(*), count(*) FROM entities
      GROUP BY entity_type
    UNION ALL SELECT 'entities', '', count(*), count(*) FROM entities""",
)
def _graph_stats(t: Tables):
    return facts.graph_stats(t.facts(), t.entities())


@query(
    "facts_by_label",
    "AG4",
    """SELECT entity_id, edge_label, edge_id, other_id,
      count(*) OVER (PARTITION BY entity_id, edge_label) AS cluster_size
    FROM (SELECT from_id AS entity_id, edge_label, edge_id, to_id AS other_id FROM facts
          UNION ALL SELECT to_id, edge_label, edge_id, from_id FROM facts
          WHERE to_id IS NOT NULL AND to_id <> from_id)""",
)
def _facts_by_label(t: Tables):
    seen = facts.facts_for_entities(t.facts(), t.entities(), t.entities())
    return facts.facts_by_label(seen).select(
        "entity_id", "edge_label", "edge_id", "other_id", "cluster_size"
    )


@query(
    "chronological_facts",
    "TK2",
    f"""SELECT edge_id, fact, strftime(source_at, {SEC}) AS source_at FROM facts
    WHERE from_id = 'company:3' OR to_id = 'company:3'""",
)
def _chronological(t: Tables):
    seen = facts.facts_for_entity(t.facts(), t.entities(), "company:3")
    return facts.chronological(seen).select("edge_id", "fact", "source_at")


BOTH_WAYS = """both_ways AS (
  SELECT from_id AS entity_id, to_id AS other_id, edge_id, edge_label, fact, source_at FROM facts
  UNION ALL SELECT to_id, from_id, edge_id, edge_label, fact, source_at FROM facts
  WHERE to_id IS NOT NULL AND to_id <> from_id)"""


@query(
    "top_facts_per_entity",
    "WN8",
    f"""WITH {BOTH_WAYS} SELECT entity_id, edge_id, fact FROM (
      SELECT *, row_number() OVER (PARTITION BY entity_id
        ORDER BY source_at DESC NULLS FIRST, edge_id) AS rn FROM both_ways) WHERE rn <= 3""",
)
def _top_facts(t: Tables):
    return facts.top_facts_per_entity(t.facts(), 3).select("entity_id", "edge_id", "fact")


@query(
    "top_connections_per_entity",
    "WN8",
    f"""WITH {BOTH_WAYS} SELECT entity_id, connection, connection_type FROM (
      SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY connection) AS rn FROM (
        SELECT p.entity_id, e.name AS connection,
               arg_min(e.entity_type, e.entity_id) AS connection_type
        FROM (SELECT DISTINCT entity_id, other_id FROM both_ways
              WHERE other_id IS NOT NULL AND other_id <> entity_id) p
        JOIN entities e ON e.entity_id = p.other_id GROUP BY ALL)) WHERE rn <= 3""",
)
def _top_connections(t: Tables):
    return facts.top_connections_per_entity(t.facts(), t.entities(), 3)


# -- curation ---------------------------------------------------------------------------------


@query(
    "expire",
    "CU1",
    """SELECT fact_type, stale, count(*) AS n FROM (
      SELECT fact_type, coalesce(edge_label = 'ASSERTED' AND fact_type IN ('commitment', 'promise')
        AND valid_until < DATE '1998-01-01', FALSE) AS stale FROM facts) GROUP BY ALL""",
)
def _expire(t: Tables):
    done = curate.expire(t.facts(), "1998-01-01")
    return done.groupBy("fact_type", "stale").agg(F.count(F.lit(1)).alias("n"))


@query(
    "upgrade_confidence",
    "CU2",
    """SELECT f.edge_id, CASE WHEN f.confidence = 'inferred' AND s.n > 1 AND s.st THEN 'stated'
        ELSE f.confidence END AS confidence
    FROM facts f LEFT JOIN (SELECT edge_id, count(*) AS n, bool_or(confidence = 'stated') AS st
      FROM fact_sources GROUP BY edge_id) s USING (edge_id)""",
)
def _upgrade(t: Tables):
    return curate.upgrade_confidence(t.facts(), t.fact_sources()).select("edge_id", "confidence")


SUPERSEDED = """superseded AS (
  SELECT f.edge_id, (SELECT min(g.edge_id) FROM slots g
      WHERE g.slot = f.slot AND g.source_at = f.next_at) AS replaced_by
  FROM (SELECT *, (SELECT min(h.source_at) FROM slots h
          WHERE h.slot = s.slot AND h.source_at > s.source_at) AS next_at FROM slots s) f
  WHERE f.next_at IS NOT NULL)"""
SLOTS = """slots AS (
  SELECT edge_id, source_at, from_id || '|' || edge_label || '|' || fact_type || '|'
    || coalesce(to_id, CAST(to_day AS VARCHAR)) AS slot
  FROM {source} WHERE edge_label IN ('AFFILIATED', 'ASSERTED'))"""


@query(
    "supersede",
    "WN1",
    f"""WITH {SLOTS.format(source="facts")}, {SUPERSEDED}
    SELECT f.edge_id, s.edge_id IS NOT NULL AS stale, s.replaced_by
    FROM facts f LEFT JOIN superseded s USING (edge_id)""",
)
def _supersede(t: Tables):
    return curate.supersede(t.facts()).select("edge_id", "stale", "replaced_by")


@query(
    "curate",
    "CU3",
    f"""WITH live AS (SELECT * FROM facts WHERE NOT coalesce(edge_label = 'ASSERTED'
        AND fact_type = 'commitment' AND valid_until < DATE '1998-01-01', FALSE)),
      {SLOTS.format(source="live")}, {SUPERSEDED}
    SELECT f.edge_label, f.edge_id NOT IN (SELECT edge_id FROM live) OR s.edge_id IS NOT NULL
        AS stale,
      CASE WHEN f.confidence = 'inferred' AND f.edge_id IN (SELECT edge_id FROM live)
        AND c.n > 1 AND c.st THEN 'stated' ELSE f.confidence END AS confidence,
      count(*) AS n, count(s.replaced_by) AS n_replaced
    FROM facts f LEFT JOIN superseded s USING (edge_id) LEFT JOIN (
      SELECT edge_id, count(*) AS n, bool_or(confidence = 'stated') AS st
      FROM fact_sources GROUP BY edge_id) c USING (edge_id) GROUP BY ALL""",
)
def _curate(t: Tables):
    done = curate.curate(t.facts(), t.fact_sources(), "1998-01-01", with_supersession=True)
    return done.groupBy("edge_label", "stale", "confidence").agg(
        F.count(F.lit(1)).alias("n"), F.count("replaced_by").alias("n_replaced")
    )


@query(
    "transition_chain",
    "WN2",
    f"""WITH steps AS (SELECT * FROM facts WHERE edge_label = 'TRANSITIONED'),
      back AS (SELECT s.*, (SELECT max(p.source_at) FROM steps p
        WHERE p.from_id = s.from_id AND p.source_at < s.source_at) AS prev_at FROM steps s)
    SELECT b.from_id, b.edge_id, strftime(b.source_at, {SEC}) AS source_at,
      (SELECT min(p.edge_id) FROM steps p WHERE p.from_id = b.from_id
        AND p.source_at = b.prev_at) AS previous_edge
    FROM back b""",
)
def _chain(t: Tables):
    return curate.transition_chain(t.facts()).select(
        "from_id", "edge_id", "source_at", "previous_edge"
    )


@query(
    "conflict_groups",
    "JN4 TR3",
    """SELECT from_id, fact_type, to_id AS to_node, count(*) AS n_edges,
      count(*) * (count(*) - 1) // 2 AS n_pairs, min(edge_id) AS first_edge
    FROM facts WHERE edge_label = 'AFFILIATED' GROUP BY ALL HAVING count(*) > 1""",
)
def _conflict_groups(t: Tables):
    return curate.conflict_groups(t.facts()).select(
        "from_id", "fact_type", "to_node", "n_edges", "n_pairs", "first_edge"
    )


@query(
    "conflicts",
    "JN4 TR3",
    f"""SELECT e.name AS entity_name, f.fact_type, f.edge_id, f.fact,
      strftime(f.source_at, {SEC}) AS source_at, g.n_edges, g.first_edge
    FROM facts f JOIN (SELECT from_id, fact_type, to_id, count(*) AS n_edges,
        min(edge_id) AS first_edge FROM facts WHERE edge_label = 'AFFILIATED'
        GROUP BY ALL HAVING count(*) > 1) g USING (from_id, fact_type, to_id)
    JOIN entities e ON e.entity_id = f.from_id WHERE f.edge_label = 'AFFILIATED'""",
)
def _conflicts(t: Tables):
    return curate.conflicts(t.facts(), t.entities()).select(
        "entity_name", "fact_type", "edge_id", "fact", "source_at", "n_edges", "first_edge"
    )


@query(
    "conflicts_by_entity",
    "TR3",
    """SELECT from_id, fact_type, count(*) AS n_edges, count(*) * (count(*) - 1) // 2 AS n_pairs
    FROM facts WHERE edge_label = 'AFFILIATED' GROUP BY ALL HAVING count(*) > 1""",
)
def _conflicts_entity(t: Tables):
    return curate.conflict_groups(t.facts(), scope="entity").select(
        "from_id", "fact_type", "n_edges", "n_pairs"
    )


@query(
    "conflicts_with",
    "JN4 TR3",
    """WITH hot AS (SELECT min(edge_id) AS edge_id FROM (
        SELECT from_id, to_id, min(edge_id) AS edge_id FROM facts
        WHERE edge_label = 'AFFILIATED' GROUP BY ALL HAVING count(*) > 1))
    SELECT least(a.edge_id, b.edge_id) AS edge_id_a, greatest(a.edge_id, b.edge_id) AS edge_id_b
    FROM facts a JOIN facts b ON a.from_id = b.from_id AND a.to_id = b.to_id
      AND a.fact_type = b.fact_type AND a.edge_label = b.edge_label
    WHERE a.edge_label = 'AFFILIATED' AND a.edge_id = (SELECT edge_id FROM hot)
      AND b.edge_id <> a.edge_id""",
)
def _conflicts_with(t: Tables):
    f = t.facts()
    first = curate.conflict_groups(f).agg(F.min("first_edge")).first()[0]
    return curate.conflicts_with(f, first).select("edge_id_a", "edge_id_b")
