"""Extraction, validation, resolution, traversal and bundled queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import normalised_company
from factloom.operators.bearers import bearers
from factloom.operators import build, resolve, traverse, validate
from factloom.operators import facts as fq
from factloom.operators.grouped import apart
from factloom.plans import bundles
from factloom.plans.catalog import query
from factloom.plans.queries_facts import BOTH_WAYS
from factloom.schema import vocabulary
from factloom.session import durable
from factloom.sources.tables import Tables

SEC = "'%Y-%m-%d %H:%M:%S'"


def _recorded():
    return F.lit("2024-06-01").cast("timestamp")


def _with_ids(t: Tables):
    return build.with_entity_ids(t.extractions())


# -- commit -----------------------------------------------------------------------------------

MENTION_TIME = (
    "CASE WHEN even THEN TIMESTAMP '1997-03-01 02:00:00' ELSE TIMESTAMP '1998-01-01 12:00:00' END"
)


@query(
    "commit_entities",
    "GB1 AG8",
    f"""SELECT type AS entity_type, name, domain, strftime(min(ts), {SEC}) AS created_at,
      count(*) AS n FROM (SELECT e.*, {MENTION_TIME} AS ts FROM ex_entities e
        WHERE e.resolved_to = 'new')
    GROUP BY type, name, domain""",
)
def _commit_entities(t: Tables):
    mentions = build.new_mentions(_with_ids(t))
    merged = build.merge_entities(mentions)
    counts = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return merged.join(counts, "entity_id").select(
        "entity_type", "name", "domain", "created_at", "n"
    )


@query(
    "entity_bearers",
    "AG8 GB1",
    """WITH known AS (SELECT 'person:' || c_custkey AS entity_id, 'P' || (c_custkey % 1000) AS name,
        CASE WHEN c_custkey % 3 > 0 THEN 'p' || c_custkey || '@n.example' END AS email FROM customer),
      named AS (SELECT min(entity_id) AS entity_id, name, email FROM known GROUP BY name, email),
      nick AS (SELECT DISTINCT 'person:' || o_custkey AS entity_id, 'P' || (o_orderkey % 1000) AS form FROM orders
        WHERE o_orderstatus = 'P' AND o_custkey % 3 > 0),
      candidates AS (SELECT name, count(DISTINCT entity_id) AS n, min(entity_id) AS one FROM (
        SELECT name, entity_id FROM named WHERE email IS NOT NULL
        UNION ALL SELECT form, entity_id FROM nick) GROUP BY name)
    SELECT m.entity_id, CASE WHEN m.email IS NULL AND c.n = 1 THEN c.one ELSE m.entity_id END AS canonical_id,
      CASE WHEN m.email IS NOT NULL OR c.n IS NULL THEN 'own' WHEN c.n = 1 THEN 'joined' ELSE 'ambiguous' END AS outcome,
      CASE WHEN m.email IS NULL THEN coalesce(c.n, 0) ELSE 0 END AS candidates
    FROM named m LEFT JOIN candidates c USING (name)""",
)
def _entity_bearers(t: Tables):
    """Customers under a thousand names, a third without an email; parts of orders tell aliases."""
    c, o, none = t.raw("customer"), t.raw("orders"), F.lit(None).cast("string")
    person = F.concat(F.lit("person:"), "c_custkey")
    email = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("p"), "c_custkey", F.lit("@n.example")))
    known = c.select(person.alias("entity_id"), F.concat(F.lit("P"), F.col("c_custkey") % 1000).alias("name"), email.alias("email"))
    named = known.groupBy("name", "email").agg(F.min("entity_id").alias("entity_id"))
    entities = named.select("entity_id", F.lit("person").alias("entity_type"), "name", "email", none.alias("domain"))
    told = o.filter("o_orderstatus = 'P' AND o_custkey % 3 > 0").select(
        F.concat(F.lit("person:"), "o_custkey").alias("entity_id"),
        F.concat(F.lit("P"), F.col("o_orderkey") % 1000).alias("surface_form"),
    )
    return bearers(entities, told.distinct())


@query(
    "entity_properties",
    "AG8",
    """SELECT 'project' AS entity_type, name, NULL AS domain,
      arg_max(line, ts || lpad(CAST(line AS VARCHAR), 3, '0')) AS line FROM (
      SELECT p_name AS name, l_linenumber AS line, '1998' AS ts FROM ex_base
      WHERE NOT even AND mark <> 7) GROUP BY name
    UNION ALL SELECT DISTINCT 'company', s_name, 'n' || s_nationkey || '.example', NULL FROM ex_base""",
)
def _entity_properties(t: Tables):
    merged = build.merge_entities(build.new_mentions(_with_ids(t)))
    line = F.col("metadata")["line"].cast("long").alias("line")
    return merged.select("entity_type", "name", "domain", line)


@query(
    "merge_aliases",
    "GB1 AG7",
    f"""SELECT resolved_to AS entity_id, name AS surface_form, 'inferred' AS confidence,
      'Extractor agent resolved ''' || name || ''' to ''' || min(canonical_name) || ''''
        AS reasoning, strftime(max(ts), {SEC}) AS resolved_at, count(DISTINCT record_id) AS n_sources
    FROM (SELECT e.*, {MENTION_TIME} AS ts FROM ex_entities e
      WHERE e.resolved_to <> 'new' AND lower(e.name) <> lower(e.canonical_name))
    GROUP BY resolved_to, name""",
)
def _merge_aliases(t: Tables):
    rows = build.alias_rows(_with_ids(t))
    known = build.alias_sources(rows)
    n = known.groupBy("entity_id", "surface_form").agg(F.count(F.lit(1)).alias("n_sources"))
    # Projects that share a name give several canonical spellings only if their names differ.
    return (
        build.merge_aliases(rows)
        .join(n, ["entity_id", "surface_form"])
        .select("entity_id", "surface_form", "confidence", "reasoning", "resolved_at", "n_sources")
    )


COMMITTED = """committed AS (
  SELECT f.*, CASE WHEN f.from_entity = 'Somebody' THEN NULL ELSE 'c' || b.s_name END AS from_key,
    CASE WHEN f.to_entity IS NULL OR f.to_entity = 'Nobody' THEN NULL
         WHEN b.mark = 7 THEN 'project:-1'
         WHEN b.even THEN 'project:' || b.l_partkey ELSE 'new ' || b.p_name END AS to_key,
    CASE WHEN b.even THEN DATE '1997-02-28' ELSE DATE '1998-01-01' END AS local_day,
    CASE WHEN b.mark < 25 THEN 'intention' ELSE 'reality' END AS op_area
  FROM ex_facts f JOIN ex_base b USING (record_id))"""


COMMIT_ROWS = """SELECT source_record, edge_label, fact_type, fact, confidence, op_area,
      to_day, from_name, to_ref FROM (
      SELECT record_id AS source_record, edge_label, fact_type, fact, min(confidence) AS confidence,
        min(op_area) AS op_area, CASE WHEN to_key IS NULL THEN CAST(local_day AS VARCHAR) END
          AS to_day, min(from_entity) AS from_name,
        CASE WHEN to_key LIKE 'new %' THEN substr(to_key, 5) ELSE to_key END AS to_ref
      FROM committed WHERE from_key IS NOT NULL
      GROUP BY record_id, edge_label, fact_type, fact, to_key, local_day)"""


def _with_ends(made: build.Commit):
    """Facts with the names of their ends, found through the ids; a resolved object shows as its id."""
    named = made.entities.select("entity_id", "name")
    near = named.withColumnsRenamed({"entity_id": "from_id", "name": "from_name"})
    far = named.withColumnsRenamed({"entity_id": "_far", "name": "to_name"})
    # facts about days have no target: they are dealt out by their subject, and do not meet in one task
    nobody = F.concat(F.lit("none of "), F.coalesce("from_name", F.lit("")))
    rows = made.facts.join(near, "from_id").withColumn("_to", F.coalesce("to_id", nobody))
    rows = rows.join(far, (F.col("_to") == F.col("_far")) & F.col("to_id").isNotNull(), "left")
    return rows.select(
        "source_record",
        "edge_label",
        "fact_type",
        "fact",
        "confidence",
        "op_area",
        "to_day",
        "from_name",
        F.coalesce("to_name", "to_id").alias("to_ref"),
    )


@query(
    "commit_facts",
    "GB3 GB4 GB5",
    f"WITH {COMMITTED} {COMMIT_ROWS}",
)
def _commit_facts(t: Tables):
    return _with_ends(build.commit(t.extractions(), _recorded()))


@query("commit_incremental", "AG6 AG7 AG8 DD2 GB3", f"WITH {COMMITTED} {COMMIT_ROWS}")
def _commit_incremental(t: Tables):
    """The later half of the lines on top of the committed earlier half."""
    first = F.pmod(F.xxhash64("record_id"), F.lit(2)) == 0
    before = build.commit(t.extractions().filter(first), _recorded(), keep_records=True)
    return _with_ends(build.commit(t.extractions().filter(~first), _recorded(), stored=before))


@query(
    "dedup_facts_merge",
    "DD2 AG6",
    f"""WITH {COMMITTED} SELECT edge_label, fact_type, fact, count(DISTINCT record_id) AS n_sources
    FROM committed WHERE from_key IS NOT NULL
    GROUP BY edge_label, fact_type, fact, from_key,
      coalesce(to_key, CAST(local_day AS VARCHAR))""",
)
def _dedup_merge(t: Tables):
    rows = build.commit_facts(_with_ids(t), _recorded(), mode="merge").select(
        "edge_id", "edge_label", "fact_type", "fact", "confidence", "source_record", "source_at", "position"
    )

    def merged(claims):
        sources = build.merge_sources(claims).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n_sources"))
        facts = build.dedup_facts(claims)
        return facts.join(sources, "edge_id").select("edge_label", "fact_type", "fact", "n_sources")

    return reduce(DataFrame.unionByName, [merged(part) for part in apart(rows, "edge_id")])


@query(
    "local_day",
    "GB5",
    """SELECT CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE)
        AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1""",
)
def _local_day(t: Tables):
    from factloom.functions.columns import local_day

    days = t.raw("events").select(local_day("ts").alias("day"))
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def _seed_extractions(t: Tables):
    """Extracted seeds: each supplier block as one seed with an alias per supplier."""
    s = t.raw("supplier").withColumn("block", F.floor(F.col("s_suppkey") / 20))
    none = F.lit(None).cast("string")

    def entity(name, canonical, bag):
        return F.struct(
            name.alias("name"),
            F.lit("company").alias("type"),
            bag.alias("metadata"),
            F.lit("new").alias("resolved_to"),
            canonical.alias("canonical_name"),
        )

    domain = F.create_map(F.lit("domain"), F.concat(F.lit("n"), "s_nationkey", F.lit(".example")))
    empty = F.expr("cast(map() as map<string,string>)")
    own = entity(F.col("s_name"), F.col("s_name"), domain)
    alias = entity(F.concat(F.lit("Supp "), "s_suppkey"), F.col("s_name"), empty)
    fact = F.struct(
        F.lit("AFFILIATED").alias("edge_label"),
        F.lit("subsidiary").alias("fact_type"),
        F.concat("s_name", F.lit(" stands alone")).alias("fact"),
        F.concat(F.lit("Supp "), "s_suppkey").alias("from_entity"),
        none.alias("to_entity"),
        F.lit("stated").alias("confidence"),
        none.alias("valid_until"),
    )
    grouped = s.groupBy("block").agg(
        F.flatten(F.collect_list(F.array(own, alias))).alias("entities"),
        F.collect_list(fact).alias("facts"),
    )
    return grouped.select(
        F.concat(F.lit("ingest_"), "block").alias("record_id"),
        F.lit("ingest").alias("record_type"),
        empty.alias("metadata"),
        F.lit("1998-01-01 12:00:00").cast("timestamp").alias("created_at"),
        "entities",
        "facts",
    )


@query(
    "commit_seed",
    "GB2",
    """SELECT s_name AS name, 'Supp ' || s_suppkey AS surface_form, 'stated' AS confidence,
      s_name || ' stands alone' AS fact, '1998-01-01' AS to_day FROM supplier""",
)
def _commit_seed(t: Tables):
    made = build.commit(_seed_extractions(t), _recorded(), seed=True)
    facts = made.facts.select(F.col("from_id").alias("entity_id"), "fact", "to_day")
    return (
        made.entities.join(made.aliases, "entity_id")
        .join(facts, "entity_id")
        .select("name", "surface_form", "confidence", "fact", "to_day")
    )


# -- validation -------------------------------------------------------------------------------


@query(
    "unknown_resolutions",
    "VA1 JN7",
    """SELECT record_id, name, resolved_to AS entity_id FROM ex_entities
    WHERE resolved_to <> 'new' AND resolved_to NOT IN (SELECT entity_id FROM entities)""",
)
def _unknown(t: Tables):
    return validate.unknown_resolutions(t.extractions(), t.entities()).select(
        "record_id", "name", "entity_id"
    )


@query(
    "fact_errors",
    "VA2 JN8",
    """WITH checks AS (SELECT record_id, pos AS position, edge_label, from_entity, to_entity, fact,
        edge_label IN ('AFFILIATED', 'ASSERTED', 'TRANSITIONED') AS ok,
        CASE WHEN contains(lower(content), lower(fact)) THEN 1.0
          ELSE len(list_filter(list_distinct(string_split(lower(fact), ' ')),
                 lambda w: contains(lower(content), w)))
               / len(list_distinct(string_split(lower(fact), ' '))) END AS share FROM ex_facts)
    SELECT record_id, position, 'invalid_label' AS error, edge_label AS detail FROM checks
      WHERE NOT ok
    UNION ALL SELECT record_id, position, 'unknown_from', from_entity FROM checks
      WHERE ok AND from_entity = 'Somebody'
    UNION ALL SELECT record_id, position, 'unknown_to', to_entity FROM checks
      WHERE ok AND to_entity = 'Nobody'
    UNION ALL SELECT record_id, position, 'low_grounding', fact FROM checks
      WHERE ok AND share < 0.6""",
)
def _fact_errors(t: Tables):
    return validate.fact_errors(t.extractions())


@query(
    "grounding_score",
    "VA3",
    """SELECT share, count(*) AS n FROM (SELECT round(
        CASE WHEN contains(lower(content), lower(fact)) THEN 1.0
          ELSE len(list_filter(list_distinct(string_split(lower(fact), ' ')),
                 lambda w: contains(lower(content), w)))
               / len(list_distinct(string_split(lower(fact), ' '))) END, 6) AS share
      FROM ex_facts) GROUP BY share""",
)
def _grounding(t: Tables):
    scored = validate.checked_facts(t.extractions())
    return scored.groupBy(F.round("grounding", 6).alias("share")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "novel_fact_types",
    "VA2 JN9",
    """SELECT record_id, pos AS position, edge_label, fact_type FROM ex_facts
    WHERE edge_label <> 'CLAIMED' AND fact_type = 'pledge'""",
)
def _novel(t: Tables):
    return validate.novel_fact_types(t.extractions(), vocabulary(t.spark)).select(
        "record_id", "position", "edge_label", "fact_type"
    )


# -- resolution -------------------------------------------------------------------------------


def _mentions(t: Tables):
    c = t.raw("customer")
    k = F.col("c_custkey")
    email = F.concat(F.upper("c_name"), F.lit("@N"), "c_nationkey", F.lit(".EXAMPLE"))
    people = c.select(
        F.lit("person").alias("entity_type"),
        F.when(k % 5 == 0, "someone")
        .when(k % 5 == 1, F.upper("c_name"))
        .when(k % 5 == 2, F.concat(F.lit("cust "), k % 400))
        .when(k % 5 == 3, F.right("c_name", F.lit(6)))
        .otherwise(F.concat(F.lit("nobody "), k))
        .alias("name"),
        F.when(k % 5 == 0, email).alias("identifier"),
    )
    p = t.raw("part")
    none = F.lit(None).cast("string").alias("identifier")
    kind = F.lit("project").alias("entity_type")
    full = p.select(kind, F.col("p_name").alias("name"), none)
    short = p.select(kind, F.left("p_name", F.lit(5)).alias("name"), none)
    return people.unionByName(full).unionByName(short)


MENTIONS = """mentions AS (SELECT DISTINCT entity_type, name, identifier FROM (
    SELECT 'person' AS entity_type, CASE c_custkey % 5 WHEN 0 THEN 'someone'
        WHEN 1 THEN upper(c_name) WHEN 2 THEN 'cust ' || (c_custkey % 400)
        WHEN 3 THEN right(c_name, 6) ELSE 'nobody ' || c_custkey END AS name,
      CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) || '@N' || c_nationkey || '.EXAMPLE' END
        AS identifier FROM customer
    UNION ALL SELECT 'project', p_name, NULL FROM part
    UNION ALL SELECT 'project', left(p_name, 5), NULL FROM part))"""
RESOLVED = f"""{MENTIONS},
  by_id AS (SELECT m.*, min(e.entity_id) AS entity_id FROM mentions m JOIN entities e
    ON m.entity_type = e.entity_type AND lower(m.identifier) =
      CASE e.entity_type WHEN 'person' THEN e.email WHEN 'company' THEN e.domain END GROUP BY ALL),
  left1 AS (SELECT m.* FROM mentions m LEFT JOIN by_id b ON b.entity_type = m.entity_type
    AND b.name = m.name AND b.identifier IS NOT DISTINCT FROM m.identifier
    WHERE b.name IS NULL),
  exact AS (SELECT * FROM (
    SELECT m.*, e.entity_id, row_number() OVER (PARTITION BY m.entity_type, m.name, m.identifier
      ORDER BY e.entity_id) AS rn, count(*) OVER (PARTITION BY m.entity_type, m.name, m.identifier) AS hits
    FROM left1 m JOIN entities e ON e.entity_type = m.entity_type
      AND lower(e.name) = lower(m.name)) WHERE rn <= 5),
  left2 AS (SELECT m.* FROM left1 m LEFT JOIN (SELECT DISTINCT entity_type, name FROM exact) b
    USING (entity_type, name) WHERE b.name IS NULL),
  al AS (SELECT * FROM (
    SELECT m.*, e.entity_id, row_number() OVER (PARTITION BY m.entity_type, m.name, m.identifier
      ORDER BY e.entity_id) AS rn, count(*) OVER (PARTITION BY m.entity_type, m.name, m.identifier) AS hits
    FROM left2 m JOIN (SELECT DISTINCT e.entity_id, e.entity_type,
        lower(a.surface_form) AS sf FROM aliases a JOIN entities e USING (entity_id)) e
      ON e.entity_type = m.entity_type AND e.sf = lower(m.name)) WHERE rn <= 5),
  left3 AS (SELECT m.* FROM left2 m LEFT JOIN (SELECT DISTINCT entity_type, name FROM al) b
    USING (entity_type, name) WHERE b.name IS NULL),
  fuzzy AS (SELECT * FROM (SELECT m.*, e.entity_id, row_number() OVER (
      PARTITION BY m.entity_type, m.name, m.identifier ORDER BY
        CASE WHEN lower(e.name) = lower(m.name) THEN 0
             WHEN starts_with(lower(e.name), lower(m.name)) THEN 1 ELSE 2 END,
        length(e.name), e.entity_id) AS rn,
      count(*) OVER (PARTITION BY m.entity_type, m.name, m.identifier) AS hits
    FROM left3 m JOIN entities e ON e.entity_type = m.entity_type
      AND (contains(lower(e.name), lower(m.name))
        OR contains(lower(coalesce(e.email, '')), lower(m.name))
        OR contains(lower(coalesce(e.domain, '')), lower(m.name)))) WHERE rn <= 3),
  resolved AS (
    SELECT entity_type, name, identifier, 'definitive' AS match, 'identifier' AS via, entity_id,
      CAST(1 AS BIGINT) AS n_candidates FROM by_id
    UNION ALL SELECT entity_type, name, identifier,
      CASE WHEN hits = 1 THEN 'definitive' ELSE 'candidates' END,
      CASE WHEN hits = 1 THEN 'exact_name' ELSE 'exact_name_ambiguous' END, entity_id, hits FROM exact
    UNION ALL SELECT entity_type, name, identifier,
      CASE WHEN hits = 1 THEN 'definitive' ELSE 'candidates' END,
      CASE WHEN hits = 1 THEN 'alias' ELSE 'alias_ambiguous' END, entity_id, hits FROM al
    UNION ALL SELECT entity_type, name, identifier, 'candidates', 'fuzzy_name', entity_id, hits FROM fuzzy
    UNION ALL SELECT m.entity_type, m.name, m.identifier, 'none', NULL, NULL, 0 FROM left3 m
      LEFT JOIN (SELECT DISTINCT entity_type, name FROM fuzzy) b USING (entity_type, name)
      WHERE b.name IS NULL)"""


@query("resolve_entities", "RES1 JN13", f"WITH {RESOLVED} SELECT * FROM resolved")
def _resolve(t: Tables):
    return resolve.resolve_entities(_mentions(t), t.entities(), t.aliases())


@query(
    "resolve_near_names",
    "RES1",
    """WITH names AS (SELECT DISTINCT 'project' AS entity_type, lower(p_name) AS name FROM part),
      typed AS (SELECT DISTINCT 'project' AS entity_type, lower(left(p_name, 1) || substr(p_name, 3)) AS name
        FROM part WHERE length(p_name) > 6
        UNION SELECT 'project', 'zz ' || c_custkey FROM customer),
      open_ AS (SELECT t.* FROM typed t WHERE NOT EXISTS (SELECT 1 FROM names n WHERE contains(n.name, t.name))),
      grams AS (SELECT name, list_distinct(list_transform(range(1, length(name) + 2),
        lambda i: substr('  ' || name || ' ', i, 3))) AS g FROM (SELECT name FROM names UNION SELECT name FROM open_)),
      scored AS (SELECT o.name, n.name AS other, len(list_intersect(a.g, b.g)) AS both_in, len(a.g) + len(b.g) AS total
        FROM open_ o JOIN names n ON true JOIN grams a ON a.name = o.name JOIN grams b ON b.name = n.name),
      near AS (SELECT name, other, both_in / (total - both_in) AS similarity FROM scored
        WHERE both_in >= 0.6 * (total - both_in)),
      bearers AS (SELECT lower(p_name) AS other, 'project:' || p_partkey AS entity_id FROM part),
      ranked AS (SELECT n.name, b.entity_id, row_number() OVER (PARTITION BY n.name
          ORDER BY similarity DESC, n.other, b.entity_id) AS rn, count(*) OVER (PARTITION BY n.name) AS n_candidates
        FROM near n JOIN bearers b USING (other))
    SELECT name, 'near_name' AS via, entity_id, n_candidates FROM ranked WHERE rn <= 4
    UNION ALL SELECT name, NULL, NULL, 0 FROM open_ WHERE name NOT IN (SELECT name FROM ranked)""",
)
def _resolve_near(t: Tables):
    """Project names with a letter left out, and names that are like none."""
    kind = F.lit("project").alias("entity_type")
    name = F.lower(F.concat(F.left("p_name", F.lit(1)), F.substring("p_name", 3, 10_000)))
    none = F.lit(None).cast("string").alias("identifier")
    typed = t.raw("part").filter(F.length("p_name") > 6).select(kind, name.alias("name"), none)
    strange = t.raw("customer").select(kind, F.concat(F.lit("zz "), "c_custkey").alias("name"), none)
    pool, nobody = t.entities().filter("entity_type = 'project'"), t.aliases().limit(0)
    found = resolve.resolve_entities(typed.unionByName(strange), pool, nobody, max_fuzzy=4, near=0.6)
    return found.filter("via IS NULL OR via = 'near_name'").select("name", "via", "entity_id", "n_candidates")


CONTEXT = """told AS (SELECT entity_id, edge_label, fact, row_number() OVER (PARTITION BY entity_id
        ORDER BY source_at DESC NULLS FIRST, edge_id) AS rn FROM both_ways),
      linked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY connection) AS rn FROM (
        SELECT p.entity_id, e.name AS connection, arg_min(e.entity_type, e.entity_id) AS connection_type
        FROM (SELECT DISTINCT entity_id, other_id FROM both_ways
              WHERE other_id IS NOT NULL AND other_id <> entity_id) p
        JOIN entities e ON e.entity_id = p.other_id GROUP BY ALL))"""


@query(
    "resolve_with_context",
    "RES1 WN8",
    f"""WITH {RESOLVED}, {BOTH_WAYS}, {CONTEXT},
      context AS (SELECT entity_id, 'fact' AS context, '[' || edge_label || '] ' || fact AS text FROM told
        WHERE rn <= 3 UNION ALL SELECT entity_id, 'connection', connection || ' (' || connection_type || ')'
        FROM linked WHERE rn <= 3)
    SELECT r.name, r.identifier, r.via, r.entity_id, c.context, c.text FROM resolved r LEFT JOIN context c
      USING (entity_id)""",
)
def _resolve_context(t: Tables):
    found = durable(resolve.resolve_entities(_mentions(t), t.entities(), t.aliases()))
    told = resolve.with_brief_context(found, t.facts(), t.entities())
    return told.select("name", "identifier", "via", "entity_id", "context", "text")


@query(
    "find_entities",
    "FLT12 JN13",
    f"""WITH {MENTIONS} SELECT m.entity_type, m.name, m.identifier,
      coalesce(n.entity_id, i.entity_id) AS entity_id,
      CASE WHEN n.entity_id IS NOT NULL THEN 'name' WHEN i.entity_id IS NOT NULL THEN 'identifier'
        END AS via
    FROM mentions m
    LEFT JOIN (SELECT entity_type, lower(name) AS low, min(entity_id) AS entity_id FROM entities
      GROUP BY 1, 2) n ON n.entity_type = m.entity_type AND n.low = lower(m.name)
    LEFT JOIN (SELECT entity_type, email, min(entity_id) AS entity_id FROM entities
      WHERE entity_type = 'person' GROUP BY 1, 2) i ON i.entity_type = m.entity_type
      AND i.email = lower(m.identifier)""",
)
def _find_entities(t: Tables):
    return resolve.find_entities(_mentions(t), t.entities())


@query(
    "normalised_names",
    "RES2",
    """SELECT s_suppkey AS id, 'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS name
    FROM supplier""",
)
def _normalised(t: Tables):
    k = F.col("s_suppkey")
    legal = F.element_at(
        F.array(*[F.lit(x) for x in (", Inc.", " LLC", " GmbH", " S.A.", " Corp", ", Ltd", "")]),
        (k % 7 + 1).cast("int"),
    )
    return t.raw("supplier").select(
        k.alias("id"), normalised_company(F.concat("s_name", legal)).alias("name")
    )


# -- traversal --------------------------------------------------------------------------------


def _levels(source: str, start: str, depth: int) -> str:
    """SQL of a breadth-first search that keeps the smallest edge-id list of every node."""
    parts = [
        f"""links AS MATERIALIZED (SELECT edge_id, from_id AS node,
      coalesce(to_id, 'day:' || CAST(to_day AS VARCHAR)) AS other FROM {source}
    UNION ALL SELECT edge_id, coalesce(to_id, 'day:' || CAST(to_day AS VARCHAR)), from_id
    FROM {source})""",
        f"l0 AS (SELECT '{start}' AS node, CAST([] AS VARCHAR[]) AS path)",
    ]
    for i in range(1, depth + 1):
        seen = " ".join(f"ANTI JOIN l{j} ON n.node = l{j}.node" for j in range(i))
        parts.append(
            f"""n{i} AS MATERIALIZED (SELECT other AS node, min(list_append(path, edge_id)) AS path
      FROM l{i - 1} JOIN links USING (node) GROUP BY other),
    l{i} AS MATERIALIZED (SELECT n.* FROM n{i} n {seen})"""
        )
    return ",\n".join(parts)


@query(
    "connections",
    "TR1",
    f"""WITH {_levels("facts", "company:3", 2)}
    SELECT c.node, c.depth, coalesce(e.name, replace(c.node, 'day:', '')) AS name,
      coalesce(e.entity_type, 'day') AS node_type
    FROM (SELECT node, 1 AS depth FROM l1 UNION ALL SELECT node, 2 FROM l2) c
    LEFT JOIN entities e ON e.entity_id = c.node""",
)
def _connections(t: Tables):
    return traverse.connections(t.facts(), t.entities(), "company:3", depth=2).nodes


@query(
    "connections_by_label",
    "TR1",
    f"""WITH geo AS (SELECT * FROM facts WHERE edge_label = 'AFFILIATED'),
      {_levels("geo", "region:0", 3)}
    SELECT depth, count(*) AS n FROM (SELECT 1 AS depth FROM l1 UNION ALL SELECT 2 FROM l2
      UNION ALL SELECT 3 FROM l3) GROUP BY depth""",
)
def _connections_label(t: Tables):
    found = traverse.connections(
        t.facts(), t.entities(), "region:0", depth=3, labels=["affiliated"]
    )
    return found.nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    "connection_edges",
    "TR1",
    f"""WITH {_levels("facts", "company:3", 1)}, near AS MATERIALIZED (SELECT node FROM l0 UNION
      SELECT node FROM l1), ends AS MATERIALIZED (SELECT edge_id, from_id,
        coalesce(to_id, 'day:' || CAST(to_day AS VARCHAR)) AS to_node FROM facts)
    SELECT * FROM ends SEMI JOIN near ON from_id = node
    UNION ALL SELECT * FROM ends SEMI JOIN near ON to_node = node
      ANTI JOIN near other ON from_id = other.node""",
)
def _connection_edges(t: Tables):
    found = traverse.connections(t.facts(), t.entities(), "company:3", depth=2)
    return found.edges.select("edge_id", "from_id", "to_node")


@query(
    "shortest_path",
    "TR2",
    f"""WITH {_levels("facts", "person:7", 4)},
      hit AS (SELECT path FROM (SELECT path FROM l1 WHERE node = 'company:3'
        UNION ALL SELECT path FROM l2 WHERE node = 'company:3'
        UNION ALL SELECT path FROM l3 WHERE node = 'company:3'
        UNION ALL SELECT path FROM l4 WHERE node = 'company:3')),
      hops AS (SELECT unnest(path) AS edge_id, generate_subscripts(path, 1) - 1 AS hop FROM hit)
    SELECT h.hop, f.edge_id, f.edge_label, f.fact_type, f.fact FROM hops h JOIN facts f USING (edge_id)""",
)
def _path(t: Tables):
    found = traverse.shortest_path(t.facts(), t.entities(), "person:7", "company:3")
    return found.select("hop", "edge_id", "edge_label", "fact_type", "fact")


@query(
    "direct_facts",
    "TR2",
    """SELECT edge_id, fact FROM facts WHERE (from_id = 'nation:5' AND to_id IN
        (SELECT 'region:' || n_regionkey FROM nation WHERE n_nationkey = 5))""",
)
def _direct(t: Tables):
    region = t.raw("nation").filter("n_nationkey = 5").first().n_regionkey
    return traverse.direct_facts(t.facts(), f"region:{region}", "nation:5").select(
        "edge_id", "fact"
    )


# -- bundles ----------------------------------------------------------------------------------


@query(
    "entity_context",
    "BQ1",
    """WITH mine AS (SELECT * FROM facts WHERE from_id = 'company:3' OR to_id = 'company:3'),
      recs AS (SELECT 'order_' || o_orderkey AS record_id, o_orderdate AS created_at,
        o_orderpriority AS content FROM orders)
    SELECT 'fact' AS section, edge_id AS ref, fact AS text FROM mine
    UNION ALL SELECT DISTINCT 'connection', e.entity_id, e.name FROM mine m JOIN entities e
      ON e.entity_id = CASE WHEN m.from_id = 'company:3' THEN m.to_id ELSE m.from_id END
      WHERE e.entity_id <> 'company:3'
    UNION ALL SELECT * FROM (SELECT 'record', record_id, content FROM recs
      WHERE record_id IN (SELECT source_record FROM mine)
      ORDER BY created_at DESC, record_id LIMIT 20)""",
)
def _entity_context(t: Tables):
    recs = t.raw("orders").select(
        F.concat(F.lit("order_"), "o_orderkey").alias("record_id"),
        F.lit("order").alias("type"),
        F.lit("orders").alias("source"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("content"),
    )
    c = bundles.entity_context(t.facts(), t.entities(), recs, "supplier#000000003")

    def part(df, section, ref, text):
        return df.select(
            F.lit(section).alias("section"), F.col(ref).alias("ref"), F.col(text).alias("text")
        )

    return (
        part(c.facts, "fact", "edge_id", "fact")
        .unionByName(part(c.connections, "connection", "node", "name"))
        .unionByName(part(c.related_records, "record", "record_id", "snippet"))
    )


@query(
    "entity_context_clustered",
    "BQ1 AG4",
    """SELECT edge_label, edge_id, count(*) OVER (PARTITION BY edge_label) AS cluster_size
    FROM facts WHERE from_id = 'person:7' OR to_id = 'person:7'""",
)
def _context_clustered(t: Tables):
    c = bundles.entity_context(
        t.facts(), t.entities(), t.records(), "customer#000000007", format="clustered"
    )
    return c.facts.select("edge_label", "edge_id", "cluster_size")


@query(
    "relationship",
    "BQ2",
    f"""WITH {_levels("facts", "nation:5", 4)},
      hops AS (SELECT unnest(path) AS edge_id, generate_subscripts(path, 1) - 1 AS hop FROM (
        SELECT path FROM l1 WHERE node = 'nation:6' UNION ALL SELECT path FROM l2
          WHERE node = 'nation:6' UNION ALL SELECT path FROM l3 WHERE node = 'nation:6'
          UNION ALL SELECT path FROM l4 WHERE node = 'nation:6'))
    SELECT h.hop, h.edge_id FROM hops h""",
)
def _relationship(t: Tables):
    names = {r.n_nationkey: r.n_name for r in t.raw("nation").filter("n_nationkey in (5, 6)").collect()}
    found = bundles.relationship(t.facts(), t.entities(), names[5], names[6])
    return found.path.select("hop", "edge_id")


@query(
    "resolver_context",
    "BQ3 WN8",
    f"""WITH {BOTH_WAYS}, {CONTEXT}
    SELECT entity_id, 'fact' AS part, fact AS text, edge_label AS detail FROM told WHERE rn <= 10
    UNION ALL SELECT entity_id, 'connection', connection, connection_type FROM linked WHERE rn <= 10""",
)
def _resolver_context(t: Tables):
    return bundles.resolver_context(t.facts(), t.entities(), t.entities())


@query(
    "entity_card",
    "BQ4",
    """SELECT e.entity_id AS node, e.name, min(f.edge_label) AS first_label,
      (SELECT count(*) FROM facts WHERE from_id = 'nation:5' OR to_id = 'nation:5') AS n_facts
    FROM facts f JOIN entities e ON e.entity_id =
      CASE WHEN f.from_id = 'nation:5' THEN f.to_id ELSE f.from_id END
    WHERE f.from_id = 'nation:5' OR f.to_id = 'nation:5' GROUP BY 1, 2""",
)
def _card(t: Tables):
    name = t.raw("nation").filter("n_nationkey = 5").first().n_name
    _, seen, linked = bundles.entity_card(t.facts(), t.entities(), name)
    n = seen.agg(F.count(F.lit(1)).alias("n")).scalar()
    return linked.select("node", "name", "first_label").withColumn("n_facts", n)


@query(
    "current_state",
    "BQ5",
    """SELECT edge_id, fact_type, coalesce(e.name, '?') AS other_name FROM facts f
    LEFT JOIN entities e ON e.entity_id = f.to_id
    WHERE f.from_id = 'person:7' AND edge_label = 'AFFILIATED'""",
)
def _state(t: Tables):
    found = bundles.current_state(t.facts(), t.entities(), "customer#000000007")
    return found.select("edge_id", "fact_type", "other_name")


@query(
    "open_commitments",
    "BQ6",
    """SELECT edge_id, from_id, CAST(valid_until AS VARCHAR) AS valid_until FROM facts
    WHERE edge_label = 'ASSERTED' AND fact_type = 'commitment' AND valid_until < DATE '1996-01-01'""",
)
def _open_commitments(t: Tables):
    found = bundles.open_commitments(t.facts(), before="1996-01-01")
    return found.select("edge_id", "from_id", "valid_until")


@query(
    "open_blockers",
    "BQ7",
    """SELECT edge_id, from_id, fact FROM case_facts b WHERE fact_type = 'blocker' AND NOT EXISTS (
      SELECT 1 FROM case_facts r WHERE r.from_id = b.from_id AND r.fact_type = 'resolution'
        AND r.source_at > b.source_at)""",
)
def _blockers(t: Tables):
    return bundles.open_blockers(t.case_facts()).select("edge_id", "from_id", "fact")


@query(
    "recent_activity",
    "BQ8",
    f"""WITH mine AS (SELECT CASE WHEN edge_label = 'TRANSITIONED' THEN 'transition'
        ELSE 'reference' END AS kind, source_at AS stamp, fact AS text, edge_id AS ref
      FROM case_facts WHERE from_id = 'person:42' AND source_at >= TIMESTAMP '1996-01-01'
        AND fact_type IN ('resolution', 'reference')),
      letters AS (SELECT 'mail' AS kind, CAST(replace(replace(received_at, 'T', ' '), 'Z', '')
          AS TIMESTAMP) AS stamp, subject AS text, message_id AS ref
        FROM mail WHERE contains(lower(sender), 'customer#000000042')
          OR contains(lower(recipients), 'customer#000000042')
        ORDER BY received_at DESC, message_id LIMIT 20)
    SELECT kind, strftime(stamp, {SEC}) AS stamp, text, ref
    FROM (SELECT * FROM mine UNION ALL SELECT * FROM letters)""",
)
def _activity(t: Tables):
    letters = t.mail().select(
        F.col("message_id").alias("record_id"), "sender", "recipients", "subject", "received_at"
    )
    found = bundles.recent_activity(
        t.case_facts(), t.entities(), letters, "customer#000000042", "1996-01-01"
    )
    return found.withColumnRenamed("at", "stamp")


@query(
    "recent_activity_counts",
    "BQ8",
    f"""SELECT from_id, CASE WHEN edge_label = 'TRANSITIONED' THEN 'transition' ELSE 'reference'
        END AS kind, count(*) AS n, strftime(max(source_at), {SEC}) AS last_at FROM case_facts
    WHERE fact_type IN ('resolution', 'reference') AND source_at >= TIMESTAMP '1996-01-01'
    GROUP BY 1, 2""",
)
def _activity_counts(t: Tables):
    return bundles.recent_activity_counts(t.case_facts(), "1996-01-01")


@query(
    "canonical_facts",
    "BQ9 JN3",
    """SELECT f.edge_id, a.name AS from_name, upper(left(a.entity_type, 1)) || substr(a.entity_type, 2)
        AS from_type, b.name AS to_name, 'https://orders.example/' || substr(f.source_record, 7)
        AS source_url
    FROM case_facts f JOIN entities a ON a.entity_id = f.from_id
    LEFT JOIN entities b ON b.entity_id = f.to_id
    UNION ALL SELECT f.edge_id, a.name, upper(left(a.entity_type, 1)) || substr(a.entity_type, 2),
      b.name, 'https://orders.example/' || o.o_orderkey FROM facts f JOIN entities a ON a.entity_id = f.from_id
    LEFT JOIN entities b ON b.entity_id = f.to_id
    LEFT JOIN orders o ON 'order_' || o.o_orderkey = f.source_record""",
)
def _canonical(t: Tables):
    recs = t.raw("orders").select(
        F.concat(F.lit("order_"), "o_orderkey").alias("record_id"),
        F.create_map(
            F.lit("url"), F.concat(F.lit("https://orders.example/"), "o_orderkey")
        ).alias("metadata"),
    )
    made = bundles.canonical_facts(t.case_facts().unionByName(t.facts()), t.entities(), recs)
    return made.select(
        "edge_id",
        F.col("from_entity.name").alias("from_name"),
        F.col("from_entity.type").alias("from_type"),
        F.col("to_entity.name").alias("to_name"),
        "source_url",
    )


@query(
    "newest_records_per_entity",
    "BQ1 WN8",
    """SELECT entity_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id
        ORDER BY created_at DESC, record_id) AS rn FROM (
        SELECT DISTINCT f.entity_id, f.source_record AS record_id, o.o_orderdate AS created_at
        FROM (SELECT from_id AS entity_id, source_record FROM facts
              UNION ALL SELECT to_id, source_record FROM facts WHERE to_id IS NOT NULL) f
        JOIN orders o ON 'order_' || o.o_orderkey = f.source_record)) WHERE rn <= 3""",
)
def _newest_records(t: Tables):
    recs = t.raw("orders").select(
        F.concat(F.lit("order_"), "o_orderkey").alias("record_id"),
        F.col("o_orderdate").alias("created_at"),
    )
    found = bundles.newest_records_per_entity(t.facts(), recs, 3)
    return found.select("entity_id", "record_id")


@query(
    "connection_names",
    "BQ3 TR1",
    """SELECT DISTINCT p.entity_id, e.name AS connection FROM (
      SELECT from_id AS entity_id, to_id AS other FROM facts
      UNION ALL SELECT to_id, from_id FROM facts WHERE to_id IS NOT NULL) p JOIN entities e ON e.entity_id = p.other
    WHERE p.other <> p.entity_id""",
)
def _connection_names(t: Tables):
    return fq.connection_names(t.facts(), t.entities()).select("entity_id", "connection")
