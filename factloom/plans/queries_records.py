"""Record, message, source, registry and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.columns import source_time
from factloom.operators import ivf, messages, records, vectors
from factloom.plans.catalog import query
from factloom.schema import RECORD_TYPES, schema_fingerprint
from factloom.sources import files, registry, typed
from factloom.sources import records as src
from factloom.sources.tables import Tables

SEC = "'%Y-%m-%d %H:%M:%S'"


MAIL_CONTENT = (
    "'From: ' || sender || chr(10) || 'To: ' || recipients || chr(10) || 'Subject: ' || subject "
    "|| chr(10) || 'Date: ' || received_at || chr(10) || chr(10) || body"
)
MAIL_NOISE = "(contains(lower(sender), 'no-reply') OR precedence = 'bulk')"


@query(
    "email_records",
    "SRC3 CL2 FLT14",
    f"""SELECT message_id AS dedup_key, md5({MAIL_CONTENT}) AS content_md5, sender, recipients,
      subject, received_at, thread_id, CASE WHEN {MAIL_NOISE} THEN 'noise' END AS classification
    FROM mail""",
)
def _email_records(t: Tables):
    m = F.col("metadata")
    return src.email_records(t.mail()).select(
        "dedup_key",
        F.md5("content").alias("content_md5"),
        *[m[c].alias(c) for c in ("sender", "recipients", "subject", "received_at", "thread_id")],
        "classification",
    )


@query(
    "mail_noise_counts",
    "CL2",
    f"SELECT {MAIL_NOISE} AS noise, count(*) AS n FROM mail GROUP BY 1",
)
def _mail_noise(t: Tables):
    marked = t.mail().select(src.mail_noise("sender", "headers").alias("noise"))
    return marked.groupBy("noise").agg(F.count(F.lit(1)).alias("n"))


ISSUES = """issues AS (SELECT 'iss_' || doc_id AS id, upper(lang) || '-' || doc_id AS identifier,
    left(replace(text, chr(10), ' '), 60) AS title, text, doc_id,
    CASE doc_id % 4 WHEN 0 THEN 'Todo' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Done'
         ELSE 'Canceled' END AS status, 'P' || (doc_id % 5) AS priority,
    CASE WHEN doc_id % 3 <> 0 THEN 'user ' || (doc_id % 17) ELSE '' END AS assignee,
    source AS project, lang, 'https://issues.example/' || doc_id AS url,
    strftime(make_timestamp((1704067200 + doc_id * 600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp
    FROM documents)"""


@query(
    "flatten_issues",
    "SRC5",
    f"""WITH {ISSUES} SELECT id, identifier, title, status, priority, assignee, project,
      '["' || lang || '","' || project || '"]' AS labels, url, stamp AS created_at,
      CASE WHEN doc_id % 4 = 1 THEN 3 ELSE 0 END AS n_comments FROM issues""",
)
def _flatten_issues(t: Tables):
    return src.flatten_issues(t.issue_nodes()).select(
        "id",
        "identifier",
        "title",
        "status",
        "priority",
        "assignee",
        "project",
        F.to_json("labels").alias("labels"),
        "url",
        "created_at",
        F.size("comments").alias("n_comments"),
    )


@query(
    "issue_records",
    "SRC4",
    f"""WITH {ISSUES} SELECT id AS dedup_key, md5('Issue: ' || identifier || ' — ' || title
        || chr(10) || 'Status: ' || status || chr(10) || 'Priority: ' || priority || chr(10)
        || 'Assignee: ' || assignee || chr(10) || 'Project: ' || project || chr(10)
        || 'URL: ' || url || chr(10)
        || CASE WHEN doc_id % 6 <> 0 AND text <> '' THEN chr(10) || text ELSE '' END
        || CASE WHEN doc_id % 4 = 1 THEN chr(10) || chr(10) || 'Comments:' || chr(10)
             || '  [' || project || '] ' || text || chr(10)
             || '  [] ' || left(text, 20) || chr(10) ELSE '' END) AS content_md5,
      stamp AS linear_created_at, 'reality' AS op_area FROM issues""",
)
def _issue_records(t: Tables):
    made = src.issue_records(src.flatten_issues(t.issue_nodes()))
    return made.select(
        "dedup_key",
        F.md5("content").alias("content_md5"),
        F.col("metadata")["linear_created_at"].alias("linear_created_at"),
        F.col("metadata")["op_area"].alias("op_area"),
    )


PRIORITY = (
    "CASE {0} WHEN 0 THEN 'No priority' WHEN 1 THEN 'Urgent' WHEN 2 THEN 'High' "
    "WHEN 3 THEN 'Medium' WHEN 4 THEN 'Low' ELSE coalesce(CAST({0} AS VARCHAR), '') END"
)
CHANGES = f"""ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
      strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp,
      CASE WHEN user_id % 10 <> 0 THEN 'user_' || user_id ELSE '' END AS actor FROM events),
    pri AS (SELECT *, CASE WHEN event_type = 'error' THEN k % 6 END AS p1,
      CASE WHEN event_type IN ('error', 'click') THEN k % 4 END AS p2 FROM ev),
    changes AS (
    SELECT 'h' || event_id AS id, 'iss_' || (event_id % (SELECT count(*) FROM documents)) AS issue_id, stamp AS created_at, actor,
      'status' AS field, CASE WHEN k > 50 THEN 'Todo' ELSE '' END AS from_value,
      upper(left(event_type, 1)) || substr(event_type, 2) AS to_value
    FROM ev WHERE event_type IN ('purchase', 'signup')
    UNION ALL SELECT 'h' || event_id || '_assignee', 'iss_' || (event_id % (SELECT count(*) FROM documents)), stamp, actor,
      'assignee', '', 'user ' || k FROM ev WHERE event_type IN ('view', 'click')
    UNION ALL SELECT 'h' || event_id || '_priority', 'iss_' || (event_id % (SELECT count(*) FROM documents)), stamp, actor,
      'priority', {PRIORITY.format("p1")}, {PRIORITY.format("p2")}
    FROM pri WHERE p1 IS DISTINCT FROM p2)"""


@query("history_changes", "SRC6", f"WITH {CHANGES} SELECT * FROM changes")
def _history(t: Tables):
    return src.history_changes(t.history_nodes())


@query(
    "history_changes_since",
    "SRC6 SRC11",
    f"""WITH {CHANGES} SELECT field, count(*) AS n, min(created_at) AS first_at FROM changes
    WHERE created_at > '2024-01-10T00:00:00Z' GROUP BY field""",
)
def _history_since(t: Tables):
    made = src.history_changes(t.history_nodes(), since="2024-01-10T00:00:00Z")
    return made.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at")
    )


@query(
    "change_records",
    "SRC7",
    f"""WITH {CHANGES} SELECT id AS dedup_key, field, created_at AS changed_at, actor AS changed_by,
      ': ' || field || ' changed from ''' || from_value || ''' to ''' || to_value || ''' by '
        || actor || ' at ' || created_at AS told FROM changes""",
)
def _change_records(t: Tables):
    made = src.change_records(src.history_changes(t.history_nodes()))
    m = F.col("metadata")
    return made.select(
        "dedup_key",
        *[m[c].alias(c) for c in ("field", "changed_at", "changed_by")],
        F.expr("substr(content, instr(content, ': '))").alias("told"),
    )


CODE = """code AS (SELECT doc_id, doc_id + 1000 AS number,
    left(replace(text, chr(10), ' '), 60) AS title,
    CASE WHEN doc_id % 7 <> 0 THEN text ELSE '' END AS body, lang, source,
    CASE WHEN doc_id % 3 = 0 THEN 'closed' ELSE 'open' END AS state,
    'dev' || (doc_id % 23) AS author, 'https://code.example/' || doc_id AS url,
    strftime(make_timestamp((1704067200 + doc_id * 600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp
    FROM documents)"""


@query(
    "flatten_pull_requests",
    "SRC9",
    f"""WITH {CODE} SELECT doc_id AS github_id, number, title, state, author,
      'feat/' || lang AS branch, 'main' AS base_branch, '["rev' || (doc_id % 5) || '"]' AS reviewers,
      CASE WHEN doc_id % 3 = 0 THEN stamp ELSE '' END AS merged_at
    FROM code WHERE doc_id % 2 = 0""",
)
def _flatten_prs(t: Tables):
    prs = t.code_nodes().filter(F.col("pull_request").isNotNull())
    return src.flatten_pull_requests(prs).select(
        "github_id",
        "number",
        "title",
        "state",
        "author",
        "branch",
        "base_branch",
        F.to_json("reviewers").alias("reviewers"),
        "merged_at",
    )


@query(
    "pull_request_records",
    "SRC8",
    f"""WITH {CODE} SELECT CAST(doc_id AS VARCHAR) AS dedup_key,
      md5('PR #' || number || ': ' || title || chr(10) || 'Author: ' || author || chr(10)
        || 'State: ' || state || chr(10) || 'Branch: feat/' || lang || ' → main' || chr(10)
        || 'URL: ' || url || chr(10)
        || CASE WHEN body <> '' THEN chr(10) || body ELSE '' END) AS content_md5
    FROM code WHERE doc_id % 2 = 0""",
)
def _pr_records(t: Tables):
    prs = t.code_nodes().filter(F.col("pull_request").isNotNull())
    made = src.pull_request_records(src.flatten_pull_requests(prs))
    return made.select("dedup_key", F.md5("content").alias("content_md5"))


@query(
    "code_issue_records",
    "SRC8 SRC9 SRC10",
    f"""WITH {CODE} SELECT CAST(doc_id AS VARCHAR) AS dedup_key,
      md5('Issue #' || number || ': ' || title || chr(10) || 'Author: ' || author || chr(10)
        || 'State: ' || state || chr(10) || 'URL: ' || url || chr(10)
        || CASE WHEN body <> '' THEN chr(10) || body ELSE '' END) AS content_md5,
      '["' || source || '","' || lang || '"]' AS assignees
    FROM code WHERE doc_id % 2 = 1""",
)
def _code_issues(t: Tables):
    issues = src.without_pull_requests(t.code_nodes())
    made = src.code_issue_records(src.flatten_code_issues(issues))
    return made.select(
        "dedup_key",
        F.md5("content").alias("content_md5"),
        F.col("metadata")["assignees"].alias("assignees"),
    )


@query(
    "route_by_shape",
    "SRC10",
    """SELECT CASE WHEN doc_id % 2 = 0 THEN 'pr' ELSE 'issue' END AS shape, count(*) AS n
    FROM documents GROUP BY 1""",
)
def _route(t: Tables):
    n = t.code_nodes()
    flat = n.select("id", F.col("head.ref").alias("branch"), F.col("base.ref").alias("base_branch"))
    prs, issues = src.route_by_shape(flat)
    both = prs.select(F.lit("pr").alias("shape")).unionByName(
        issues.select(F.lit("issue").alias("shape"))
    )
    return both.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query(
    "incremental_since",
    "SRC11",
    f"""WITH {ISSUES} SELECT id, status, stamp AS updated_at FROM issues
    WHERE stamp > '2024-01-04T00:00:00Z' AND status = 'Done'""",
)
def _incremental(t: Tables):
    flat = src.flatten_issues(t.issue_nodes())
    done = src.incremental_since(flat, "2024-01-04T00:00:00Z", status=src.FINISHED_STATE)
    return done.select("id", "status", "updated_at")


@query(
    "typed_projection",
    "SRC12 SRC13",
    f"""WITH {CODE} SELECT doc_id AS github_id, number, title, state, author, lang AS label,
      1 AS n_labels FROM code WHERE doc_id % 2 = 0""",
)
def _typed(t: Tables):
    prs = src.flatten_pull_requests(t.code_nodes().filter(F.col("pull_request").isNotNull()))
    made = src.pull_request_records(prs)
    shaped = typed.project_typed(made, RECORD_TYPES["github_pr"])
    return shaped.select(
        "github_id",
        "number",
        "title",
        "state",
        "author",
        F.col("labels")[0].alias("label"),
        F.size("labels").alias("n_labels"),
    )


def _versions(t: Tables):
    """Registry-like rows from parts: brand as name, size as version, price order as time."""
    p = t.raw("part")
    return p.groupBy(
        F.col("p_brand").alias("name"),
        F.concat(F.lit("0."), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("version"),
    ).agg(
        F.timestamp_seconds(F.lit(1_600_000_000) + F.min("p_partkey") * 60).alias("installed_at"),
        (F.min("p_partkey") % 3 == 0).alias("enabled"),
        F.min("p_type").alias("source_type"),
    )


VERSIONS = """versions AS (SELECT p_brand AS name, '0.' || lpad(CAST(p_size AS VARCHAR), 2, '0')
      AS version, make_timestamp((1600000000 + min(p_partkey) * 60) * 1000000) AS installed_at,
      min(p_partkey) % 3 = 0 AS enabled, min(p_type) AS source_type FROM part GROUP BY 1, 2)"""


@query(
    "active_typed_tables",
    "SRC14 WN4",
    f"""WITH {VERSIONS} SELECT source, record_type, table_name FROM (
      SELECT name AS source, source_type AS record_type,
        name || '_' || source_type || '_' || replace(version, '.', '_') AS table_name,
        row_number() OVER (PARTITION BY name, source_type ORDER BY installed_at DESC,
          name || '_' || source_type || '_' || replace(version, '.', '_') DESC) AS rn
      FROM versions) WHERE rn = 1""",
)
def _active_tables(t: Tables):
    schemas = _versions(t).select(
        F.col("name").alias("source"),
        F.col("source_type").alias("record_type"),
        F.concat_ws("_", "name", "source_type", F.translate("version", ".", "_")).alias(
            "table_name"
        ),
        F.col("installed_at").alias("created_at"),
    )
    return typed.active_typed_tables(schemas).select("source", "record_type", "table_name")


@query(
    "active_versions",
    "RG1",
    f"WITH {VERSIONS} SELECT name, version, source_type FROM versions WHERE enabled",
)
def _active_versions(t: Tables):
    return registry.active_versions(_versions(t)).select("name", "version", "source_type")


@query(
    "latest_version_per_name",
    "WN4 RG1",
    f"""WITH {VERSIONS} SELECT name, version FROM (SELECT *, row_number() OVER (PARTITION BY name
      ORDER BY installed_at DESC, version DESC) AS rn FROM versions) WHERE rn = 1""",
)
def _latest_version(t: Tables):
    return registry.latest_version_per_name(_versions(t)).select("name", "version")


@query(
    "apply_registration",
    "RG2",
    f"""WITH {VERSIONS}, batch AS (SELECT name, '9.00' AS version, TIMESTAMP '2030-01-01' AS stamp,
        TRUE AS enabled, 'pulled' AS source_type FROM versions
        WHERE length(name) = 7 GROUP BY name
      UNION ALL SELECT name, min(version), TIMESTAMP '2030-01-01', FALSE, 'pulled' FROM versions
        GROUP BY name),
      merged AS (SELECT coalesce(b.name, v.name) AS name, coalesce(b.version, v.version) AS version,
        coalesce(v.installed_at, b.stamp) AS installed_at,
        CASE WHEN b.name IS NOT NULL THEN b.enabled ELSE v.enabled END AS enabled,
        CASE WHEN b.name IS NOT NULL THEN b.source_type ELSE v.source_type END AS source_type,
        b.name IS NOT NULL AS in_batch
      FROM versions v FULL JOIN batch b ON v.name = b.name AND v.version = b.version),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY name, enabled
        ORDER BY in_batch DESC, installed_at DESC, version DESC) AS rn FROM merged)
    SELECT name, version, source_type, enabled AND rn = 1 AS enabled FROM ranked""",
)
def _registration(t: Tables):
    known = _versions(t)
    at = F.lit("2030-01-01").cast("timestamp").alias("installed_at")
    pulled = F.lit("pulled").alias("source_type")
    fresh = (
        known.filter(F.length("name") == 7)
        .select("name", F.lit("9.00").alias("version"), at, F.lit(True).alias("enabled"), pulled)
        .distinct()
    )
    again = (
        known.groupBy("name")
        .agg(F.min("version").alias("version"))
        .select("name", "version", at, F.lit(False).alias("enabled"), pulled)
    )
    done = registry.apply_registration(known, fresh.unionByName(again))
    return done.select("name", "version", "source_type", "enabled")


@query(
    "vocab_collisions",
    "VA4 JN11",
    f"""WITH {VERSIONS}, declared AS (
        SELECT v.name AS source, p.p_type AS type_name FROM versions v JOIN part p
          ON p.p_brand = v.name AND '0.' || lpad(CAST(p.p_size AS VARCHAR), 2, '0') = v.version
        WHERE v.enabled),
      taken AS (SELECT DISTINCT source AS taken_by, lower(type_name) AS low FROM declared
        UNION ALL SELECT NULL, unnest(['person', 'company', 'project', 'event'])),
      proposed AS (SELECT DISTINCT p_brand AS source, p_type AS proposed_name FROM part
        UNION ALL SELECT 'Brand#1', 'Person')
    SELECT proposed_name, taken_by, p.source FROM proposed p JOIN taken t ON lower(proposed_name) = low
    WHERE taken_by IS NULL OR taken_by <> p.source""",
)
def _collisions(t: Tables):
    known = _versions(t)
    p = t.raw("part")
    kinds = p.select(
        F.col("p_brand").alias("name"),
        F.concat(F.lit("0."), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("version"),
        F.col("p_type").alias("type_name"),
    )
    proposed = p.select(
        F.lit("entity_type").alias("kind"),
        F.col("p_brand").alias("source"),
        F.col("p_type").alias("proposed_name"),
    ).distinct()
    extra = t.spark.createDataFrame(
        [("entity_type", "Brand#1", "Person")], "kind string, source string, proposed_name string"
    )
    claimed = t.spark.createDataFrame([], "kind string, source string, claimed_name string")
    hits = registry.vocab_collisions(proposed.unionByName(extra), kinds, known, claimed)
    return hits.select("proposed_name", "taken_by", "source")


# -- record quality ---------------------------------------------------------------------------


@query(
    "dedup_records",
    "DD1 WN3 SNK4",
    """SELECT record_id, type, dedup_key FROM (SELECT *, row_number() OVER (
        PARTITION BY coalesce('k' || dedup_key, 'r' || record_id) ORDER BY created_at, record_id)
        AS rn FROM records) WHERE rn = 1""",
)
def _dedup(t: Tables):
    return records.dedup_records(t.records()).select("record_id", "type", "dedup_key")


@query(
    "dedup_against_stored",
    "DD1 SNK4 CL1",
    """SELECT record_id, coalesce(classification, 'pending_triage') AS classification FROM (
      SELECT *, row_number() OVER (PARTITION BY coalesce('k' || dedup_key, 'r' || record_id)
        ORDER BY created_at, record_id) AS rn FROM records
      WHERE dedup_key IS NULL OR dedup_key NOT IN
        (SELECT md5(text) FROM documents WHERE lang <> 'en')) WHERE rn = 1""",
)
def _dedup_stored(t: Tables):
    stored = t.records().filter("metadata['lang'] <> 'en'")
    saved = records.save_records(t.records(), stored, policy="required")
    return saved.select("record_id", "classification")


@query(
    "upsert_issues",
    "DD3",
    """SELECT 'iss_' || doc_id AS linear_id, CASE WHEN doc_id % 2 = 0 THEN 'rec_' || doc_id END
        AS known_id, CASE WHEN doc_id % 3 = 0 THEN 'moved' ELSE source END AS project,
      CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'updated' WHEN doc_id % 2 = 0 THEN 'kept'
           ELSE 'new' END AS change
    FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""",
)
def _upsert(t: Tables):
    flat = src.flatten_issues(t.issue_nodes())
    n = F.split_part("id", F.lit("_"), F.lit(2)).cast("long")
    stored = flat.filter(n % 2 == 0).select(
        F.concat(F.lit("rec_"), n).alias("record_id"),
        F.col("id").alias("linear_id"),
        "created_at",
        "project",
        "status",
        "updated_at",
    )
    incoming = flat.filter(n % 3 == 0).select(
        F.col("id").alias("linear_id"),
        "created_at",
        F.lit("moved").alias("project"),
        "status",
        "updated_at",
    )
    done = records.upsert_issues(stored, incoming)
    known = F.when(F.startswith("record_id", F.lit("rec_")), F.col("record_id"))
    return done.select("linear_id", known.alias("known_id"), "project", "change")


@query(
    "classify_policy",
    "CL1",
    """SELECT type, coalesce(classification, CASE WHEN source < 'src2' THEN 'relevant'
        WHEN source < 'user_5' THEN 'pending_triage' END) AS label, count(*) AS n
    FROM records GROUP BY ALL""",
)
def _policy(t: Tables):
    policy = F.when(F.col("source") < "src2", "skip").when(F.col("source") < "user_5", "required")
    labelled = t.records().withColumn("label", records.classify_policy(policy))
    return labelled.groupBy("type", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "apply_triage",
    "CL3",
    """SELECT record_id, CASE WHEN classification IS NOT NULL THEN classification
        WHEN quality IS NULL THEN 'uncertain' WHEN quality = 0 THEN 'noise' ELSE 'relevant' END
        AS classification,
      CASE WHEN r.classification IS NULL AND quality IS NOT NULL
        THEN CASE WHEN toxic = 1 THEN 'intention' ELSE 'reality' END END AS op_area
    FROM records r LEFT JOIN labels l ON r.record_id = 'document_' || l.doc_id""",
)
def _triage(t: Tables):
    waiting = t.records().withColumn(
        "classification", F.coalesce("classification", F.lit("pending_triage"))
    )
    decisions = t.raw("labels").select(
        F.concat(F.lit("document_"), "doc_id").alias("record_id"),
        F.when(F.col("quality") == 0, "noise").otherwise("relevant").alias("classification"),
        F.when(F.col("toxic") == 1, "intention").alias("op_area"),
    )
    done = records.apply_triage(waiting, decisions)
    return done.select(
        "record_id", "classification", F.col("metadata")["op_area"].alias("op_area")
    )


@query(
    "mark_manual",
    "CL3",
    """SELECT classification, count(*) AS n FROM (SELECT CASE WHEN record_id IN
        (SELECT 'document_' || doc_id FROM labels) THEN 'relevant' ELSE classification END
        AS classification FROM records) GROUP BY 1""",
)
def _manual(t: Tables):
    manual = t.raw("labels").select(F.concat(F.lit("document_"), "doc_id").alias("record_id"))
    done = records.mark_manual(t.records(), manual)
    return done.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@query(
    "manual_context",
    "CL3 SRC4 SRC8",
    """WITH told AS (SELECT 'document_' || doc_id AS record_id, CASE WHEN quality = 1 THEN 'checked by hand' ELSE ' ' END
        AS context FROM labels)
    SELECT r.record_id, md5(coalesce(r.raw, '')) AS raw_md5, CASE WHEN t.record_id IS NULL THEN r.classification
        ELSE 'relevant' END AS classification, md5(coalesce(content, '') || CASE
          WHEN t.context = 'checked by hand' THEN chr(10) || chr(10) || 'Additional context from human:' || chr(10) || t.context
          WHEN coalesce(r.human_context, '') <> '' THEN chr(10) || chr(10) || 'Additional context from human:' || chr(10)
            || r.human_context ELSE '' END) AS text_md5
    FROM records r LEFT JOIN told t USING (record_id)""",
)
def _manual_context(t: Tables):
    """Payload, label and extraction text of all records; what a person said by hand goes before the stored context."""
    note = F.when(F.col("quality") == 1, "checked by hand").otherwise(" ")
    manual = t.raw("labels").select(F.concat(F.lit("document_"), "doc_id").alias("record_id"), note.alias("human_context"))
    done = records.mark_manual(t.records(), manual)
    text = F.md5(records.extraction_text(done)).alias("text_md5")
    return done.select("record_id", F.md5(F.coalesce("raw", F.lit(""))).alias("raw_md5"), "classification", text)


# -- record queries ---------------------------------------------------------------------------


@query(
    "query_records",
    "FLT1 TK1",
    f"""SELECT record_id, type, source, classification, expert_name,
      strftime(created_at, {SEC}) AS created_at, left(content, 300) AS snippet
    FROM records WHERE type = 'document' AND contains(lower(source), 'src1')
      AND expert_name = 'documents' AND classification = 'relevant' AND lang = 'en'
      AND records.created_at >= TIMESTAMP '2024-01-01'
    ORDER BY records.created_at DESC NULLS FIRST, record_id LIMIT 50""",
)
def _query_records(t: Tables):
    found = records.query_records(
        t.records(),
        record_type="document",
        source="SRC1",
        expert="documents",
        classification="relevant",
        since="2024-01-01",
        metadata={"lang": "en", "no such-key": "x"},
    )
    return found.drop("metadata", "expert_version")


@query(
    "query_records_recent",
    "FLT1 TK1",
    f"""SELECT record_id, type, strftime(created_at, {SEC}) AS created_at FROM records
    WHERE k = '7' AND records.created_at <= TIMESTAMP '2024-01-20'
    ORDER BY records.created_at DESC NULLS FIRST, record_id LIMIT 50""",
)
def _query_records_recent(t: Tables):
    found = records.query_records(t.records(), until="2024-01-20", metadata={"k": 7})
    return found.select("record_id", "type", "created_at")


@query(
    "list_records",
    "FLT15 TK1",
    f"""SELECT record_id, type, strftime(created_at, {SEC}) AS created_at FROM records
    ORDER BY records.created_at DESC NULLS FIRST, record_id LIMIT 20""",
)
def _list_records(t: Tables):
    return records.list_records(t.records(), 20).select("record_id", "type", "created_at")


@query(
    "record_lookup",
    "FLT14",
    """SELECT record_id, type, source, md5(content) AS content_md5 FROM records
    WHERE record_id = 'document_42'""",
)
def _record(t: Tables):
    found = records.record_by_id(t.records(), "document_42")
    return found.select("record_id", "type", "source", F.md5("content").alias("content_md5"))


def _typed_mail(t: Tables):
    return t.mail().select(
        F.concat(F.lit("email_"), "message_id").alias("record_id"),
        "message_id",
        "sender",
        "subject",
        "body",
    )


def _mail_rows(t: Tables):
    return t.mail().select(
        F.concat(F.lit("email_"), "message_id").alias("record_id"),
        F.lit("mailbox").alias("source"),
        F.to_timestamp("received_at").alias("created_at"),
    )


@query(
    "list_mail",
    "FLT15 JN1 TK1",
    """SELECT 'email_' || message_id AS record_id, sender, subject, received_at FROM mail
    ORDER BY received_at DESC, 'email_' || message_id LIMIT 20""",
)
def _list_mail(t: Tables):
    found = records.list_typed(_mail_rows(t), _typed_mail(t), 20)
    return found.select(
        "record_id",
        "sender",
        "subject",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("received_at"),
    )


@query(
    "mail_by_key",
    "FLT14 JN1",
    "SELECT 'email_' || message_id AS record_id, subject FROM mail WHERE message_id = 'm5-1'",
)
def _mail_by_key(t: Tables):
    found = records.typed_by_key(_mail_rows(t), _typed_mail(t), "message_id", "m5-1")
    return found.select("record_id", "subject")


@query(
    "pending_records",
    "FLT16 JN2",
    """SELECT * FROM (SELECT 'email_' || message_id AS record_id, sender,
        CAST(NULL AS VARCHAR) AS identifier, received_at AS stamp FROM mail
      UNION ALL SELECT 'issue_' || doc_id, NULL, upper(lang) || '-' || doc_id,
        strftime(make_timestamp((1704067200 + doc_id * 600) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
      FROM documents) ORDER BY stamp DESC, record_id LIMIT 40""",
)
def _pending(t: Tables):
    issues = src.flatten_issues(t.issue_nodes()).select(
        F.concat(F.lit("issue_"), F.split_part("id", F.lit("_"), F.lit(2))).alias("record_id"),
        "identifier",
        "title",
        "status",
        "priority",
        "assignee",
        F.to_timestamp("created_at").alias("created_at"),
    )
    none = F.lit(None).cast("string").alias("classification")
    rows = _mail_rows(t).select("record_id", F.lit("email").alias("type"), "source", "created_at", none)
    rows = rows.unionByName(
        issues.select(
            "record_id", F.lit("issue").alias("type"), F.lit("tracker").alias("source"), "created_at", none
        )
    )
    found = records.pending_records(rows, _typed_mail(t), issues, 40)
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp")
    return found.select("record_id", "sender", "identifier", at)


@query(
    "pending_extraction",
    "FLT17",
    """SELECT type, count(*) AS n FROM records WHERE classification = 'relevant' AND NOT indexed
    GROUP BY type""",
)
def _pending_extraction(t: Tables):
    waiting = records.pending_extraction(t.records())
    return waiting.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "next_for_extraction",
    "FLT17",
    f"""SELECT record_id, strftime(created_at, {SEC}) AS created_at FROM records
    WHERE classification = 'relevant' AND NOT indexed
    ORDER BY records.created_at, record_id LIMIT 500""",
)
def _next(t: Tables):
    return records.next_for_extraction(t.records(), 500).select("record_id", "created_at")


COMMUNICATION = """hits AS (SELECT e.entity_id, m.message_id, m.received_at
    FROM mail m JOIN entities e ON e.entity_type = 'person'
      AND (contains(lower(m.sender), lower(e.name)) OR contains(lower(m.recipients), lower(e.name))
        OR contains(lower(m.sender), lower(e.email))
        OR contains(lower(m.recipients), lower(e.email))))"""


def _mail_view(t: Tables):
    return t.mail().select(
        F.col("message_id").alias("record_id"), "sender", "recipients", "subject", "received_at"
    )


@query(
    "communications",
    "FLT18 TK1",
    f"""WITH {COMMUNICATION} SELECT message_id AS record_id, received_at FROM hits
    WHERE entity_id = 'person:11' AND received_at >= '2024-01-01T00:00:00Z'
    ORDER BY received_at DESC, message_id LIMIT 20""",
)
def _communications(t: Tables):
    one = t.entities().filter("entity_id = 'person:11'").first()
    found = records.communications(_mail_view(t), one.name, one.email, "2024-01-01T00:00:00Z")
    return found.select("record_id", "received_at")


@query(
    "communications_of_all",
    "FLT18 JN6 ST4",
    f"""WITH {COMMUNICATION} SELECT entity_id, message_id AS record_id, received_at FROM (
      SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY received_at DESC, message_id)
        AS rn FROM hits) WHERE rn <= 5""",
)
def _communications_all(t: Tables):
    people = t.entities().filter("entity_type = 'person'")
    return records.communications_of_all(_mail_view(t), people, per_entity=5)


# -- messages ---------------------------------------------------------------------------------


@query(
    "session_history",
    "FLT19",
    "SELECT seq, from_agent, md5(content) AS m FROM messages WHERE session_id = 'ses_5'",
)
def _history_of(t: Tables):
    found = messages.session_history(t.messages(), "ses_5")
    return found.select("seq", "from_agent", F.md5("content").alias("m"))


@query(
    "unread_messages",
    "FLT19",
    "SELECT session_id, seq FROM messages WHERE to_agent = 'human' AND NOT read",
)
def _unread(t: Tables):
    return messages.unread(t.messages(), "human").select("session_id", "seq")


@query(
    "list_sessions",
    "FLT19",
    f"""SELECT session_id, count(*) AS n_messages, strftime(max(created_at), {SEC}) AS last_at,
      count(*) FILTER (NOT read) AS n_unread FROM messages GROUP BY session_id""",
)
def _sessions(t: Tables):
    return messages.list_sessions(t.messages()).drop("started_at")


@query(
    "transcripts",
    "FLT20",
    """SELECT session_id, seq, role, md5(content) AS m FROM (
      SELECT *, CASE WHEN from_agent = 'assistant' THEN 'assistant' ELSE 'user' END AS role,
        row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM messages)
    WHERE NOT (back = 1 AND role = 'user')""",
)
def _transcripts(t: Tables):
    found = messages.transcripts(t.messages(), "assistant")
    return found.select("session_id", "seq", "role", F.md5("content").alias("m"))


# -- event time -------------------------------------------------------------------------------


@query(
    "source_time",
    "GB4",
    f"""SELECT message_id, strftime(CASE WHEN turn_even THEN CAST(replace(replace(received_at,
        'T', ' '), 'Z', '') AS TIMESTAMP) ELSE TIMESTAMP '2024-02-01' END, {SEC}) AS source_at
    FROM (SELECT *, CAST(split_part(message_id, '-', 2) AS INT) % 2 = 0 AS turn_even FROM mail)""",
)
def _source_time(t: Tables):
    turn = F.split_part("message_id", F.lit("-"), F.lit(2)).cast("int")
    bag = F.create_map(
        F.lit("received_at"), F.when(turn % 2 == 0, F.col("received_at")).otherwise(F.lit(""))
    )
    rows = t.mail().select(
        "message_id", bag.alias("metadata"), F.lit("2024-02-01").cast("timestamp").alias("created_at")
    )
    return rows.select("message_id", source_time().alias("source_at"))


# -- seeds ------------------------------------------------------------------------------------


def _seed_lines(t: Tables):
    """Seed files of up to 20 suppliers of a nation, with facts and aliases for them."""
    s = t.raw("supplier").withColumns(
        {"nation": F.col("s_nationkey"), "block": F.floor(F.col("s_suppkey") / 20)}
    )
    told = s.groupBy("nation", "block").agg(
        F.array_join(
            F.array_sort(
                F.collect_list(F.concat("s_name", F.lit(" | n"), "nation", F.lit(".example")))
            ),
            "\n",
        ).alias("companies"),
        F.array_join(
            F.array_sort(
                F.collect_list(
                    F.concat(
                        "s_name",
                        F.lit(" | AFFILIATED/subsidiary | Nation "),
                        "nation",
                        F.when(F.col("s_suppkey") % 2 == 0, " | told by hand").otherwise(""),
                    )
                )
            ),
            "\n",
        ).alias("facts"),
        F.array_join(
            F.array_sort(
                F.collect_list(
                    F.concat("s_name", F.lit(" | Supp "), "s_suppkey", F.lit(" | S"), "s_suppkey")
                )
            ),
            "\n",
        ).alias("aliases"),
    )
    return told.select(
        F.concat(
            F.lit("# Seed\n\n## companies\n"),
            "companies",
            F.lit("\n\n## projects\nNation "),
            "nation",
            F.lit("\n\n## facts\n"),
            "facts",
            F.lit("\n\n## aliases\n"),
            "aliases",
            F.lit("\n"),
        ).alias("raw")
    )


@query(
    "seed_entities",
    "SRC2 WN7",
    """SELECT s_name AS name, 'company' AS type, 'n' || s_nationkey || '.example' AS domain,
      s_name AS canonical_name FROM supplier
    UNION ALL SELECT 'Supp ' || s_suppkey, 'company', NULL, s_name FROM supplier
    UNION ALL SELECT 'S' || s_suppkey, 'company', NULL, s_name FROM supplier
    UNION ALL SELECT 'Nation ' || s_nationkey, 'project', NULL, 'Nation ' || s_nationkey
      FROM (SELECT DISTINCT s_nationkey, s_suppkey // 20 FROM supplier)""",
)
def _seed_entities(t: Tables):
    made = files.seed_entities(files.seed_lines(_seed_lines(t)))
    return made.select("name", "type", "domain", "canonical_name")


@query(
    "seed_facts",
    "SRC2 WN7",
    """SELECT s_name AS from_entity, 'AFFILIATED' AS edge_label, 'subsidiary' AS fact_type,
      'Nation ' || s_nationkey AS to_entity, CASE WHEN s_suppkey % 2 = 0 THEN 'told by hand'
        ELSE s_name || ' is a subsidiary of Nation ' || s_nationkey END AS fact FROM supplier""",
)
def _seed_facts(t: Tables):
    made = files.seed_facts(files.seed_lines(_seed_lines(t)))
    return made.select("from_entity", "edge_label", "fact_type", "to_entity", "fact")


# -- vectors ----------------------------------------------------------------------------------


def _vectors(t: Tables):
    return t.raw("embeddings").select(
        F.concat(F.lit("document_"), "vec_id").alias("record_id"), "embedding", "label"
    )


def _probe(t: Tables) -> list[float]:
    return list(t.raw("embeddings").filter("vec_id = 0").first().embedding)


SCORE = (
    "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), "
    "CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))"
)


@query(
    "vector_search",
    "TK3",
    f"""SELECT 'document_' || vec_id AS record_id, label, round({SCORE}, 6) AS score
    FROM embeddings e ORDER BY {SCORE} DESC, 'document_' || vec_id LIMIT 5""",
)
def _vector_search(t: Tables):
    found = vectors.vector_search(_vectors(t), _probe(t), 5)
    return found.withColumn("score", F.round("score", 6))


@query(
    "vector_search_many",
    "TK3 TK4",
    """SELECT query_id, rank, record_id, round(score, 6) AS score FROM (
      SELECT 'q' || q.vec_id AS query_id, 'document_' || e.vec_id AS record_id, score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, 'document_' || e.vec_id) AS rank
      FROM embeddings q JOIN LATERAL (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]),
        CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings) e ON true) WHERE rank <= 5""",
)
def _vector_search_many(t: Tables):
    """Every vector as a query, with all lists probed: the exact result of all in one plan."""
    index = ivf.build(_vectors(t).drop("label"))
    found = ivf.search_many(index, _asked(t), 5, probes=len(index.centres))
    return found.withColumn("score", F.round("score", 6))


def _asked(t: Tables):
    return t.raw("embeddings").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), "embedding")


@query(
    "vector_recall",
    "TK3 TK4",
    """SELECT count(*) AS queries, 5 * count(*) AS pairs, true AS enough FROM embeddings""",
)
def _vector_recall(t: Tables):
    """The indexed search against the exact one: the share of its pairs that are found."""
    index = ivf.build(_vectors(t).drop("label"))
    lists = len(index.centres)
    exact = ivf.search_many(index, _asked(t), 5, probes=lists)
    found = ivf.search_many(index, _asked(t), 5, probes=max(1, lists * 3 // 4))
    return ivf.recall(found, exact).select("queries", "pairs", (F.col("recall") >= 0.95).alias("enough"))


@query(
    "search",
    "TK4 JN5",
    f"""SELECT r.record_id, r.source, r.classification, left(r.content, 300) AS snippet,
      round({SCORE}, 6) AS score
    FROM embeddings e JOIN records r ON r.record_id = 'document_' || e.vec_id
    WHERE r.type = 'document' AND contains(lower(r.source), 'src1')
      AND r.created_at >= TIMESTAMP '2023-06-01'
    ORDER BY {SCORE} DESC, r.record_id LIMIT 10""",
)
def _search_vectors(t: Tables):
    found = vectors.search(
        _vectors(t), t.records(), _probe(t), record_type="document", source="src1", since="2023-06-01"
    )
    return found.select(
        "record_id", "source", "classification", "snippet", F.round("score", 6).alias("score")
    )


@query(
    "upsert_points",
    "SNK3",
    """SELECT 'document_' || vec_id AS record_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END
      AS state, len(embedding) AS dims FROM embeddings""",
)
def _upsert_points(t: Tables):
    v = _vectors(t).withColumns(
        {
            "content": F.lit(""),
            "type": F.lit("document"),
            "source": F.lit("old"),
            "metadata": F.expr("cast(map() as map<string,string>)"),
        }
    )
    n = F.split_part("record_id", F.lit("_"), F.lit(2)).cast("long")
    fresh = v.filter(n % 3 == 0).withColumn("source", F.lit("new"))
    done = vectors.upsert_points(vectors.points(v), vectors.points(fresh))
    return done.select(
        "record_id", F.col("payload")["source"].alias("state"), F.size("embedding").alias("dims")
    )


@query(
    "schema_versions",
    "SRC12 SRC14",
    """SELECT p_brand AS source, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1""",
)
def _schema_versions(t: Tables):
    fingerprint = schema_fingerprint(RECORD_TYPES["github_pr"])
    rows = t.raw("part").select(
        F.col("p_brand").alias("source"),
        F.concat_ws("_", "p_brand", "p_type", F.lit(fingerprint)).alias("table_name"),
    )
    return (
        typed.all_typed_tables(rows)
        .withColumn("source", F.split_part("table_name", F.lit("_"), F.lit(1)))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_types"))
    )
