"""The views of `sources.tables` in SQL, for checking results in a second engine."""

from __future__ import annotations

import re

VIEWS = {
    "entities": """
  SELECT 'person:' || c_custkey AS entity_id, 'person' AS entity_type, c_name AS name,
         lower(c_name) || '@n' || c_nationkey || '.example' AS email, NULL AS domain,
         TIMESTAMP '1992-01-01' AS created_at FROM customer
  UNION ALL SELECT 'company:' || s_suppkey, 'company', s_name, NULL,
         'n' || s_nationkey || '.example', TIMESTAMP '1992-01-01' FROM supplier
  UNION ALL SELECT 'project:' || p_partkey, 'project', p_name, NULL, NULL,
         TIMESTAMP '1992-01-01' FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, NULL, NULL,
         TIMESTAMP '1992-01-01' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name, NULL, NULL,
         TIMESTAMP '1992-01-01' FROM region""",
    "aliases": """
  SELECT entity_id,
         CASE entity_type WHEN 'person' THEN 'Cust ' || (num % 400)
              WHEN 'company' THEN 'Supp ' || num ELSE name || ' ' || (num % 900) END AS surface_form,
         CASE WHEN num % 2 = 0 THEN 'stated' ELSE 'inferred' END AS confidence,
         'order_' || num AS source_record, 'order' AS source_type
  FROM (SELECT *, CAST(split_part(entity_id, ':', 2) AS BIGINT) AS num FROM entities
        WHERE entity_type IN ('person', 'company', 'project'))""",
    "commitments": """
  SELECT 'c:' || o_orderkey AS edge_id, 'person:' || o_custkey AS from_id,
         CAST(NULL AS VARCHAR) AS to_id, CAST(o_orderdate AS DATE) AS to_day,
         'ASSERTED' AS edge_label, 'commitment' AS fact_type, o_orderpriority AS fact,
         CASE WHEN o_orderkey % 3 = 0 THEN 'inferred' ELSE 'stated' END AS confidence,
         'order_' || o_orderkey AS source_record, 'order' AS source_type,
         o_orderdate AS source_at, o_orderdate + to_days(CAST(o_orderkey % 5 AS INT)) AS recorded_at,
         FALSE AS stale, CAST(NULL AS VARCHAR) AS replaced_by,
         CAST(o_orderdate AS DATE) + 30 AS valid_until, 'intention' AS op_area FROM orders""",
    "completions": """
  SELECT 't:' || o_orderkey AS edge_id, 'person:' || o_custkey AS from_id,
         CAST(NULL AS VARCHAR) AS to_id, CAST(o_orderdate AS DATE) AS to_day,
         'TRANSITIONED' AS edge_label, 'completion' AS fact_type,
         'order ' || o_orderkey || ' completed' AS fact, 'stated' AS confidence,
         'order_' || o_orderkey AS source_record, 'order' AS source_type,
         o_orderdate AS source_at, o_orderdate + to_days(CAST(o_orderkey % 7 AS INT)) AS recorded_at,
         FALSE AS stale, CAST(NULL AS VARCHAR) AS replaced_by,
         CAST(NULL AS DATE) AS valid_until, 'reality' AS op_area
  FROM orders WHERE o_orderstatus = 'F'""",
    "contributions": """
  SELECT 'l:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey
           || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) || ':' || date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))
           AS edge_id,
         'company:' || l_suppkey AS from_id, 'project:' || l_partkey AS to_id,
         CAST(NULL AS DATE) AS to_day, 'AFFILIATED' AS edge_label, 'contributor' AS fact_type,
         'contributes ' || l_linestatus || l_returnflag AS fact,
         CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'stated' END AS confidence,
         'order_' || l_orderkey AS source_record, 'order' AS source_type,
         l_shipdate AS source_at, l_shipdate + to_days(CAST(l_linenumber AS INT)) AS recorded_at,
         FALSE AS stale, CAST(NULL AS VARCHAR) AS replaced_by,
         CAST(NULL AS DATE) AS valid_until, 'reality' AS op_area FROM lineitem""",
    "geography": """
  SELECT edge_id, from_id, to_id, CAST(NULL AS DATE) AS to_day, 'AFFILIATED' AS edge_label,
         fact_type, fact, 'stated' AS confidence, 'seed' AS source_record,
         'ingest' AS source_type, TIMESTAMP '1992-01-01' AS source_at,
         TIMESTAMP '1992-01-01' AS recorded_at, FALSE AS stale,
         CAST(NULL AS VARCHAR) AS replaced_by, CAST(NULL AS DATE) AS valid_until,
         'reality' AS op_area
  FROM (SELECT 'k:' || c_custkey AS edge_id, 'person:' || c_custkey AS from_id,
               'nation:' || c_nationkey AS to_id, 'stakeholder' AS fact_type,
               'stakeholder of nation' AS fact FROM customer
        UNION ALL SELECT 's:' || s_suppkey, 'company:' || s_suppkey, 'nation:' || s_nationkey,
               'subsidiary', 'subsidiary of nation' FROM supplier
        UNION ALL SELECT 'n:' || n_nationkey, 'nation:' || n_nationkey, 'region:' || n_regionkey,
               'sub_project', 'sub_project of region' FROM nation)""",
    "facts": """
  SELECT * FROM commitments UNION ALL SELECT * FROM completions
  UNION ALL SELECT * FROM contributions UNION ALL SELECT * FROM geography""",
    "case_facts": """
  SELECT prefix || o_orderkey AS edge_id, 'person:' || o_custkey AS from_id,
         CAST(NULL AS VARCHAR) AS to_id, CAST(o_orderdate AS DATE) AS to_day, edge_label,
         fact_type, fact_type || ' on order ' || o_orderkey AS fact, 'stated' AS confidence,
         'order_' || o_orderkey AS source_record, 'order' AS source_type,
         o_orderdate AS source_at, o_orderdate AS recorded_at, FALSE AS stale,
         CAST(NULL AS VARCHAR) AS replaced_by, CAST(NULL AS DATE) AS valid_until,
         'reality' AS op_area
  FROM (SELECT *, 'b:' AS prefix, 'ASSERTED' AS edge_label, 'blocker' AS fact_type
        FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT *, 'r:', 'TRANSITIONED', 'resolution'
        FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 10 = 0
        UNION ALL SELECT *, 'f:', 'ASSERTED', 'reference'
        FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 10 = 1)""",
    "fact_sources": """
  SELECT 'l:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey
           || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) || ':' || date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))
           AS edge_id, 'order_' || l_orderkey AS record_id,
         CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'stated' END AS confidence
  FROM lineitem
  UNION ALL
  SELECT 'l:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey
           || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) || ':' || date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)),
         'order_' || (l_orderkey + 1),
         CASE WHEN l_partkey % 8 = 0 THEN 'stated' ELSE 'inferred' END
  FROM lineitem WHERE l_partkey % 4 = 0""",
    "records": """
  SELECT 'document_' || doc_id AS record_id, 'document' AS type, source,
         TIMESTAMP '2024-01-01' AS created_at, text AS content, lang, CAST(NULL AS VARCHAR) AS k,
         md5(text) AS dedup_key, 'documents' AS expert_name, '0.1.0' AS expert_version,
         doc_id % 3 = 0 AS indexed,
         CASE WHEN doc_id % 5 = 0 THEN 'noise' WHEN doc_id % 5 <> 1 THEN 'relevant' END
           AS classification, text AS raw,
         CASE WHEN doc_id % 4 = 0 THEN 'written in ' || lang END AS human_context FROM documents
  UNION ALL
  SELECT 'event_' || event_id, event_type, 'user_' || user_id, ts, '', NULL,
         json_extract_string(props, '$.k'), NULL, 'events', '0.2.0', FALSE,
         CASE WHEN event_type = 'error' THEN 'noise' ELSE 'relevant' END, props, CAST(NULL AS VARCHAR) FROM events""",
    "mail": """
  SELECT 'm' || conv_id || '-' || turn AS message_id, 'ses_' || conv_id AS thread_id,
         CASE WHEN pick % 13 = 5 THEN 'No-Reply@shop.example'
              ELSE lower(s.c_name) || '@n' || s.c_nationkey || '.example' END AS sender,
         r.c_name || ' <' || lower(r.c_name) || '@n' || r.c_nationkey || '.example>' AS recipients,
         left(replace(text, chr(10), ' '), 40) AS subject, text AS body,
         strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000),
                  '%Y-%m-%dT%H:%M:%SZ') AS received_at,
         CASE WHEN turn % 7 = 5 THEN 'bulk' ELSE '' END AS precedence
  FROM (SELECT *, conv_id * 31 + turn * 7 AS pick FROM conversations) c
  JOIN customer s ON s.c_custkey = c.pick % (SELECT max(c_custkey) + 1 FROM customer)
  JOIN customer r ON r.c_custkey = (c.pick + 11) % (SELECT max(c_custkey) + 1 FROM customer)""",
    "messages": """
  SELECT 'ses_' || conv_id AS session_id, turn AS seq,
         CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'human' END AS from_agent,
         CASE WHEN role = 'assistant' THEN 'human' ELSE 'assistant' END AS to_agent,
         text AS content, turn < 2 AS read,
         make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000) AS created_at
  FROM conversations""",
    "model_calls": """
  SELECT 'call_' || conv_id || '_' || turn AS call_id,
         make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000) AS created_at,
         'rt_' || (conv_id % 9) AS runtime_id,
         CASE WHEN conv_id % 3 = 0 THEN 'triage' ELSE 'extraction' END AS consumer,
         'run_' || conv_id AS run_id, turn AS turn_index,
         CASE conv_id % 4 WHEN 0 THEN 'm-small' WHEN 1 THEN 'm-large' WHEN 2 THEN 'm-mid'
              ELSE 'm-unpriced' END AS model,
         CASE WHEN role = 'assistant' THEN 'stop' ELSE 'tool_calls' END AS finish_reason,
         'prompt ' || (conv_id % 12) AS prompt,
         CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END AS input_tokens,
         CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS output_tokens,
         CAST(0 AS BIGINT) AS cache_creation_tokens, CAST(0 AS BIGINT) AS cache_read_tokens,
         CASE WHEN conv_id % 2 = 0 THEN 'order_' || conv_id END AS record_id,
         CASE WHEN conv_id % 2 <> 0 THEN 'ses_' || conv_id END AS session_id
  FROM conversations""",
    "prices": """
  SELECT * FROM (VALUES ('m-small', 0.25::DOUBLE, 2.0::DOUBLE, 0.25::DOUBLE, 0.025::DOUBLE),
                        ('m-mid', 1.0, 5.0, 1.25, 0.1), ('m-large', 3.0, 15.0, 3.75, 0.3))
    AS p(model, input, output, cache_write, cache_read)""",
    "priced": """
  SELECT c.*, (c.input_tokens * p.input + c.output_tokens * p.output
               + c.cache_creation_tokens * p.cache_write
               + c.cache_read_tokens * p.cache_read) / 1000000 AS cost
  FROM model_calls c LEFT JOIN prices p USING (model)""",
    "ex_base": """
  SELECT 'line_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey
           AS record_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name,
         s_nationkey, l_linenumber % 2 = 0 AS even, l_orderkey % 50 AS mark,
         CASE WHEN l_linenumber % 2 = 0 THEN 'the ' || p_name ELSE p_name END AS pname2,
         s_name || ' supplies ' || p_name || '; '
           || CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS content
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""",
    "ex_entities": """
  SELECT record_id, s_name AS name, 'company' AS type, 'n' || s_nationkey || '.example' AS domain,
         'new' AS resolved_to, s_name AS canonical_name, even FROM ex_base
  UNION ALL
  SELECT record_id, pname2, 'project', NULL,
         CASE WHEN mark = 7 THEN 'project:-1' WHEN even THEN 'project:' || l_partkey ELSE 'new' END,
         p_name, even FROM ex_base""",
    "ex_facts": """
  SELECT record_id, content, even, mark, 0 AS pos,
         CASE WHEN mark = 11 THEN 'CLAIMED' ELSE 'AFFILIATED' END AS edge_label,
         'contributor' AS fact_type, s_name || ' supplies ' || p_name AS fact,
         s_name AS from_entity, CASE WHEN mark = 13 THEN 'Nobody' ELSE pname2 END AS to_entity,
         CASE WHEN even THEN 'inferred' ELSE 'stated' END AS confidence,
         CAST(NULL AS VARCHAR) AS valid_until FROM ex_base
  UNION ALL
  SELECT record_id, content, even, mark, 1, 'ASSERTED',
         CASE WHEN mark = 17 THEN 'pledge' ELSE 'commitment' END,
         CASE WHEN mark = 19 THEN 'something else entirely was said here'
              ELSE s_name || ' will deliver ' || p_name END,
         CASE WHEN mark = 23 THEN 'Somebody' ELSE s_name END, NULL, 'stated', '1998-06-30'
  FROM ex_base""",
}


def with_views(sql: str) -> str:
    """`sql` with the views it uses, and those they use, put in front of it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
