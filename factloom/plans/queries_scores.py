"""Usage and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import evaluate, usage
from factloom.operators import facts as fq
from factloom.plans.catalog import query
from factloom.sources.tables import Tables

SEC = "'%Y-%m-%d %H:%M:%S'"


def _priced(t: Tables):
    return usage.priced(t.model_calls(), t.prices())


@query(
    "call_cost",
    "JN10 SRC17",
    "SELECT call_id, model, round(cost, 9) AS cost FROM priced",
)
def _cost(t: Tables):
    return _priced(t).select("call_id", "model", F.round("cost", 9).alias("cost"))


TOTALS = (
    "count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, "
    "CAST(sum(output_tokens) AS BIGINT) AS output_tokens, "
    "round(coalesce(sum(cost), 0), 6) AS cost, bool_and(cost IS NOT NULL) AS priced"
)


MODELS = sorted(usage.PRICES)
LIST_PRICES = ", ".join(f"('{m}', " + ", ".join(f"{x}::DOUBLE" for x in usage.PRICES[m]) + ")" for m in MODELS)


@query(
    "normalised_calls",
    "SRC17 JN10 AG2",
    f"""WITH list AS (SELECT * FROM (VALUES {LIST_PRICES}) AS p(model, input, output, cache_write, cache_read)),
      names AS (SELECT {MODELS} AS m),
      calls AS (SELECT c.* EXCLUDE (model, finish_reason, cache_read_tokens), m[turn_index % {len(MODELS)} + 1] AS model,
        CASE WHEN finish_reason = 'stop' THEN 'end_turn' ELSE 'tool_use' END AS stop_reason,
        input_tokens // 3 AS cached FROM model_calls c, names)
    SELECT CASE WHEN starts_with(model, 'claude') THEN 'anthropic' ELSE 'openai' END AS provider, model, stop_reason,
      count(*) AS calls, CAST(sum(fresh) AS BIGINT) AS fresh_tokens, CAST(sum(cached) AS BIGINT) AS cached_tokens,
      round(sum((fresh * input + output_tokens * output + cached * cache_read) / 1000000), 9) AS cost
    FROM (SELECT *, CASE WHEN starts_with(model, 'claude') THEN input_tokens ELSE input_tokens - cached END AS fresh
      FROM calls) JOIN list USING (model) GROUP BY ALL""",
)
def _normalised_calls(t: Tables):
    """Calls of the listed models by provider: fresh input, cached input, and what both cost."""
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("turn_index") % len(MODELS) + 1).cast("int"))
    cached = F.floor(F.col("input_tokens") / 3)
    raw = t.model_calls().withColumns({"model": model, "cache_read_tokens": cached})
    calls = usage.normalised_calls(raw).withColumn("input_tokens", F.col("fresh_tokens"))
    done = usage.priced(calls, usage.price_table(t.spark))
    return done.groupBy("provider", "model", "stop_reason").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("fresh_tokens").alias("fresh_tokens"),
        F.sum("cache_read_tokens").alias("cached_tokens"),
        F.round(F.sum("cost"), 9).alias("cost"),
    )


@query(
    "usage_summary",
    "AG2",
    f"""SELECT 'model' AS level, model, {TOTALS} FROM priced GROUP BY model
    UNION ALL SELECT 'total', NULL, {TOTALS} FROM priced""",
)
def _summary(t: Tables):
    return (
        usage.usage_summary(_priced(t))
        .withColumn("cost", F.round("cost", 6))
        .select("level", "model", "calls", "input_tokens", "output_tokens", "cost", "priced")
    )


@query(
    "usage_filtered",
    "FLT22 AG2",
    f"""SELECT model, {TOTALS} FROM priced WHERE consumer = 'extraction'
      AND runtime_id IN ('rt_1', 'rt_2', 'rt_4') AND created_at >= TIMESTAMP '2024-01-01 06:00:00'
      AND created_at < TIMESTAMP '2024-01-04' GROUP BY model""",
)
def _filtered(t: Tables):
    kept = usage.usage_filter(
        _priced(t),
        consumer="extraction",
        runtime_ids=["rt_1", "rt_2", "rt_4"],
        since="2024-01-01 06:00:00",
        until="2024-01-04",
    )
    return (
        usage.usage_summary(kept)
        .filter("level = 'model'")
        .withColumn("cost", F.round("cost", 6))
        .select("model", "calls", "input_tokens", "output_tokens", "cost", "priced")
    )


@query(
    "unpriced_models",
    "AG2 JN10",
    "SELECT DISTINCT model FROM priced WHERE cost IS NULL",
)
def _unpriced(t: Tables):
    return usage.unpriced_models(_priced(t))


@query(
    "usage_by_record",
    "AG3",
    """SELECT coalesce(record_id, session_id) AS key,
      CASE WHEN max(record_id) IS NOT NULL THEN 'record_id' ELSE 'session_id' END AS kind,
      count(*) AS turns, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
      CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
      round(coalesce(sum(cost), 0), 6) AS cost, bool_and(cost IS NOT NULL) AS cost_known,
      string_agg(DISTINCT model, ',' ORDER BY model) AS models
    FROM priced GROUP BY 1""",
)
def _by_record(t: Tables):
    return (
        usage.usage_by_record(_priced(t))
        .withColumn("cost", F.round("cost", 6))
        .select(
            "key", "kind", "turns", "input_tokens", "output_tokens", "cost", "cost_known", "models"
        )
    )


@query(
    "latest_runtime",
    "FLT23",
    """SELECT runtime_id FROM model_calls WHERE consumer = 'extraction'
    ORDER BY created_at DESC, runtime_id DESC LIMIT 1""",
)
def _latest(t: Tables):
    return usage.latest_runtime(t.model_calls())


@query(
    "token_totals",
    "AG5",
    """SELECT record_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
      CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
      CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens
    FROM model_calls WHERE record_id IS NOT NULL GROUP BY ROLLUP (record_id)""",
)
def _tokens(t: Tables):
    return usage.token_totals(t.model_calls())


@query(
    "prompt_dedup",
    "AG9",
    f"""SELECT sha256(prompt) AS prompt_hash, strftime(min(created_at), {SEC}) AS first_seen,
      min(prompt) AS prompt, count(*) AS uses FROM model_calls GROUP BY 1""",
)
def _prompts(t: Tables):
    return usage.prompt_dedup(t.model_calls())


@query(
    "turn_ceiling",
    "WN5",
    """SELECT call_id, CASE WHEN back = 1 AND capped THEN 'turn_ceiling'
        WHEN finish_reason = 'stop' THEN 'end_turn' ELSE 'tool_use' END AS stop_reason
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn_index DESC) AS back,
      max(turn_index) OVER (PARTITION BY run_id) >= 6 AS capped FROM model_calls)""",
)
def _ceiling(t: Tables):
    calls = usage.normalised_calls(t.model_calls())
    capped = calls.groupBy("run_id").agg(F.max("turn_index").alias("n")).filter("n >= 6")
    return usage.mark_turn_ceiling(calls, capped).select("call_id", "stop_reason")


@query(
    "turns_per_run",
    "WN6",
    """SELECT call_id, turn_index, CAST(sum(input_tokens) OVER w AS BIGINT) AS running_input_tokens,
      CAST(sum(output_tokens) OVER w AS BIGINT) AS running_output_tokens FROM model_calls
    WINDOW w AS (PARTITION BY run_id ORDER BY turn_index ROWS UNBOUNDED PRECEDING)""",
)
def _turns(t: Tables):
    return usage.turns_per_run(t.model_calls()).select(
        "call_id", "turn_index", "running_input_tokens", "running_output_tokens"
    )


# -- evaluation inputs ------------------------------------------------------------------------
# Expected facts come from orders; extracted ones are the same with planted mistakes by order key.


def _truth(t: Tables):
    o = t.raw("orders").join(
        t.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey"
    )
    none = F.lit(None).cast("string")
    common = [
        F.concat(F.lit("order_"), "o_orderkey").alias("record_id"),
        F.col("o_orderkey").alias("k"),
        F.col("c_name").alias("from_entity"),
    ]
    due = F.date_add(F.to_date("o_orderdate"), 30).cast("string")
    told = o.select(
        *common,
        F.lit("ASSERTED").alias("edge_label"),
        F.lit("commitment").alias("fact_type"),
        none.alias("to_entity"),
        F.lit("stated").alias("confidence"),
        due.alias("valid_until"),
        F.col("o_orderdate").alias("source_at"),
    )
    placed = o.filter("o_orderstatus = 'F'").select(
        *common,
        F.lit("AFFILIATED").alias("edge_label"),
        F.lit("stakeholder").alias("fact_type"),
        F.concat(F.lit("Order "), "o_orderkey").alias("to_entity"),
        F.lit("stated").alias("confidence"),
        none.alias("valid_until"),
        F.col("o_orderdate").alias("source_at"),
    )
    return told.unionByName(placed)


def _found(t: Tables):
    k = F.col("k")
    kept = _truth(t).filter(k % 10 != 3)
    wrong = kept.withColumns(
        {
            "fact_type": F.when((k % 10 == 5) & (F.col("edge_label") == "ASSERTED"), "promise").otherwise(
                F.col("fact_type")
            ),
            "from_entity": F.when(k % 2 == 0, F.upper("from_entity")).otherwise(F.col("from_entity")),
            "confidence": F.when(k % 4 == 0, "inferred").otherwise(F.col("confidence")),
        }
    )
    return wrong.withColumn("copy", F.explode(F.when(k % 10 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


TRUTH = """truth AS (
    SELECT 'order_' || o_orderkey AS record_id, o_orderkey AS k, c_name AS from_entity,
      'ASSERTED' AS edge_label, 'commitment' AS fact_type, CAST(NULL AS VARCHAR) AS to_entity,
      'stated' AS confidence FROM orders JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT 'order_' || o_orderkey, o_orderkey, c_name, 'AFFILIATED', 'stakeholder',
      'Order ' || o_orderkey, 'stated' FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus = 'F'),
  found AS (SELECT record_id, k, from_entity, edge_label,
      CASE WHEN k % 10 = 5 AND edge_label = 'ASSERTED' THEN 'promise' ELSE fact_type END
        AS fact_type, to_entity,
      CASE WHEN k % 4 = 0 THEN 'inferred' ELSE confidence END AS confidence
    FROM truth, (SELECT unnest([0, 1]) AS copy) WHERE k % 10 <> 3 AND (copy = 0 OR k % 10 = 7))"""
KEYED = """want AS (SELECT lower(edge_label) AS a, lower(fact_type) AS b, lower(from_entity) AS c,
    lower(coalesce(to_entity, '')) AS d, count(*) AS n FROM truth GROUP BY 1, 2, 3, 4),
  got AS (SELECT lower(edge_label) AS a, lower(fact_type) AS b, lower(from_entity) AS c,
    lower(coalesce(to_entity, '')) AS d, count(*) AS n FROM found GROUP BY 1, 2, 3, 4)"""


@query(
    "fact_scores",
    "EV1 EV7 JN12 ST1 ST2",
    f"""WITH {TRUTH}, {KEYED}, s AS (SELECT
        (SELECT count(*) FROM want JOIN got USING (a, b, c, d)) AS matched,
        (SELECT count(*) FROM truth) AS expected, (SELECT count(*) FROM found) AS extracted,
        (SELECT count(*) FROM want ANTI JOIN got USING (a, b, c, d)) AS missing,
        (SELECT count(*) FROM got ANTI JOIN want USING (a, b, c, d)) AS extra)
    SELECT matched, expected, extracted, missing, extra,
      round(matched / extracted, 6) AS precision, round(matched / expected, 6) AS recall,
      round(2.0 * matched / (expected + extracted), 6) AS f1 FROM s""",
)
def _scores(t: Tables):
    scored = evaluate.fact_scores(_truth(t), _found(t))
    return scored.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "fact_matches",
    "JN12",
    f"""WITH {TRUTH}, {KEYED} SELECT a AS edge_label, b AS fact_type, c AS from_entity,
      d AS to_entity, coalesce(w.n, 0) AS n_expected, coalesce(g.n, 0) AS n_extracted,
      CASE WHEN g.n IS NULL THEN 'missing' WHEN w.n IS NULL THEN 'extra' ELSE 'matched' END
        AS outcome FROM want w FULL JOIN got g USING (a, b, c, d)""",
)
def _matches(t: Tables):
    return evaluate.fact_matches(_truth(t), _found(t))


@query(
    "matched_keys",
    "ST1",
    f"""WITH {TRUTH}, {KEYED} SELECT DISTINCT b AS fact_type, c AS from_entity
    FROM (SELECT b, c FROM want INTERSECT SELECT b, c FROM got)""",
)
def _matched(t: Tables):
    return evaluate.matched_keys(_truth(t), _found(t), ["fact_type", "from_entity"])


@query(
    "missing_keys",
    "ST2",
    f"""WITH {TRUTH} SELECT DISTINCT lower(to_entity) AS to_entity FROM truth
    WHERE to_entity IS NOT NULL AND lower(to_entity) NOT IN
      (SELECT lower(to_entity) FROM found WHERE to_entity IS NOT NULL)""",
)
def _missing(t: Tables):
    return evaluate.missing_keys(_truth(t), _found(t), ["to_entity"])


MATCHED = """counts AS (SELECT record_id, edge_label, fact_type, lower(from_entity) AS c,
      lower(coalesce(to_entity, '')) AS d, count(*) FILTER (side = 'w') AS w,
      count(*) FILTER (side = 'g') AS g
    FROM (SELECT 'w' AS side, record_id, edge_label, fact_type, from_entity, to_entity FROM truth
      UNION ALL SELECT 'g', record_id, edge_label, fact_type, from_entity, to_entity FROM found)
    GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "match_facts",
    "EV6 ST3",
    f"""WITH {TRUTH}, {MATCHED} SELECT record_id, CAST(sum(least(w, g)) AS BIGINT) AS fact_matched,
      CAST(sum(g) AS BIGINT) AS fact_extracted, CAST(sum(w) AS BIGINT) AS fact_expected
    FROM counts GROUP BY record_id""",
)
def _match_facts(t: Tables):
    return evaluate.match_facts(_found(t), _truth(t))


@query(
    "per_label_counts",
    "AG10",
    f"""WITH {TRUTH}, {MATCHED} SELECT record_id, edge_label,
      CAST(sum(least(w, g)) AS BIGINT) AS fact_matched, CAST(sum(g) AS BIGINT) AS fact_extracted,
      CAST(sum(w) AS BIGINT) AS fact_expected FROM counts GROUP BY record_id, edge_label""",
)
def _label_counts(t: Tables):
    return evaluate.match_facts(_found(t), _truth(t), by_label=True)


@query(
    "confidence_mismatches",
    "EV10",
    f"""WITH {TRUTH} SELECT record_id, edge_label, lower(from_entity) AS from_entity,
      'inferred' AS extracted_confidence, 'stated' AS expected_confidence,
      count(*) AS warnings FROM found WHERE confidence = 'inferred' AND fact_type <> 'promise'
    GROUP BY ALL""",
)
def _mismatches(t: Tables):
    found = evaluate.confidence_mismatches(_found(t), _truth(t))
    return found.select(
        "record_id",
        "edge_label",
        "from_entity",
        "extracted_confidence",
        "expected_confidence",
        "warnings",
    )


def _expected_entities(t: Tables):
    o = t.raw("orders").join(
        t.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey"
    )
    record = F.concat(F.lit("order_"), "o_orderkey").alias("record_id")
    k = F.col("o_orderkey").alias("k")
    person = o.select(
        record,
        k,
        F.lit(0).alias("position"),
        F.col("c_name").alias("name"),
        F.lit("person").alias("type"),
        F.concat(F.lit("Cust "), "o_custkey").alias("alias"),
    )
    event = o.select(
        record,
        k,
        F.lit(1).alias("position"),
        F.concat(F.lit("Order "), "o_orderkey").alias("name"),
        F.lit("event").alias("type"),
        F.lit(None).cast("string").alias("alias"),
    )
    return person.unionByName(event)


def _extracted_entities(t: Tables):
    k = F.col("k")
    kept = _expected_entities(t).filter(k % 10 != 3)
    return kept.select(
        "record_id",
        "k",
        F.when(k % 3 == 0, F.upper(F.coalesce("alias", "name"))).otherwise(F.col("name")).alias("name"),
        F.when((k % 7 == 0) & (F.col("position") == 0), "company")
        .otherwise(F.initcap("type"))
        .alias("type"),
    )


ENTITY_MATCH = """ents AS (SELECT 'order_' || o_orderkey AS record_id, o_orderkey AS k,
    2 AS entity_expected, CASE WHEN o_orderkey % 10 = 3 THEN 0 ELSE 2 END AS entity_extracted,
    CASE WHEN o_orderkey % 10 = 3 THEN 0 WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END
      AS entity_matched FROM orders)"""


@query(
    "match_entities",
    "EV5",
    f"""WITH {ENTITY_MATCH} SELECT record_id, entity_matched, entity_extracted, entity_expected
    FROM ents""",
)
def _match_entities(t: Tables):
    return evaluate.match_entities(_extracted_entities(t), _expected_entities(t))


def _score_records(t: Tables):
    records = t.raw("orders").select(
        F.concat(F.lit("order_"), "o_orderkey").alias("record_id"),
        (F.col("o_orderkey") % 20 == 3).alias("is_noise"),
    )
    return evaluate.score_records(
        records, _extracted_entities(t), _expected_entities(t), _found(t), _truth(t)
    )


@query(
    "score_records",
    "EV10 EV7 AG10",
    f"""WITH {TRUTH}, {MATCHED}, {ENTITY_MATCH}, per AS (SELECT record_id, sum(least(w, g)) AS m,
        sum(g) AS g, sum(w) AS w, coalesce(sum(g) FILTER (edge_label = 'AFFILIATED'), 0) AS ag
      FROM counts GROUP BY record_id)
    SELECT e.record_id, round(entity_matched / 2.0, 6) AS entity_recall,
      CASE WHEN entity_extracted = 0 THEN 1.0 ELSE round(entity_matched / 2.0, 6) END
        AS entity_precision,
      CASE WHEN g = 0 THEN 1.0 ELSE round(m / g, 6) END AS fact_precision,
      round(m / w, 6) AS fact_recall, CAST(ag AS BIGINT) AS affiliated_extracted,
      k % 20 = 3 AS noise_correctly_empty
    FROM ents e JOIN per USING (record_id)""",
)
def _score(t: Tables):
    scores = ("entity_recall", "entity_precision", "fact_precision", "fact_recall")
    return _score_records(t).select(
        "record_id",
        *[F.round(c, 6).alias(c) for c in scores],
        "affiliated_extracted",
        "noise_correctly_empty",
    )


@query(
    "noise_rejection",
    "EV8",
    """SELECT round(avg(CASE WHEN quality = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END
      END), 6) AS noise_rejection_rate FROM labels""",
)
def _noise(t: Tables):
    scored = t.raw("labels").select(
        (F.col("quality") == 0).alias("is_noise"),
        ((F.col("quality") == 0) & (F.col("doc_id") % 2 == 0)).alias("noise_correctly_empty"),
    )
    return evaluate.noise_rejection_rate(scored).select(
        F.round("noise_rejection_rate", 6).alias("noise_rejection_rate")
    )


# -- entity resolution ------------------------------------------------------------------------


def _forms(t: Tables):
    people = t.entities().filter("entity_type = 'person'")
    return fq.graph_entities(people, t.aliases())


def _expected_forms(t: Tables):
    k = F.col("c_custkey")
    return t.raw("customer").select(
        F.col("c_name").alias("canonical_name"),
        F.concat(F.lit("y"), F.lit(1993) + k % 5).alias("slice"),
        F.explode(
            F.array(
                F.upper("c_name"),
                F.concat(F.lit("CUST "), k % 400),
                F.when(k % 9 == 0, F.concat(F.lit("unknown "), k)),
            )
        ).alias("surface_form"),
    )


FORMS = """expected AS (SELECT c_name AS canonical_name, 'y' || (1993 + c_custkey % 5) AS slice,
      sf AS surface_form FROM (SELECT *, unnest([upper(c_name), 'CUST ' || (c_custkey % 400),
        CASE WHEN c_custkey % 9 = 0 THEN 'unknown ' || c_custkey END]) AS sf FROM customer)
      WHERE sf IS NOT NULL),
    forms AS (SELECT e.entity_id, e.name, a.surface_form AS alias FROM entities e
      LEFT JOIN aliases a ON a.entity_id = e.entity_id WHERE e.entity_type = 'person')"""
LOOKUP = """lookup AS (SELECT form, arg_max(name, entity_id || chr(1) || kind) AS resolved_to FROM (
      SELECT entity_id, name, 0 AS kind, lower(name) AS form FROM forms
      UNION ALL SELECT entity_id, name, 1, lower(alias) FROM forms WHERE alias IS NOT NULL)
      GROUP BY form),
    diag AS (SELECT x.*, l.resolved_to, CASE WHEN l.resolved_to IS NULL THEN 'not_found'
        WHEN lower(l.resolved_to) = lower(canonical_name) THEN 'correct' ELSE 'wrong' END AS outcome
      FROM expected x LEFT JOIN lookup l ON l.form = lower(surface_form))"""


@query(
    "er_diagnostics",
    "EV4",
    f"""WITH {FORMS}, {LOOKUP} SELECT canonical_name, surface_form, resolved_to, outcome
    FROM diag""",
)
def _er_diagnostics(t: Tables):
    return evaluate.er_diagnostics(_expected_forms(t), _forms(t))


@query(
    "er_scores",
    "EV2",
    f"""WITH {FORMS}, {LOOKUP}, per AS (SELECT canonical_name, count(*) AS n,
        count(*) FILTER (outcome = 'correct') AS c FROM diag GROUP BY 1),
      owners AS (SELECT lower(surface_form) AS form, max(lower(canonical_name)) AS canonical
        FROM expected GROUP BY 1),
      nodes AS (SELECT entity_id, count(DISTINCT canonical) AS n FROM (
        SELECT entity_id, lower(name) AS form FROM forms UNION ALL
        SELECT entity_id, lower(alias) FROM forms WHERE alias IS NOT NULL) JOIN owners USING (form)
        GROUP BY 1),
      s AS (SELECT (SELECT count(*) FROM per) AS want, (SELECT count(DISTINCT entity_id) FROM forms)
        AS have, (SELECT sum(n) FROM per) AS total, (SELECT sum(c) FROM per) AS correct,
        (SELECT count(*) FROM per WHERE n > 1) AS et, (SELECT count(*) FROM per WHERE n > 1
          AND n = c) AS ec, (SELECT count(*) FROM nodes) AS ft,
        (SELECT count(*) FROM nodes WHERE n > 1) AS fc)
    SELECT want AS node_count_expected, have AS node_count_actual,
      CAST(correct AS BIGINT) AS merge_recall_correct, CAST(total AS BIGINT) AS merge_recall_total,
      et AS entity_merge_total, ec AS entity_merge_correct, fc AS false_merge_count,
      ft AS false_merge_total, round(1.0 - abs(want - have) / greatest(want, 1), 6)
        AS node_count_accuracy, round(correct / total, 6) AS merge_recall,
      round(ec / et, 6) AS entity_merge_rate, round(fc / ft, 6) AS false_merge_rate FROM s""",
)
def _er_scores(t: Tables):
    rates = ("node_count_accuracy", "merge_recall", "entity_merge_rate", "false_merge_rate")
    scored = evaluate.er_scores(_expected_forms(t), _forms(t))
    return scored.withColumns({c: F.round(c, 6) for c in rates})


@query(
    "er_scores_timeslice",
    "EV3",
    f"""WITH {FORMS}, born AS MATERIALIZED (SELECT 'person:' || o_custkey AS entity_id,
        min(o_orderdate) AS first_at, 'd' || strftime(max(o_orderdate), '%Y%m%d') AS slice
        FROM orders GROUP BY 1),
      slices AS MATERIALIZED (SELECT DISTINCT 'd' || strftime(o_orderdate, '%Y%m%d') AS slice,
        date_trunc('day', o_orderdate) AS point FROM orders),
      wanted AS MATERIALIZED (SELECT x.canonical_name, x.surface_form, lower(x.surface_form) AS form, b.slice, s.point
        FROM expected x JOIN customer ON c_name = x.canonical_name
        JOIN born b ON b.entity_id = 'person:' || c_custkey JOIN slices s ON s.slice = b.slice),
      held AS MATERIALIZED (SELECT f.entity_id, f.name, kind, form, b.first_at FROM (
          SELECT entity_id, name, 0 AS kind, lower(name) AS form FROM forms
          UNION SELECT entity_id, name, 1, lower(alias) FROM forms WHERE alias IS NOT NULL) f
        JOIN born b USING (entity_id)),
      keyed AS (SELECT DISTINCT form, slice, point FROM wanted),
      lookup AS (SELECT k.slice, k.form, arg_max(h.name, h.entity_id || chr(1) || h.kind) AS resolved_to
        FROM keyed k JOIN held h ON h.form = k.form AND h.first_at <= k.point GROUP BY 1, 2),
      diag AS (SELECT w.slice, w.canonical_name,
          coalesce(lower(l.resolved_to) = lower(w.canonical_name), FALSE) AS good
        FROM wanted w LEFT JOIN lookup l ON l.slice = w.slice AND l.form = w.form),
      merges AS (SELECT slice, sum(n) AS total, sum(good) AS correct, count(*) FILTER (n > 1) AS many,
          count(*) FILTER (n > 1 AND n = good) AS merged
        FROM (SELECT slice, canonical_name, count(*) AS n, count(*) FILTER (good) AS good FROM diag
          GROUP BY 1, 2) GROUP BY 1),
      owners AS (SELECT slice, point, form, max(lower(canonical_name)) AS canonical FROM wanted GROUP BY 1, 2, 3),
      nodes AS (SELECT o.slice, h.entity_id, count(DISTINCT o.canonical) AS n FROM owners o
        JOIN held h ON h.form = o.form AND h.first_at <= o.point GROUP BY 1, 2),
      wrong AS (SELECT slice, count(*) AS total, count(*) FILTER (n > 1) AS bad FROM nodes GROUP BY 1),
      births AS (SELECT date_trunc('day', first_at) AS point, count(*) AS n FROM born
        WHERE entity_id IN (SELECT entity_id FROM forms) GROUP BY 1)
    SELECT s.slice, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM births b WHERE b.point <= s.point) AS node_count_actual,
      coalesce((SELECT count(DISTINCT canonical_name) FROM wanted w WHERE w.slice = s.slice), 0) AS node_count_expected,
      CAST(coalesce(m.total, 0) AS BIGINT) AS merge_recall_total,
      CAST(coalesce(m.correct, 0) AS BIGINT) AS merge_recall_correct,
      coalesce(m.many, 0) AS entity_merge_total, coalesce(m.merged, 0) AS entity_merge_correct,
      coalesce(w.total, 0) AS false_merge_total, coalesce(w.bad, 0) AS false_merge_count
    FROM slices s LEFT JOIN merges m USING (slice) LEFT JOIN wrong w USING (slice)""",
)
def _er_timeslice(t: Tables):
    """Every order day is a slice; a person is expected on the day of their last order."""
    o = t.raw("orders")
    day = F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyyMMdd"))
    slices = o.select(day.alias("slice"), F.date_trunc("day", "o_orderdate").alias("at")).distinct()
    born = o.groupBy(F.concat(F.lit("person:"), "o_custkey").alias("entity_id")).agg(
        F.min("o_orderdate").alias("recorded_at")
    )
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(day).alias("slice"))
    named = t.raw("customer").select("c_custkey", F.col("c_name").alias("canonical_name"))
    expected = _expected_forms(t).drop("slice").join(named.join(last, "c_custkey"), "canonical_name")
    scored = evaluate.er_timeslices(expected, _forms(t).join(born, "entity_id"), slices)
    return scored.select(
        "slice", "node_count_actual", "node_count_expected", "merge_recall_total", "merge_recall_correct",
        "entity_merge_total", "entity_merge_correct", "false_merge_total", "false_merge_count",
    )


@query(
    "resolution_accuracy",
    "EV11",
    f"""WITH {FORMS}, ids AS (SELECT form, max(entity_id) AS node FROM (
        SELECT entity_id, lower(name) AS form FROM forms UNION ALL
        SELECT entity_id, lower(alias) FROM forms WHERE alias IS NOT NULL) GROUP BY form),
      pairs AS (SELECT c_name AS a, 'Cust ' || (c_custkey % 400) AS b, 'merge' AS want FROM customer
        UNION ALL SELECT c_name, 'Cust ' || ((c_custkey + 1) % 400), 'split' FROM customer),
      d AS (SELECT CASE WHEN want = 'merge' THEN coalesce(x.node = y.node, FALSE)
          ELSE NOT coalesce(x.node = y.node, FALSE) END AS good
        FROM pairs p LEFT JOIN ids x ON x.form = lower(p.a) LEFT JOIN ids y ON y.form = lower(p.b))
    SELECT round(avg(CASE WHEN good THEN 1.0 ELSE 0.0 END), 6) AS resolution_accuracy,
      count(*) FILTER (good) AS "right", count(*) AS pairs FROM d""",
)
def _resolution(t: Tables):
    c, k = t.raw("customer"), F.col("c_custkey")

    def pairs(shift, outcome):
        return c.select(
            F.col("c_name").alias("surface_a"),
            F.concat(F.lit("Cust "), (k + shift) % 400).alias("surface_b"),
            F.lit(outcome).alias("expected_outcome"),
        )

    both = pairs(0, "merge").unionByName(pairs(1, "split"))
    return evaluate.resolution_accuracy(both, _forms(t)).withColumn(
        "resolution_accuracy", F.round("resolution_accuracy", 6)
    )


# -- time -------------------------------------------------------------------------------------


@query(
    "temporal_accuracy",
    "EV9",
    f"""WITH {TRUTH} SELECT round(avg(CASE WHEN good THEN 1.0 ELSE 0.0 END), 6)
      AS temporal_accuracy, count(*) FILTER (good) AS "right", count(*) AS total
    FROM (SELECT k % 10 <> 3 AND k % 10 <> 5 AND k % 6 <> 0 AND k % 9 <> 0 AS good FROM truth
      WHERE edge_label = 'ASSERTED')""",
)
def _temporal(t: Tables):
    k = F.col("k")
    assertions = (
        _truth(t).filter("edge_label = 'ASSERTED'").withColumn("stale", F.lit(False))
    )
    extracted = _found(t).withColumns(
        {
            "stale": k % 6 == 0,
            "valid_until": F.when(k % 9 != 0, F.col("valid_until")),
            "position": F.col("copy"),
        }
    )
    return evaluate.temporal_accuracy(assertions, extracted).withColumn(
        "temporal_accuracy", F.round("temporal_accuracy", 6)
    )


@query(
    "temporal_accuracy_by_source_day",
    "EV9",
    f"""WITH {TRUTH} SELECT round(avg(CASE WHEN good THEN 1.0 ELSE 0.0 END), 6)
      AS temporal_accuracy, count(*) FILTER (good) AS "right", count(*) AS total
    FROM (SELECT k % 10 <> 3 AND k % 8 <> 0 AS good FROM truth WHERE edge_label = 'ASSERTED')""",
)
def _temporal_legacy(t: Tables):
    k = F.col("k")
    day = F.to_date("source_at")
    assertions = _truth(t).filter("edge_label = 'ASSERTED'").select(
        "record_id",
        F.col("edge_label").alias("fact_category"),
        "from_entity",
        F.when(k % 8 == 0, F.date_add(day, 1)).otherwise(day).alias("valid_at"),
    )
    extracted = _found(t).withColumn("position", F.col("copy"))
    return evaluate.temporal_accuracy_by_source_day(assertions, extracted).withColumn(
        "temporal_accuracy", F.round("temporal_accuracy", 6)
    )


@query(
    "version_delta",
    "EV12",
    """SELECT dataset_version, engine_version, round(f1, 6) AS f1,
      round(f1 - lag(f1) OVER (PARTITION BY dataset_version ORDER BY run_order), 6) AS delta_f1
    FROM (SELECT o_orderpriority AS dataset_version, year(o_orderdate) AS run_order,
      'v' || year(o_orderdate) AS engine_version,
      count(*) FILTER (o_orderstatus = 'F') / count(*) AS f1 FROM orders GROUP BY 1, 2, 3)""",
)
def _delta(t: Tables):
    year = F.year("o_orderdate")
    runs = t.raw("orders").groupBy(
        F.col("o_orderpriority").alias("dataset_version"), year.alias("run_order")
    )
    scored = runs.agg((F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("f1"))
    named = scored.withColumn("engine_version", F.concat(F.lit("v"), "run_order"))
    return evaluate.version_delta(named).select(
        "dataset_version",
        "engine_version",
        F.round("f1", 6).alias("f1"),
        F.round("delta_f1", 6).alias("delta_f1"),
    )
