"""The decisions on semantic traps, on literals."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import columns as c
from factloom.operators import curate, facts, records
from factloom.sources import records as src


def ids(df, column="edge_id"):
    return [r[column] for r in df.select(column).collect()]


@pytest.fixture()
def people(make_entities):
    return make_entities(("a", "person", "Ann"), ("b", "company", "Bolt"), ("n", "nation", "N"))


def test_time_bounds_are_typed_and_inclusive_for_facts(make_facts):
    f = make_facts(
        {"edge_id": "1", "from_id": "a", "to_id": "b", "source_at": "2024-01-01 00:00:00"},
        {"edge_id": "2", "from_id": "a", "to_id": "b", "source_at": "2024-01-02 00:00:00"},
        {"edge_id": "3", "from_id": "a", "to_id": "b", "source_at": "2024-01-03 00:00:00"},
    )
    kept = facts.filter_facts(f, since="2024-01-01T00:00:00Z", until="2024-01-02")
    assert sorted(ids(kept)) == ["1", "2"]


def test_usage_until_is_exclusive_and_needs_a_filter(spark):
    from factloom.operators.usage import usage_filter

    calls = spark.createDataFrame(
        [("x", datetime(2024, 1, 1)), ("y", datetime(2024, 1, 2))], "call_id string, created_at timestamp"
    )
    kept = usage_filter(calls, since="2024-01-01", until="2024-01-02")
    assert ids(kept, "call_id") == ["x"]
    with pytest.raises(ValueError):
        usage_filter(calls)


def test_source_cursor_is_exclusive(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, updated_at string")
    assert ids(src.incremental_since(df, "1"), "id") == ["b"]


def test_null_stale_is_current_and_replaced_only_matters_for_the_slot(make_facts):
    f = make_facts(
        {"edge_id": "1", "from_id": "a", "to_id": "b", "stale": None},
        {"edge_id": "2", "from_id": "a", "to_id": "b", "stale": True},
        {"edge_id": "3", "from_id": "a", "to_id": "b", "replaced_by": "9"},
    )
    assert sorted(ids(facts.filter_facts(f))) == ["1", "3"]
    assert ids(facts.filter_facts(f, strict_current=True)) == ["1"]
    assert ids(facts.existing_fact(f, "a", "affiliated", "employee", "b")) == ["1"]


def test_rows_without_time_come_first(make_facts, people):
    f = make_facts(
        {"edge_id": "1", "from_id": "a", "to_id": "b", "source_at": "2024-01-01"},
        {"edge_id": "2", "from_id": "a", "to_id": "b"},
        {"edge_id": "3", "from_id": "a", "to_id": "b", "source_at": "2024-02-01"},
    )
    assert ids(facts.query_facts(f, people)) == ["2", "3", "1"]
    assert ids(facts.chronological(f)) == ["2", "1", "3"]


def test_self_loop_is_seen_once_and_others_from_both_ends(make_facts, people):
    f = make_facts(
        {"edge_id": "loop", "from_id": "a", "to_id": "a"},
        {"edge_id": "in", "from_id": "b", "to_id": "a"},
        {"edge_id": "day", "from_id": "a", "to_day": "2024-01-01"},
    )
    seen = facts.facts_for_entity(f, people, "a")
    assert {r.edge_id: r.other_name for r in seen.collect()} == {
        "loop": "Ann",
        "in": "Bolt",
        "day": "2024-01-01",
    }


def test_aliases_count_as_facts_only_on_request(spark, make_facts, people):
    from factloom.schema import ALIASES

    f = make_facts({"edge_id": "1", "from_id": "a", "to_id": "b"})
    a = spark.createDataFrame([("a", "Annie", "stated", "r", "email", "", None, None)], ALIASES)
    assert facts.query_facts(f, people).count() == 1
    both = facts.query_facts(f, people, aliases=a).collect()
    assert "Annie identified as this entity" in {r.fact for r in both}


def test_conflicts_bind_the_same_target_unless_asked(make_facts, people):
    f = make_facts(
        {"edge_id": "1", "from_id": "a", "to_id": "b"},
        {"edge_id": "2", "from_id": "a", "to_id": "n"},
        {"edge_id": "3", "from_id": "a", "to_id": "n"},
        {"edge_id": "4", "from_id": "a", "to_id": "n", "stale": True},
        {"edge_id": "5", "from_id": "a", "to_id": "n", "edge_label": "ASSERTED"},
    )
    assert sorted(ids(curate.conflicts(f, people))) == ["2", "3"]
    assert sorted(ids(curate.conflicts(f, people, scope="entity"))) == ["1", "2", "3"]
    row = curate.conflicts_with(f, "3").collect()
    assert [(r.edge_id_a, r.edge_id_b) for r in row] == [("2", "3")]


def test_entity_lookup_ignores_case_and_pattern_characters(make_entities):
    e = make_entities(("a", "person", "Ann_Lee"), ("b", "person", "AnnXLee"))
    assert ids(facts.search_entities(e, "ann_l"), "entity_id") == ["a"]
    assert facts.search_entities(e, "%").count() == 0


def test_event_time_skips_blanks_and_takes_change_time_on_request(spark):
    df = spark.createDataFrame(
        [
            ({"received_at": "", "linear_created_at": "2024-01-02T00:00:00Z"},),
            ({"received_at": None, "changed_at": "2024-05-05T00:00:00Z"},),
            ({"received_at": "None"},),
        ],
        "metadata map<string,string>",
    ).withColumn("created_at", F.lit("2020-01-01").cast("timestamp"))
    plain = [r[0] for r in df.select(c.source_time()).collect()]
    assert plain == [datetime(2024, 1, 2), datetime(2020, 1, 1), datetime(2020, 1, 1)]
    change = [r[0] for r in df.select(c.source_time(prefer_change_time=True)).collect()]
    assert change[1] == datetime(2024, 5, 5)


def test_local_day_uses_the_deployment_zone(spark):
    df = spark.range(1).select(c.local_day(F.lit("2026-03-21 02:00:00").cast("timestamp")))
    assert df.first()[0] == date(2026, 3, 20)


def test_dedup_key_is_global_first_wins_and_blank_means_none(make_records):
    r = make_records(
        {"record_id": "1", "type": "email", "dedup_key": "k", "created_at": "2024-01-02"},
        {"record_id": "2", "type": "issue", "dedup_key": "k", "created_at": "2024-01-01"},
        {"record_id": "3", "dedup_key": ""},
        {"record_id": "4", "dedup_key": " "},
        {"record_id": "5", "dedup_key": None},
        {"record_id": "6", "dedup_key": "old", "created_at": "2024-01-01"},
    )
    stored = make_records({"record_id": "0", "dedup_key": "old"}, {"record_id": "00", "dedup_key": ""})
    kept = records.dedup_records(r, stored)
    assert sorted(ids(kept, "record_id")) == ["2", "3", "4", "5"]


def test_metadata_filter_ignores_keys_that_are_no_names(make_records):
    r = make_records({"record_id": "1", "metadata": {"a b": "x", "n": "7"}}, {"record_id": "2"})
    assert records.query_records(r, metadata={"a b": "nope"}).count() == 2
    assert ids(records.query_records(r, metadata={"n": 7}), "record_id") == ["1"]


def test_manual_ingest_beats_the_noise_filter(spark, make_records):
    r = make_records({"record_id": "1", "classification": "noise"}, {"record_id": "2"})
    done = records.mark_manual(r, spark.createDataFrame([("1",)], "record_id string"))
    assert {x.record_id: x.classification for x in done.collect()} == {"1": "relevant", "2": None}


def test_triage_sets_op_area_only_where_it_is_missing(spark, make_records):
    r = make_records(
        {"record_id": "1", "classification": "pending_triage", "metadata": {"op_area": "intention"}},
        {"record_id": "2", "classification": "pending_triage", "metadata": {"k": "v"}},
        {"record_id": "3", "classification": "pending_triage"},
        {"record_id": "4", "classification": "relevant"},
    )
    d = spark.createDataFrame(
        [("1", "relevant", "reality"), ("2", "noise", None), ("4", "noise", "reality")],
        "record_id string, classification string, op_area string",
    )
    done = {x.record_id: x for x in records.apply_triage(r, d).collect()}
    assert done["1"].metadata["op_area"] == "intention"
    assert done["2"].metadata == {"k": "v", "op_area": "reality"}
    assert done["3"].classification == "uncertain" and "op_area" not in done["3"].metadata
    assert done["4"].classification == "relevant"


def test_expiry_is_strict_and_only_for_promises(make_facts):
    rows = [("commitment", "2024-01-01"), ("commitment", "2024-01-02"), ("goal", "2020-01-01"), ("promise", None)]
    f = make_facts(
        *[
            {"edge_id": str(i), "from_id": "a", "to_id": "b", "edge_label": "ASSERTED", "fact_type": k, "valid_until": d}
            for i, (k, d) in enumerate(rows)
        ]
    )
    done = curate.expire(f, "2024-01-02")
    assert [r.edge_id for r in done.filter("stale").collect()] == ["0"]


def test_confidence_needs_two_sources_and_a_statement(spark, make_facts):
    f = make_facts(
        *[
            {"edge_id": i, "from_id": "a", "to_id": "b", "confidence": "inferred"}
            for i in ("one", "two", "weak")
        ],
    )
    s = spark.createDataFrame(
        [
            ("one", "r1", "stated"),
            ("two", "r1", "inferred"),
            ("two", "r2", "stated"),
            ("weak", "r1", "inferred"),
            ("weak", "r2", "inferred"),
        ],
        "edge_id string, record_id string, confidence string",
    )
    done = curate.upgrade_confidence(f, s)
    assert {r.edge_id: r.confidence for r in done.collect()} == {
        "one": "inferred",
        "two": "stated",
        "weak": "inferred",
    }


def test_supersession_leaves_ties_and_transitions_alone(make_facts):
    base = {"from_id": "a", "to_id": "b"}
    f = make_facts(
        {"edge_id": "1", "source_at": "2024-01-01", **base},
        {"edge_id": "2", "source_at": "2024-01-02 05:00:00", **base},
        {"edge_id": "3", "source_at": "2024-01-02 05:00:00", **base},
        {"edge_id": "4", "source_at": "2023-01-01", "edge_label": "TRANSITIONED", **base},
        {"edge_id": "5", "source_at": "2024-06-01", "edge_label": "TRANSITIONED", **base},
        {"edge_id": "6", "source_at": None, **base},
        {"edge_id": "7", "source_at": "2023-12-31", **base},
        {"edge_id": "8", "source_at": "2024-01-01", "from_id": "x", "to_day": "2024-01-01"},
        {"edge_id": "9", "source_at": "2024-01-05", "from_id": "x", "to_day": "2024-01-01"},
    )
    done = {r.edge_id: (r.stale, r.replaced_by) for r in curate.supersede(f).collect()}
    assert done["7"] == (True, "1")
    assert done["1"] == (True, "2")
    assert done["2"] == done["3"] == (False, None)
    assert done["4"] == done["5"] == done["6"] == (False, None)
    assert done["8"] == (True, "9")


def test_typed_values_that_do_not_fit_become_null(make_records):
    from factloom.schema import RECORD_TYPES
    from factloom.sources.typed import project_typed

    r = make_records(
        {"record_id": "1", "metadata": {"github_id": "7", "number": "x", "labels": '["a","b"]'}}
    )
    row = project_typed(r, RECORD_TYPES["github_pr"]).first()
    assert (row.github_id, row.number, row.labels, row.title) == (7, None, ["a", "b"], None)


def test_mail_noise_headers(spark):
    def headers(*pairs):
        return [{"name": n, "value": v} for n, v in pairs]

    df = spark.createDataFrame(
        [
            ("NoReply@x", None),
            ("a@x", headers(("List-Unsubscribe", "<x>"))),
            ("a@x", headers(("Auto-Submitted", "no"))),
            ("a@x", headers(("Auto-Submitted", "auto-replied"))),
            ("a@x", headers(("Precedence", "BULK"))),
            ("a@x", headers(("Precedence", "list"), ("precedence", "first-class"))),
            (None, headers(("X-Auto-Response-Suppress", "All"))),
            ("a@x", []),
        ],
        "sender string, headers array<struct<name:string,value:string>>",
    )
    got = [r[0] for r in df.select(src.mail_noise("sender", "headers")).collect()]
    assert got == [True, True, False, True, True, False, True, False]


def test_vocabulary_keeps_anchor_labels_only(spark):
    from factloom.schema import vocabulary

    extra = spark.createDataFrame(
        [("ASSERTED", "pledge"), ("CLAIMED", "x"), ("AFFILIATED", "owner")],
        "edge_label string, fact_type string",
    )
    assert vocabulary(spark).count() == 36
    assert vocabulary(spark, extra).count() == 37


def test_scalar_functions(spark):
    row = spark.range(1).select(
        c.provider_of(F.lit("claude-x")).alias("p"),
        c.provider_of(F.lit("llama")).alias("none"),
        c.stop_reason(F.lit("length")).alias("s"),
        c.stop_reason(F.lit(None).cast("string")).alias("u"),
        c.fresh_input(F.lit(10), F.lit(4)).alias("f"),
        c.ratio(F.lit(0), F.lit(0), 1.0).alias("r"),
        c.harmonic(F.lit(0.0), F.lit(0.0)).alias("h"),
        c.priority_label(F.lit(9)).alias("nine"),
        c.grounding(F.lit("red  fox\njumps"), F.lit("The RED fox sleeps")).alias("g"),
        c.normalised_company(F.lit("Acme, Inc.")).alias("n"),
    ).first()
    assert (row.p, row.none, row.s, row.u, row.f) == ("anthropic", None, "max_tokens", "unknown", 6)
    assert (row.r, row.h, row.nine, row.n) == (1.0, 0.0, "9", "Acme")
    assert abs(row.g - 2 / 3) < 1e-9
