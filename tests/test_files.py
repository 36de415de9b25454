"""Files in and out, registry and evaluation datasets."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.schema import RECORD_TYPES, schema_fingerprint, struct_from_json_schema
from factloom.sources import files, registry

SEED = """# World

## people
Ann Lee | boss | ann@x.example
Bo Ray

## companies
Bolt | bolt.example

## widgets
Blue One

## facts
Ann Lee | AFFILIATED/employee | Bolt
Bo Ray | AFFILIATED/advisor | Bolt | Bo gives advice, as told

## aliases
Ann Lee | Ann | A. Lee
"""


def test_json_files_hold_lists_or_objects(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1"}, {"id": "2", "more": 1}]))
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"id": "3"}, indent=1))
    (tmp_path / "c.txt").write_text("no")
    got = files.read_json_records(spark, str(tmp_path), "id string")
    assert sorted(r.id for r in got.collect()) == ["1", "2", "3"]
    assert files.read_json_records(spark, str(tmp_path / "a.json"), "id string").count() == 2


def test_seed_file(spark, tmp_path):
    (tmp_path / "seed.md").write_text(SEED)
    lines = files.read_seed_lines(spark, str(tmp_path / "seed.md"))
    e = {r.name: r for r in files.seed_entities(lines).collect()}
    assert set(e) == {"Ann Lee", "Bo Ray", "Bolt", "Blue One", "Ann", "A. Lee"}
    assert (e["Ann Lee"].role, e["Ann Lee"].email) == ("boss", "ann@x.example")
    assert e["Bo Ray"].email is None and e["Bolt"].domain == "bolt.example"
    assert e["Blue One"].type == "widgets"
    assert (e["A. Lee"].canonical_name, e["A. Lee"].type) == ("Ann Lee", "person")
    f = {r.from_entity: r.fact for r in files.seed_facts(lines).collect()}
    assert f["Ann Lee"] == "Ann Lee is employed at Bolt"
    assert f["Bo Ray"] == "Bo gives advice, as told"


def test_evaluation_dataset(spark, tmp_path):
    (tmp_path / "dataset.yaml").write_text(
        "version: '1.2'\nsequence: sequence.yaml\nground_truth:\n  facts: facts.json\n"
    )
    (tmp_path / "sequence.yaml").write_text(
        "- file: records/a.json\n  type: email\n- type: issue\n  file: 'records/b.json'\n"
    )
    (tmp_path / "er.json").write_text(
        json.dumps(
            {
                "global": [{"canonical_name": "Ann", "surface_forms": ["Ann", "A."]}],
                "timeslices": [
                    {"record": "a", "entities": [{"canonical_name": "Ann", "surface_forms": ["Ann"]}]}
                ],
            }
        )
    )
    (tmp_path / "facts.json").write_text(
        json.dumps(
            {
                "expected_facts": [{"edge_label": "ASSERTED", "from_entity": "Ann"}],
                "match_on": ["edge_label", "from_entity"],
            }
        )
    )
    config = files.read_config_yaml(spark, str(tmp_path / "dataset.yaml"))
    assert {(r.key, r.value, r.nested) for r in config.collect()} == {
        ("version", "1.2", False),
        ("sequence", "sequence.yaml", False),
        ("ground_truth", "", False),
        ("facts", "facts.json", True),
    }
    order = files.read_sequence_yaml(spark, str(tmp_path / "sequence.yaml")).orderBy("position")
    assert [(r.file, r.type) for r in order.collect()] == [
        ("records/a.json", "email"),
        ("records/b.json", "issue"),
    ]
    er = files.read_er_truth(spark, str(tmp_path / "er.json"))
    assert er.filter("slice IS NULL").count() == 2 and er.filter("slice = 'a'").count() == 1
    facts, match_on = files.read_fact_truth(spark, str(tmp_path / "facts.json"))
    assert match_on == ["edge_label", "from_entity"] and facts.count() == 1


def test_eval_results_replace_only_their_own_run(spark, tmp_path):
    out = str(tmp_path / "results")
    columns = "f1 double, engine_version string, dataset_version string"
    files.write_eval_results(
        spark.createDataFrame([(0.5, "v1", "d1"), (0.5, "v2", "d1")], columns), out
    )
    files.write_eval_results(spark.createDataFrame([(0.9, "v1", "d1")], columns), out)
    got = {(r.engine_version, r.f1) for r in spark.read.json(out).collect()}
    assert got == {("v1", 0.9), ("v2", 0.5)}


def test_json_schema_mapping():
    s = struct_from_json_schema(RECORD_TYPES["linear_issue"])
    assert s["labels"].dataType.simpleString() == "array<string>"
    assert s["comments"].dataType.simpleString() == "array<map<string,string>>"
    assert not s["linear_id"].nullable and s["status"].nullable
    a = {"type": "object", "properties": {"x": {"type": "number"}}}
    b = {"properties": {"x": {"type": "number"}}, "type": "object"}
    assert schema_fingerprint(a) == schema_fingerprint(b)
    assert len(schema_fingerprint(a)) == 16
    assert schema_fingerprint(a) != schema_fingerprint(RECORD_TYPES["email"])


@pytest.fixture()
def known(spark):
    rows = [
        ("mail", "0.1", "2024-01-01", False),
        ("mail", "0.2", "2024-02-01", True),
        ("mail", "0.3", "2024-03-01", False),
        ("code", "1.0", "2024-01-01", True),
    ]
    df = spark.createDataFrame(rows, "name string, version string, installed_at string, enabled boolean")
    return df.withColumn("installed_at", F.to_timestamp("installed_at"))


def enabled(df):
    return {(r.name, r.version) for r in df.filter("enabled").collect()}


def test_registry_changes(spark, known):
    assert enabled(registry.disable(known, "mail")) == {("code", "1.0")}
    off = registry.disable(known, "mail")
    assert enabled(registry.enable_latest_disabled(off, "mail")) == {("code", "1.0"), ("mail", "0.3")}
    batch = known.filter("version = '0.1'").withColumn("enabled", F.lit(True))
    assert enabled(registry.apply_registration(known, batch)) == {("code", "1.0"), ("mail", "0.1")}
    quiet = known.filter("version = '0.1'")
    assert enabled(registry.apply_registration(known, quiet)) == {("code", "1.0"), ("mail", "0.2")}
    kept, children = registry.remove(known, "mail", known)
    assert kept.count() == 1 and children.count() == 1
    assert registry.one_version(known, "mail", "0.2").count() == 1
    assert [r.version for r in registry.all_versions(known, "mail").collect()] == ["0.3", "0.2", "0.1"]
    child = spark.createDataFrame([("mail", "0.1", "old"), ("mail", "0.2", "stay")], "name string, version string, type_name string")
    fresh = spark.createDataFrame([("mail", "0.1", "new")], "name string, version string, type_name string")
    done = registry.replace_children(child, batch, fresh)
    assert {r.type_name for r in done.collect()} == {"new", "stay"}


def test_vector_rows_that_cannot_be_compared(spark):
    from factloom.operators.vectors import vector_search

    rows = [("a", [1.0, 0.0]), ("b", [2.0, 2.0]), ("zero", [0.0, 0.0]), ("none", None)]
    v = spark.createDataFrame(rows, "record_id string, embedding array<float>")
    got = vector_search(v, [3.0, 0.0], 5).collect()
    assert [r.record_id for r in got] == ["a", "b"]
    assert abs(got[1].score - 0.5**0.5) < 1e-6
