"""Payloads kept whole, other field names, a person's context, the record table, and late decisions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from factloom.operators import records
from factloom.sources import records as src
from factloom.streaming import streams


def test_payload_and_other_field_names(spark):
    mail = spark.createDataFrame(
        [("m1", "a@x", None, "old@x", "s", None), ("m2", "a@x", "new@x", "old@x", "s", "b")],
        "message_id string, sender string, recipients string, recipient string, subject string, body string",
    ).withColumns({"thread_id": F.lit("t"), "received_at": F.lit("2024-01-01")})
    rows = {r.dedup_key: r for r in src.email_records(mail).collect()}
    assert rows["m1"].metadata["recipients"] == "old@x" and rows["m2"].metadata["recipients"] == "new@x"
    kept = json.loads(rows["m1"].raw)
    assert kept["body"] is None and kept["recipient"] == "old@x" and kept["thread_id"] == "t"
    # a payload that came as text stays as it came
    given = src.email_records(mail.withColumn("raw", F.lit('{"x":1}')).withColumn("human_context", F.lit("why")))
    assert {(r.raw, r.human_context) for r in given.collect()} == {('{"x":1}', "why")}


def test_context_is_part_of_the_text(spark, make_records):
    r = make_records(
        {"record_id": "a", "content": "c", "human_context": "told"}, {"record_id": "b", "content": "c", "human_context": ""},
        {"record_id": "d", "content": None, "human_context": None, "classification": "noise"},
    )
    text = {x.record_id: x.t for x in r.select("record_id", records.extraction_text(r).alias("t")).collect()}
    assert text == {"a": "c\n\nAdditional context from human:\ntold", "b": "c", "d": ""}
    assert r.drop("human_context").select(records.extraction_text(r.drop("human_context")).alias("t")).count() == 3
    manual = spark.createDataFrame([("d", "by hand"), ("d", " "), ("a", None)], "record_id string, human_context string")
    done = {x.record_id: x for x in records.mark_manual(r, manual).collect()}
    assert (done["d"].classification, done["d"].human_context) == ("relevant", "by hand")
    assert done["a"].human_context == "told" and done["b"].classification is None


def test_record_table_takes_a_load_once(spark, make_records, tmp_path):
    path = str(tmp_path / "records")
    assert records.read_records(spark, path).count() == 0
    first = make_records(
        {"record_id": "a", "dedup_key": "k", "raw": "{}"}, {"record_id": "b", "dedup_key": "k"},
        {"record_id": "c", "type": "note"}, {"record_id": "d", "type": "note", "created_at": "2024-01-01"},
    )
    assert records.write_records(first, path, policy="required") == 3
    assert records.write_records(first, path, policy="required") == 0
    more = make_records({"record_id": "e", "dedup_key": "k"}, {"record_id": "f", "dedup_key": "l", "classification": "noise"})
    assert records.write_records(more.drop("human_context"), path, policy="skip") == 1
    got = {r.record_id: r for r in records.read_records(spark, path).collect()}
    assert set(got) == {"a", "c", "d", "f"} and got["a"].raw == "{}"
    assert got["c"].classification == "pending_triage" and got["f"].classification == "noise"
    assert got["c"].created_at is not None and got["d"].created_at.year == 2024 and got["d"].type == "note"


def test_decisions_before_and_after_their_records(spark, make_records, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    schema = "record_id string, classification string, op_area string, decided_at timestamp"
    rows = make_records(*[{"record_id": i, "classification": "pending_triage"} for i in ("a", "b", "c")])
    assert streams.read_triaged(rows, out).filter("classification = 'pending_triage'").count() == 3
    for n, told in enumerate((
        [("a", "noise", None, "2024-01-01 00:00:00"), ("z", "noise", None, "2024-01-01 00:00:00")],
        [("a", "relevant", "intention", "2024-01-02 00:00:00"), ("b", "noise", None, "2024-01-03 00:00:00")],
        [("b", "relevant", None, "2024-01-02 00:00:00")],
    )):
        text = "\n".join(json.dumps(dict(zip(("record_id", "classification", "op_area", "decided_at"), t, strict=True))) for t in told)
        (folder / f"{n}.json").write_text(text)
        live = streams.stream_files(spark, str(folder), schema, "json", multi_line=False)
        streams.stream_decisions(live, out, str(tmp_path / "cp")).awaitTermination()
    got = {r.record_id: (r.classification, r.metadata.get("op_area")) for r in streams.read_triaged(rows, out).collect()}
    assert got == {"a": ("relevant", "intention"), "b": ("noise", "reality"), "c": ("pending_triage", None)}
