"""Streams give what the batch operators give, also when rows come late or batches are replayed."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from factloom.operators.records import dedup_records
from factloom.schema import FACTS, RECORDS
from factloom.streaming import streams
from factloom.streaming.snapshots import Snapshots


def drip(df, folder, parts, start=0):
    """Writes the rows of `df` as one file per part, in the order of the parts."""
    for i, part in enumerate(parts, start):
        df.filter(part).coalesce(1).write.mode("append").json(f"{folder}/part={i:02d}")


def read_stream(spark, folder, schema):
    stream = streams.stream_files(
        spark, folder, schema, "json", files_per_batch=1, multi_line=False
    )
    return stream.drop("part")


def test_current_facts_with_late_rows(spark, make_facts, tmp_path):
    base = {"from_id": "a", "to_id": "b"}
    f = make_facts(
        {"edge_id": "1", "source_at": "2024-03-01", "fact": "0", **base},
        {"edge_id": "2", "source_at": "2024-01-01", "fact": "1", **base},
        {"edge_id": "3", "source_at": "2024-05-01", "fact": "2", **base},
        {"edge_id": "4", "source_at": "2024-02-01", "fact": "2", "from_id": "c", "to_id": "d"},
        {"edge_id": "5", "source_at": "2024-09-01", "fact": "2", "edge_label": "TRANSITIONED", **base},
    )
    folder = str(tmp_path / "in")
    drip(f, folder, [F.col("fact") == str(i) for i in range(3)])
    out = str(tmp_path / "out")
    live = read_stream(spark, folder, FACTS)
    streams.stream_current_facts(live, out, str(tmp_path / "cp")).awaitTermination()
    got = streams.read_current_facts(spark, out)
    want = streams.current_facts(f)
    assert {r.edge_id for r in got.collect()} == {"3", "4"}
    assert got.select(*want.columns).exceptAll(want).count() == 0


def test_dedup_across_batches_and_restart(spark, make_records, tmp_path):
    rows = [
        {"record_id": f"r{i}", "dedup_key": k, "created_at": "2024-01-01", "source": s}
        for i, (k, s) in enumerate([("k1", "0"), ("k1", "0"), ("k1", "1"), ("k2", "1"), ("", "1"), ("", "2")])
    ]
    r = make_records(*rows)
    folder, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    drip(r, folder, [F.col("source") == "0"])
    streams.stream_dedup(read_stream(spark, folder, RECORDS), out, cp).awaitTermination()
    drip(r, folder, [F.col("source") == s for s in ("1", "2")], start=1)
    streams.stream_dedup(read_stream(spark, folder, RECORDS), out, cp).awaitTermination()
    got, want = streams.read_landed(spark, out, RECORDS), dedup_records(r)
    assert sorted(x.record_id for x in got.collect()) == sorted(x.record_id for x in want.collect())


def test_dedup_loses_no_late_record_and_lets_no_old_duplicate_in(spark, make_records, tmp_path):
    """Days apart in any order: new keys land, known keys never come back."""
    rows = [("a", "k1", "2024-06-10", "0"), ("b", "k2", "2024-06-01", "1"), ("c", None, "2024-06-01", "1"),
            ("d", "k1", "2024-06-20", "2"), ("e", "k1", "2024-06-30", "3"), ("f", None, "2020-01-01", "3")]
    r = make_records(
        *[{"record_id": i, "dedup_key": k, "created_at": at, "source": s} for i, k, at, s in rows]
    )
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drip(r, folder, [F.col("source") == str(s) for s in range(4)])
    streams.stream_dedup(read_stream(spark, folder, RECORDS), out, str(tmp_path / "cp")).awaitTermination()
    got = streams.read_landed(spark, out, RECORDS)
    assert {x.record_id for x in got.collect()} == {"a", "b", "c", "f"}


def test_usage_counts_late_calls_and_the_last_window(spark, tmp_path):
    calls = spark.createDataFrame(
        [("2024-01-01 10:05:00", "m", 1, 2, 0), ("2024-01-03 10:05:00", "m", 3, 4, 1),
         ("2024-01-01 10:55:00", "m", 5, 6, 2), ("2024-01-03 10:06:00", "n", 7, 8, 2)],
        "created_at string, model string, input_tokens long, output_tokens long, part int",
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drip(calls, folder, [F.col("part") == i for i in range(3)])
    live = read_stream(spark, folder, calls.drop("part").schema)
    streams.stream_usage(live, out, str(tmp_path / "cp")).awaitTermination()
    got = streams.read_usage(spark, out)
    want = streams.usage_windows(calls)
    assert got.count() == want.count() == 3 and got.select(*want.columns).exceptAll(want).count() == 0


def extraction(spark, *rows):
    """Extractions of one person each: (record_id, name, metadata, day, canonical name or None)."""
    kind = (
        "record_id string, record_type string, content string, metadata map<string,string>, created_at timestamp, "
        "entities array<struct<name: string, type: string, metadata: map<string,string>, resolved_to: string, "
        "canonical_name: string>>, facts array<struct<edge_label: string, fact_type: string, fact: string, "
        "from_entity: string, to_entity: string, confidence: string, valid_until: string>>, classification string"
    )
    from datetime import datetime

    full = []
    for record, name, bag, day, canonical, label in rows:
        at = datetime.fromisoformat(day)
        told = [(name, "person", bag, "ent-known" if canonical else "new", canonical or name)]
        claim = [("AFFILIATED", "employee", f"{name} works", name, None, "stated", None)]
        full.append((record, "email", "", {}, at, told, claim, label))
    return spark.createDataFrame(full, kind)


BATCHES = [
    ("r1", "Ann", {"role": "old", "only": "x"}, "2024-01-01", None, "relevant"),
    ("r2", "Ann", {"role": "new", "extra": "1"}, "2024-03-01", None, "relevant"),
    ("r3", "Annie", {}, "2024-02-01", "Ann", "relevant"),
    ("r4", "Annie", {}, "2024-05-01", "Ann", "relevant"),
    ("r5", "Bob", {"role": "mid"}, "2024-02-01", None, "noise"),
    ("r6", "Ann", {"role": "late batch, early time"}, "2023-01-01", None, "relevant"),
]


def test_batches_in_any_order_equal_one_commit(spark, tmp_path):
    from factloom.operators.build import commit

    now = F.lit("2024-06-01").cast("timestamp")
    x = extraction(spark, *BATCHES)
    want = commit(x.filter("classification = 'relevant'"), now)

    def rows(df):
        return sorted(str(sorted(r.asDict(recursive=True).items(), key=str)) for r in df.collect())

    for n, order in enumerate((range(6), reversed(range(6)), (2, 5, 0, 4, 1, 3))):
        folder, base = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        drip(x, folder, [F.col("record_id") == f"r{i + 1}" for i in order])
        live = read_stream(spark, folder, x.schema)
        streams.stream_commit(live, base, str(tmp_path / f"cp{n}"), now).awaitTermination()
        got = streams.read_committed(spark, base)
        for name in ("entities", "aliases", "alias_sources", "facts", "fact_sources"):
            assert rows(getattr(got, name)) == rows(getattr(want, name)), name
    assert want.entities.first().metadata == {"role": "new", "extra": "1", "only": "x"}


def test_second_load_merges_into_the_first(spark):
    from factloom.operators.build import commit

    now = F.lit("2024-06-01").cast("timestamp")
    x = extraction(spark, *BATCHES)
    early, late = x.filter("created_at < '2024-02-15'"), x.filter("created_at >= '2024-02-15'")
    got, want = commit(late, now, stored=commit(early, now)), commit(x, now)
    for name in ("entities", "aliases", "alias_sources", "facts", "fact_sources"):
        a, b = (
            sorted(str(sorted(r.asDict(recursive=True).items(), key=str)) for r in getattr(y, name).collect())
            for y in (got, want)
        )
        assert [len(a), a] == [len(b), b], name


def test_dedup_of_many_batches_reads_no_landed_record(spark, make_records, tmp_path):
    """20 micro-batches with one hot key: the rows of a batch dedup, and no plan reads what has landed."""
    r = make_records(
        *[{"record_id": f"r{i:03d}", "dedup_key": "hot" if i % 3 else f"k{i % 12}", "created_at": "2024-01-01",
           "source": f"{i:03d}", "metadata": {"a": str(i)}} for i in range(20)],
        *[{"record_id": f"b{i}", "dedup_key": "  " if i % 2 else None, "source": f"{i * 6:03d}"} for i in range(3)],
    )
    folder, out = tmp_path / "in", str(tmp_path / "out")
    rows = r.toJSON().collect()
    for i in range(20):
        (folder / f"part={i:03d}").mkdir(parents=True)
        own = [x for x in rows if f'"source":"{i:03d}"' in x]
        (folder / f"part={i:03d}" / "x.json").write_text("\n".join(own))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        query = streams.stream_dedup(read_stream(spark, str(folder), RECORDS), out, str(tmp_path / "cp"))
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = streams.read_landed(spark, out, RECORDS).collect()
    want = dedup_records(r).collect()
    assert sorted(x.record_id for x in got) == sorted(x.record_id for x in want)
    assert {x.record_id: x.metadata for x in got} == {x.record_id: x.metadata for x in want}
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    states = [p["stateOperators"][0] for p in progress]
    # the state holds keys; each batch updates the keys it brings, and nothing else
    assert max(s["numRowsTotal"] for s in states) <= 5
    assert all(s["numRowsUpdated"] <= 2 for s in states)
    assert all(len(p["sources"]) <= 2 for p in progress)


def test_dedup_keeps_the_first_by_time_then_id_and_whole_rows(spark, make_records, tmp_path):
    rows = [("b", "2024-01-02"), ("a", "2024-01-02"), ("c", "2024-01-01"), ("d", None)]
    r = make_records(*[{"record_id": i, "dedup_key": "k", "created_at": at, "metadata": {"x": i}, "indexed": True}
                       for i, at in rows])
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drip(r, folder, [F.lit(True)])
    streams.stream_dedup(read_stream(spark, folder, RECORDS), out, str(tmp_path / "cp")).awaitTermination()
    got = streams.read_landed(spark, out, RECORDS)
    assert got.collect() == dedup_records(r).select(*got.columns).collect() and got.first().record_id == "c"


def newest_value(rows):
    return rows.groupBy("key").agg(F.max(F.struct("at", "value")).alias("m")).select("key", "m.*")


def test_fifty_batches_lie_in_few_folders(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), newest_value)
    assert store.read() is None
    most = 0
    for batch in range(50):
        rows = spark.createDataFrame([("hot", batch * 7 % 50, batch), (f"k{batch % 5}", batch, batch)], "key string, at int, value int")
        store.commit(batch, rows.coalesce(1))
        most = max(most, len(store.runs()))
    # log2(50) + 1, and merged folders hold one row of a key
    assert most <= 6 and sum(r.batches for r in store.runs()) == 50
    assert store.read().count() <= 6 * len(store.runs())
    got = {r.key: r.value for r in newest_value(store.read()).collect()}
    assert got == {"hot": 7, **{f"k{k}": 45 + k for k in range(5)}}
    folders = [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("run-")]
    assert len(folders) <= 2 * 6


def test_crash_between_merge_and_switch_and_replay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    rows = lambda n: spark.createDataFrame([("k", n, n)], "key string, at int, value int")
    store = Snapshots(spark, path)
    for batch in range(3):
        store.commit(batch, rows(batch))
    before = store.read()

    def crash(self, batch, runs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_switch", crash)
        try:
            store.commit(3, rows(3))
        except RuntimeError:
            pass
    again = Snapshots(spark, path)
    assert sorted(r.value for r in again.read().collect()) == [0, 1, 2]
    again.commit(3, rows(3))
    again.commit(3, rows(99))  # a replay after the switch changes nothing
    again.commit(2, rows(98))
    assert sorted(r.value for r in again.read().collect()) == [0, 1, 2, 3] and len(again.runs()) == 1
    # who began to read before the merge still can, and what the crash left is gone
    assert sorted(r.value for r in before.collect()) == [0, 1, 2]
    named = {r.folder for r in again.runs()}
    left = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("run-")}
    assert named <= left and len(left) <= 4


def test_streamed_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path):
    from factloom.plans.queries_streams import StreamTables
    from factloom.sources.tables import TABLE_SCHEMAS, Tables

    rows = [(i, 0, "user" if i % 2 else "assistant", "x" * i) for i in range(6)]
    calls = spark.createDataFrame(rows, TABLE_SCHEMAS["conversations"])
    many, one = tmp_path / "many", tmp_path / "one"
    calls.repartition(3).write.parquet(str(many / "conversations.parquet"))
    calls.coalesce(1).write.parquet(str(tmp_path / "part"))
    one.mkdir()
    shutil.copy(next((tmp_path / "part").glob("*.parquet")), one / "conversations.parquet")
    for folder in (many, one):
        # another table beside it is not read
        calls.write.parquet(str(folder / "old_conversations.parquet"))
        out = str(folder / "out")
        live = StreamTables(Tables(spark, str(folder)), "conversations").model_calls()
        streams.stream_usage(live, out, str(folder / "cp")).awaitTermination()
        assert streams.read_usage(spark, out).agg(F.sum("calls"), F.sum("input_tokens")).first()[:] == (6, 9)


def test_current_facts_hold_no_slot_between_batches(spark, make_facts, tmp_path):
    """The folders are the state: a checkpoint without a state store, and one folder is not reduced again."""
    base = {"from_id": "a", "to_id": "b", "source_at": "2024-03-01"}
    f = make_facts(*[{"edge_id": str(i), "fact": str(i % 3), **base} for i in range(9)])
    folder, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "cp"
    for start, n in ((0, 1), (1, 2)):
        drip(f, folder, [F.col("fact") == str(i) for i in range(start, start + n)], start=start)
        streams.stream_current_facts(read_stream(spark, folder, FACTS), out, str(cp)).awaitTermination()
        got = streams.read_current_facts(spark, out)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert [r.edge_id for r in got.collect()] == ["8" if start else "6"]
        assert ("Aggregate" in plan) == (start > 0)
    assert (cp / "offsets").exists() and not (cp / "state").exists()
