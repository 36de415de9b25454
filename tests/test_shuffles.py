"""Joins and merges that move few rows give the rows of the plain ones."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import build, curate, facts, grouped
from factloom.plans import batch
from factloom.session import written


def rows_of(df):
    return Counter(str(sorted(r.asDict(recursive=True).items())) for r in df.collect())


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hot_keys_are_joined_without_moving_their_rows(spark, monkeypatch):
    monkeypatch.setattr(grouped, "HOT_ROWS", 4)
    n = F.col("id")
    key = F.when(n % 10 == 0, None).when(n % 2 == 0, "hot").otherwise(n.cast("string"))
    rows = spark.range(60).select(n.alias("row"), key.alias("k"))
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3), (None, 4), ("x", 5)], "k string, v int")
    got = grouped.join_hot(rows, table, "k")
    assert "strategy=broadcast" in plan_of(got)
    assert rows_of(got) == rows_of(rows.join(table, "k"))
    monkeypatch.setattr(grouped, "HOT_KEYS", 0)
    assert rows_of(grouped.join_hot(rows, table, "k")) == rows_of(rows.join(table, "k"))


def test_names_of_a_whole_graph_are_those_of_single_facts(make_facts, spark, monkeypatch):
    monkeypatch.setattr(grouped, "HOT_ROWS", 4)
    rows = [{"edge_id": f"e{i}", "from_id": "a" if i < 6 else f"p{i}", "to_id": "b" if i % 2 else None,
             "to_day": None if i % 2 else "2024-01-01"} for i in range(9)]
    rows += [{"edge_id": "x", "from_id": "a", "to_id": "nobody"}, {"edge_id": "y", "from_id": "a"},
             {"edge_id": "z", "from_id": None, "to_id": "b"}]
    f = make_facts(*rows)
    e = spark.createDataFrame(
        [("a", "A", "person"), ("b", "B", "company"), ("b", "B2", "company"), ("p7", "P", "project"), (None, "N", "x")],
        "entity_id string, name string, entity_type string",
    )
    whole = facts.with_names(f, e, whole=True)
    assert "strategy=broadcast" in plan_of(whole)
    assert rows_of(whole) == rows_of(facts.with_names(f, e))


CLAIM = (
    "edge_id string, source_record string, position int, confidence string, fact string, source_at timestamp"
)


def claims(spark):
    rows = [("e1", "r1", 0, "stated", "a"), ("e1", "r1", 1, "inferred", "b"), ("e1", "r2", 0, "inferred", "c"),
            ("e2", "r1", 2, "stated", "d"), ("e3", None, 0, None, "e"), ("e4", "r4", 0, "stated", "f"),
            (None, "r5", 0, "stated", "g"), (None, "r5", 1, "stated", "h")]
    return spark.createDataFrame([(*r, None) for r in rows], CLAIM)


def test_only_claims_of_repeated_edges_meet(spark, monkeypatch):
    rows = claims(spark)
    stored = build.dedup_facts(rows.filter("edge_id = 'e4'"))
    known = spark.createDataFrame([("e4", "r4", "stated"), ("e9", "r9", "stated")], "edge_id string, record_id string, confidence string")
    again = build.repeated_edges(rows, [stored, known])
    assert again.count() == 3  # e1, e4 and the null id
    for old, of in ((None, None), (stored, known)):
        assert rows_of(build.dedup_facts(rows, old, again)) == rows_of(build.dedup_facts(rows, old))
        assert rows_of(build.merge_sources(rows, of, again)) == rows_of(build.merge_sources(rows, of))
    monkeypatch.setattr(build, "SENT_EDGES", 2)
    assert build.repeated_edges(rows, [stored, known]) is None


def test_entities_are_merged_in_one_pass_over_the_mentions(spark):
    rows = [("e1", "person", "A", {"email": "a@x", "t": "1"}, "2024-01-02"),
            ("e1", "person", "A", {"email": "b@x", "t": None}, "2024-01-03"),
            ("e1", "person", "A", None, "2024-01-01"), ("e2", "company", "B", {}, "2024-01-01"),
            ("e3", "company", "C", {"domain": None}, None), (None, "person", "D", {"email": "d@x"}, "2024-01-01")]
    m = spark.createDataFrame(rows, "entity_id string, type string, name string, metadata map<string,string>, at string")
    merged = build.merge_entities(m.withColumn("at", F.to_timestamp("at")))
    assert plan_of(merged).count("LogicalRDD") + plan_of(merged).count("LocalRelation") == 1
    got = {r.name: (r.entity_id, r.email, r.domain, r.metadata, str(r.created_at)[:10]) for r in merged.collect()}
    assert got == {
        "A": ("e1", "b@x", None, {"email": "b@x", "t": "1"}, "2024-01-01"),
        "B": ("e2", None, None, None, "2024-01-01"),
        "C": ("e3", None, None, None, "None"),
        "D": (None, None, None, None, "2024-01-01"),
    }


def test_first_connections_and_many_chosen_entities(make_facts, spark, monkeypatch):
    links = [("a", "b"), ("b", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("a", "a"), ("c", "d"), ("e", "a"), ("a", None), ("a", "f")]
    f = make_facts(*[{"edge_id": f"e{i}", "from_id": x, "to_id": y} for i, (x, y) in enumerate(links)])
    e = spark.createDataFrame(
        [("a", "A", "person"), ("b", "Same", "person"), ("c", "Same", "company"), ("d", "D", "project"), ("e", " ", "x"), ("f", "F", "x")],
        "entity_id string, name string, entity_type string",
    )
    chosen = spark.createDataFrame([("a",), ("a",), ("d",), (None,), ("zz",)], "entity_id string")
    top = facts.top_connections_per_entity(f, e, 2)
    every = grouped.top_per_key(facts.connection_names(f, e), ["entity_id"], [F.col("connection")], 2)
    assert rows_of(top) == rows_of(every)
    # the pairs, then the entities: the names are grouped where their entity is ranked
    some = rows_of(facts.top_connections_per_entity(f, e, 2, chosen))
    few = rows_of(facts.top_facts_per_entity(f, 2, chosen))
    assert some == rows_of(every.join(chosen.distinct(), "entity_id")) and few
    monkeypatch.setattr(facts, "HOT_KEYS", 0)
    assert rows_of(facts.top_connections_per_entity(f, e, 2, chosen)) == some
    late = facts.top_facts_per_entity(f, 2, chosen)
    assert rows_of(late) == few and "Window" in plan_of(late).split("Join LeftSemi")[1]


def test_rows_are_limited_after_they_were_moved(spark, make_facts, monkeypatch):
    """Facts of few rows an entity are not sorted before the shuffle; those of a hot one are, and all come out."""
    f = make_facts(*[{"edge_id": f"e{i:03d}", "from_id": "hot" if i < 80 else f"p{i % 9}" if i % 4 else None,
                      "to_id": f"t{i % 5}", "source_at": None if i % 11 == 0 else f"2024-01-{i % 28 + 1:02d}"}
                     for i in range(120)])
    order = facts.newest_first("source_at", "edge_id")
    plain = grouped.top_per_key(facts.facts_both_ways(facts.filter_facts(f)), ["entity_id"], order, 2)
    moved = facts.top_facts_per_entity(f, 2)
    physical = moved._jdf.queryExecution().sparkPlan().toString()
    assert physical.index("WindowGroupLimit") < physical.index("RepartitionByExpression" if "RepartitionByExpression" in physical else "Exchange")
    assert rows_of(moved) == rows_of(plain)
    monkeypatch.setattr(grouped, "SAMPLE", 1)
    parts = grouped.apart(f, "from_id")
    assert len(parts) == 2
    assert {r.from_id for r in parts[1].collect()} == {"hot"}
    assert rows_of(parts[0].unionByName(parts[1])) == rows_of(f)
    monkeypatch.setattr(grouped, "OFTEN", 4)
    assert None in {r.from_id for r in grouped.apart(f, "from_id")[1].collect()}
    assert rows_of(facts.top_facts_per_entity(f, 2)) == rows_of(plain)


def test_claims_side_by_side_are_merged_without_another_shuffle(spark, monkeypatch):
    rows = claims(spark)
    (part,) = grouped.apart(rows, "edge_id")
    sources = build.merge_sources(part).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))
    for df, plain in ((build.dedup_facts(part), build.dedup_facts(rows)),
                      (sources, build.merge_sources(rows).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n")))):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert rows_of(df) == rows_of(plain)


def test_curation_moves_no_fact_where_few_change(spark, make_facts, monkeypatch):
    f = make_facts(*[{"edge_id": f"e{i}", "edge_label": "AFFILIATED", "fact_type": "employee", "fact": "x",
                      "from_id": f"p{i // 2}" if i < 20 else None, "to_id": "b" if i < 24 else None, "to_day": None,
                      "confidence": "inferred" if i % 3 else "stated",
                      "source_at": f"2024-01-{(i % 2 if i < 10 else 0) + 1:02d}"} for i in range(26)])
    s = spark.createDataFrame(
        [(f"e{i}", f"r{k}", "stated" if k else "inferred") for i in range(8) for k in range(i % 3)],
        "edge_id string, record_id string, confidence string",
    )
    done = curate.curate(f, s, "2024-06-01", with_supersession=True)
    assert "Exchange hashpartitioning" not in done._jdf.queryExecution().executedPlan().toString()
    got = {r.edge_id: (r.stale, r.replaced_by, r.confidence) for r in done.collect()}
    for i in range(26):
        lost = i < 10 and i % 2 == 0
        firm = i in (2, 5) or not i % 3
        assert got[f"e{i}"] == (lost, f"e{i + 1}" if lost else None, "stated" if firm else "inferred"), i
    monkeypatch.setattr(curate, "SENT_ROWS", 0)
    assert rows_of(curate.curate(f, s, "2024-06-01", with_supersession=True)) == rows_of(done)


EXTRACTED = (
    "record_id string, record_type string, metadata map<string,string>, created_at timestamp, "
    "entities array<struct<name string, type string, metadata map<string,string>, resolved_to string, "
    "canonical_name string>>, facts array<struct<edge_label string, fact_type string, fact string, "
    "from_entity string, to_entity string, confidence string, valid_until string>>"
)


def test_a_rebuilt_graph_joins_extractions_and_records_once(spark, tmp_path, monkeypatch):
    joined = []
    monkeypatch.setattr(batch, "written", lambda df, name: joined.append(name) or written(df, name))
    e = {"name": "Ann", "type": "person", "metadata": {}, "resolved_to": "new", "canonical_name": "Ann"}
    c = {"edge_label": "ASSERTED", "fact_type": "commitment", "fact": "f", "from_entity": "Ann", "to_entity": None,
         "confidence": "stated", "valid_until": None}
    rows = [(r, "note", {}, datetime(2024, 1, 1), [e], facts) for r, facts in (("r1", [c, c]), ("r2", [c]), ("r3", [c]))]
    x = spark.createDataFrame(rows, EXTRACTED)
    records = x.select("record_id", F.col("record_type").alias("type"), F.lit("t").alias("content"), "metadata", "created_at",
                       F.when(F.col("record_id") != "r3", "relevant").alias("classification"))
    batch.rebuild_graph(records, x, str(tmp_path), "2024-06-01", F.lit("2024-06-01").cast("timestamp"))
    assert joined == ["work"]
    assert sorted(r.source_record for r in spark.read.parquet(f"{tmp_path}/facts").collect()) == ["r1", "r2"]
    assert spark.read.parquet(f"{tmp_path}/entities").count() == 1


def odd_extractions(spark):
    """Records that come twice, say one thing twice, have separators in their ids and texts, or lack parts."""

    def entity(name, resolved="new", canonical=None, kind="person", bag=None):
        return {"name": name, "type": kind, "metadata": bag, "resolved_to": resolved, "canonical_name": canonical or name}

    def claim(fact, source="Ann", target=None, label="asserted", confidence=None, until=None):
        return {"edge_label": label, "fact_type": "commitment", "fact": fact, "from_entity": source, "to_entity": target,
                "confidence": confidence, "valid_until": until}

    ann, bob = entity("Ann", bag={"email": "a@x"}), entity("Bob", "person:1", "Robert")
    twice = [claim("f"), claim("f", confidence="inferred"), claim("f", target="Bob"), claim("g", source="Nobody")]
    rows = [
        ("r1", {"received_at": "2024-01-02T00:00:00Z", "op_area": "intention"}, [ann, bob], twice),
        ("r1", {"received_at": ""}, [ann, bob], [claim("f", confidence="stated", until="2024-02-01"), claim("h")]),
        ("r2", None, [ann, bob], [claim("f", target="Bob", label=None), claim("f", source="Bob")]),
        ("c", {}, [ann], [claim("a\u001fb")]),
        ("b\u001fc", {}, [ann], [claim("a")]),
        ("r3", {}, [ann, None], [claim(None), None, claim(None, target="Bob")]),
        ("r4", {}, None, [claim("f")]), ("r5", {}, [ann], None), ("r6", {}, [], []),
        (None, {}, [ann], [claim("f")]), (None, {}, [ann], [claim("f"), claim("k")]),
    ]
    return spark.createDataFrame(
        [(r, "note", bag, datetime(2024, 1, 1 + i), es, fs) for i, (r, bag, es, fs) in enumerate(rows)], EXTRACTED
    )


TABLES = ("entities", "aliases", "alias_sources", "facts", "fact_sources")


def plain_commit(x, now, stored=None, mode="literal"):
    """As `commit`, but all claims meet by their edge ids."""
    parts = build.commit_parts(x, now, mode=mode)
    old = [None, None] if stored is None else [stored.facts, stored.fact_sources]
    facts = build.dedup_facts(parts.claims, old[0])
    return {"facts": facts if stored is None else stored.facts.unionByName(facts),
            "fact_sources": build.merge_sources(parts.claims, old[1])}


def test_a_rebuilt_graph_makes_its_ids_once(spark, tmp_path, monkeypatch):
    x, now, made = odd_extractions(spark), F.lit("2024-06-01").cast("timestamp"), []
    monkeypatch.setattr(batch, "commit", lambda *a, **k: made.append(build.commit(*a, **k)) or made[0])
    records = x.select("record_id", F.col("record_type").alias("type"), F.lit("t").alias("content"), "metadata", "created_at",
                       F.lit("relevant").alias("classification")).dropDuplicates(["record_id"])
    batch.rebuild_graph(records, x, str(tmp_path), "2024-06-01", now)
    for name in TABLES:
        assert "sha2(" not in plan_of(getattr(made[0], name)), name
    for mode in ("literal", "merge"):
        work = written(build.with_claims(x, mode=mode), "work")
        got, want = build.commit(work, now, mode=mode), build.commit(x, now, mode=mode)
        for name in TABLES:
            assert rows_of(getattr(got, name)) == rows_of(getattr(want, name)), (mode, name)
            assert getattr(got, name).columns == getattr(want, name).columns
        for name, df in plain_commit(x, now, mode=mode).items():
            assert rows_of(getattr(got, name)) == rows_of(df), (mode, name)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_a_commit_on_top_compares_records_not_claims(spark, monkeypatch, most):
    x, now, plans = odd_extractions(spark), F.lit("2024-06-01").cast("timestamp"), {}
    monkeypatch.setattr(build, "written", lambda df, name: plans.update({name: plan_of(df)}) or written(df, name))
    monkeypatch.setattr(build, "SENT_EDGES", most)
    early = F.dayofmonth("created_at") % 2 == 0
    for first in (early, ~early, F.lit(False), F.lit(True)):
        before = build.commit(x.filter(first), now, keep_records=True)
        got = build.commit(x.filter(~first), now, stored=before, keep_records=True)
        assert all("sha2(" not in plan for name, plan in plans.items() if name != "repeated-edges")
        assert ("repeated-edges" in plans) == (most == 0)
        third = build.commit(x.limit(3), now, stored=got)
        for name, df in plain_commit(x.filter(~first), now, stored=before).items():
            assert rows_of(getattr(got, name)) == rows_of(df), name
            assert rows_of(getattr(third, name)) == rows_of(df), name


def test_claims_of_no_repeated_record_are_not_split(spark):
    x = odd_extractions(spark).filter("record_id IN ('r5', 'c')")
    now = F.lit("2024-06-01").cast("timestamp")
    made = build.commit(x, now)
    assert "Exchange" not in plan_of(made.facts) and "Join" not in plan_of(made.facts)
    assert rows_of(made.facts) == rows_of(plain_commit(x, now)["facts"])


def test_facts_about_days_do_not_meet_where_ends_are_named(spark):
    from factloom.plans import queries_build

    x, now = odd_extractions(spark), F.lit("2024-06-01").cast("timestamp")
    made = build.commit(x, now)
    named = queries_build._with_ends(made)
    assert "none of " in named._jdf.queryExecution().optimizedPlan().toString()
    names = {r.entity_id: r.name for r in made.entities.collect()}
    got = sorted((r.fact or "", r.to_day is None, r.to_ref or "") for r in named.collect())
    assert got == sorted((r.fact or "", r.to_day is None, names.get(r.to_id, r.to_id) or "")
                         for r in made.facts.collect() if r.from_id in names)
