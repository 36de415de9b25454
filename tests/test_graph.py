"""Build, curation, traversal and bundles on small graphs."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from factloom.operators import build, curate, resolve, traverse, validate
from factloom.plans import batch, bundles
from factloom.session import durable

EXTRACTION = (
    "record_id string, record_type string, content string, metadata map<string,string>, "
    "created_at timestamp, entities array<struct<name:string,type:string,"
    "metadata:map<string,string>,resolved_to:string,canonical_name:string>>, "
    "facts array<struct<edge_label:string,fact_type:string,fact:string,from_entity:string,"
    "to_entity:string,confidence:string,valid_until:string>>"
)
AT = datetime(2026, 3, 21, 2)


def now():
    return F.lit("2026-04-01").cast("timestamp")


def entity(name, kind="person", bag=None, to="new", canonical=None):
    return (name, kind, bag or {}, to, canonical or name)


def claim(source, target, text="t", label="AFFILIATED", kind="employee", confidence="stated"):
    return (label, kind, text, source, target, confidence, None)


@pytest.fixture()
def make_extractions(spark):
    def make(*rows):
        full = [(i, "email", "", {}, AT, e, f) for i, e, f in rows]
        return spark.createDataFrame(full, EXTRACTION)

    return make


def test_commit_resolves_names_within_the_record(make_extractions):
    x = make_extractions(
        ("r1", [entity("Ann"), entity("Bolt", "company")], [claim("Ann", "Bolt"), claim("Zed", "Bolt")]),
        ("r2", [entity("Ann", to="id-7", canonical="Ann Lee")], [claim("Ann", "Bolt", "alone")]),
    )
    made = build.commit(x, now())
    rows = {r.fact: r for r in made.facts.collect()}
    assert set(rows) == {"t", "alone"}
    assert rows["t"].to_id is not None and rows["t"].to_day is None
    assert rows["alone"].from_id == "id-7"
    assert str(rows["alone"].to_day) == "2026-03-20"
    alias = made.aliases.first()
    assert (alias.entity_id, alias.surface_form, alias.confidence) == ("id-7", "Ann", "inferred")


def test_merge_key_is_case_sensitive_and_uses_the_identifier(make_extractions):
    x = make_extractions(
        (
            "r1",
            [
                entity("Ann", bag={"email": "a@x"}),
                entity("Ann", bag={"email": "a@y"}),
                entity("ann", bag={"email": "a@x"}),
                entity("Ann", bag={"email": "a@x", "role": "boss"}),
            ],
            [],
        ),
    )
    merged = build.commit(x, now()).entities
    assert merged.count() == 3
    assert merged.filter("name = 'Ann' AND email = 'a@x'").first().metadata["role"] == "boss"


def test_literal_and_merged_duplicates(make_extractions):
    people = [entity("Ann"), entity("Bolt", "company")]
    x = make_extractions(
        ("r1", people, [claim("Ann", "Bolt", confidence="inferred"), claim("Ann", "Bolt")]),
        ("r2", people, [claim("Ann", "Bolt")]),
    )
    literal, merged = build.commit(x, now()), build.commit(x, now(), mode="merge")
    assert literal.facts.count() == 2 and literal.fact_sources.count() == 2
    assert merged.facts.count() == 1 and merged.fact_sources.count() == 2
    assert merged.facts.first().confidence == "inferred"
    lifted = curate.upgrade_confidence(merged.facts, merged.fact_sources)
    assert lifted.first().confidence == "stated"


def test_committing_again_adds_nothing(make_extractions):
    x = make_extractions(("r1", [entity("Ann")], [claim("Ann", None)]))
    ids = build.with_entity_ids(x)
    rows = build.commit_facts(ids, now())
    first = build.dedup_facts(rows)
    assert build.dedup_facts(rows, stored=first).count() == 0
    sources = build.merge_sources(rows)
    assert build.merge_sources(rows, stored=sources).count() == sources.count()


def test_stored_entities_keep_time_and_other_properties(spark, make_entities, make_extractions):
    x = make_extractions(("r1", [entity("Ann", bag={"role": "boss"})], []))
    fresh = build.commit(x, now()).entities
    old = fresh.withColumns(
        {
            "metadata": F.create_map(F.lit("role"), F.lit("clerk"), F.lit("k"), F.lit("v")),
            "created_at": F.lit("2020-01-01").cast("timestamp"),
        }
    )
    mentions = build.new_mentions(build.with_entity_ids(x))
    row = build.merge_entities(mentions, stored=old).first()
    assert row.metadata == {"k": "v", "role": "boss"}
    assert row.created_at == datetime(2020, 1, 1)


def test_seed_aliases_map_to_their_canonical(make_extractions):
    x = make_extractions(
        (
            "ingest_1",
            [entity("A. Lee", canonical="Ann Lee"), entity("Ann Lee"), entity("Ghost", canonical="Nobody")],
            [claim("A. Lee", None), claim("Ghost", None, "lost")],
        ),
    )
    made = build.commit(x, now(), seed=True)
    assert [r.name for r in made.entities.collect()] == ["Ann Lee"]
    assert [(r.surface_form, r.confidence) for r in made.aliases.collect()] == [("A. Lee", "stated")]
    assert [r.fact for r in made.facts.collect()] == ["t"]


def test_validation_reports(spark, make_extractions, make_entities):
    x = make_extractions(
        (
            "r1",
            [entity("Ann"), entity("Bob", to="gone")],
            [claim("ANN", "Nobody", "words not there"), claim("Ann", None, "", label="CLAIMED")],
        ),
    )
    errors = {(r.error, r.detail) for r in validate.fact_errors(x).collect()}
    assert errors == {
        ("unknown_to", "Nobody"),
        ("low_grounding", "words not there"),
        ("invalid_label", "CLAIMED"),
    }
    missing = validate.unknown_resolutions(x, make_entities(("a", "person", "Ann")))
    assert [r.name for r in missing.collect()] == ["Bob"]


def test_curation_invariants(spark, tables):
    # The smallest data folder repeats one order line, so its edge id; ids are unique here.
    f, s = durable(tables.facts().dropDuplicates(["edge_id"])), tables.fact_sources()
    seen = Observation("curation")
    once = curate.curate(f, s, "1998-01-01", with_supersession=True, observation=seen)
    assert once.count() == f.count()
    assert seen.get["expired"] > 0
    assert once.filter("edge_label = 'TRANSITIONED' AND stale").count() == 0
    twice = curate.curate(once, s, "1998-01-01", with_supersession=True)
    assert once.exceptAll(twice).count() == 0
    # Every chain of replacements ends in a row that nothing replaces.
    ends = once.select(F.col("edge_id").alias("replaced_by"), F.col("source_at").alias("next_at"))
    linked = once.filter("replaced_by IS NOT NULL").join(ends, "replaced_by", "left")
    assert linked.filter("next_at IS NULL OR next_at <= source_at").count() == 0


def test_traversal_matches_brute_force(spark, make_facts, make_entities):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "f"), ("e", "g")]
    f = make_facts(
        *[{"edge_id": f"{i}", "from_id": x, "to_id": y} for i, (x, y) in enumerate(pairs)],
        {"edge_id": "day1", "from_id": "e", "to_day": "2024-01-01"},
        {"edge_id": "day2", "from_id": "z", "to_day": "2024-01-01"},
        {"edge_id": "old", "from_id": "a", "to_id": "z", "stale": True},
    )
    e = make_entities(*[(x, "person", x.upper()) for x in "abcdefgz"])
    found = traverse.connections(f, e, "a", depth=3)
    assert {r.node: r.depth for r in found.nodes.collect()} == {"b": 1, "c": 1, "d": 2, "e": 3}
    assert {r.edge_id for r in found.edges.collect()} == {"0", "1", "2", "3", "4"}
    stale = traverse.connections(f, e, "a", depth=1, include_stale=True, include_start=True)
    assert {r.node for r in stale.nodes.collect()} == {"a", "b", "c", "z"}
    path = traverse.shortest_path(f, e, "a", "z", max_depth=5).orderBy("hop").collect()
    assert [r.edge_id for r in path] == ["2", "3", "4", "day1", "day2"]
    assert [r.direction for r in path] == ["incoming", "outgoing", "outgoing", "outgoing", "incoming"]
    assert traverse.shortest_path(f, e, "a", "z").count() == 0
    assert traverse.shortest_path(f, e, "a", "f").count() == 0


def test_resolution_cascade(spark, make_entities):
    e = make_entities(
        ("p1", "person", "Ann Lee", "ann@x", None),
        ("p2", "person", "Ann Lee", "lee@x", None),
        ("p3", "person", "Bo Ray", "bo@x", None),
        ("c1", "company", "Bolt", None, "bolt.example"),
        *[(f"q{i}", "project", "Same") for i in range(9)],
    )
    a = spark.createDataFrame([("p3", "Bobby"), ("p1", "Al"), ("p2", "AL")], "entity_id string, surface_form string")
    m = spark.createDataFrame(
        [
            ("person", "whoever", "BO@X"),
            ("person", "ann lee", None),
            ("person", "bo ray", ""),
            ("person", "bobby", None),
            ("person", "al", None),
            ("company", "bolt.ex", None),
            ("project", "same", None),
            ("person", "nobody", None),
        ],
        "entity_type string, name string, identifier string",
    )
    got = {}
    for r in resolve.resolve_entities(m, e, a).collect():
        got.setdefault(r.name, (r.match, r.via, []))[2].append(r.entity_id)
    assert got["whoever"] == ("definitive", "identifier", ["p3"])
    assert got["bo ray"] == ("definitive", "exact_name", ["p3"])
    assert got["ann lee"][1] == "exact_name_ambiguous" and sorted(got["ann lee"][2]) == ["p1", "p2"]
    assert got["bobby"] == ("definitive", "alias", ["p3"])
    assert got["al"][1] == "alias_ambiguous"
    assert got["bolt.ex"] == ("candidates", "fuzzy_name", ["c1"])
    assert len(got["same"][2]) == 5
    assert got["nobody"] == ("none", None, [None])


def test_bundle_errors(make_facts, make_entities, make_records):
    e = make_entities(("a", "person", "Ann"))
    f, r = make_facts({"edge_id": "1", "from_id": "a", "to_day": "2024-01-01"}), make_records({"record_id": "r"})
    with pytest.raises(ValueError):
        bundles.entity_context(f, e, r, "Ann", format="other")
    with pytest.raises(bundles.NotFound):
        bundles.entity_context(f, e, r, "Nobody")
    made = bundles.entity_context(f, e, r, "ann")
    assert made.facts.count() == 1 and made.connections.count() == 0
    assert made.related_records.first().record_id == "r"


def test_whole_batch(spark, make_records, make_extractions):
    new = make_records(
        {"record_id": "r1", "dedup_key": "k1", "created_at": "2024-01-01"},
        {"record_id": "r2", "dedup_key": "k1", "created_at": "2024-01-02"},
        {"record_id": "r3", "dedup_key": "k3", "created_at": "2024-01-03"},
    )
    decisions = spark.createDataFrame(
        [("r1", "relevant", "intention"), ("r3", "noise", None)],
        "record_id string, classification string, op_area string",
    )
    x = make_extractions(
        ("r1", [entity("Ann")], [claim("Ann", None)]), ("r3", [entity("Bob")], [claim("Bob", None)])
    )
    g = batch.records_to_graph(new, decisions, x, "2024-06-01", now())
    assert [r.name for r in g.entities.collect()] == ["Ann"]
    assert [r.op_area for r in g.facts.collect()] == ["intention"]
    assert {r.record_id: (r.classification, r.indexed) for r in g.records.collect()} == {
        "r1": ("relevant", True),
        "r3": ("noise", False),
    }


def plain_path(edges, a, b, max_depth):
    """The smallest edge list among shortest paths, level by level."""
    best, seen = {a: []}, {a}
    for _ in range(max_depth):
        found = {}
        for edge, x, y in edges:
            for here, there in ((x, y), (y, x)):
                if here in best and there not in seen:
                    found[there] = min(found.get(there, ["~"]), [*best[here], edge])
        best = found
        seen |= set(found)
        if b in best:
            return best[b]
    return []


@pytest.mark.parametrize("limit", [200_000, 0])
def test_paths_between_all_pairs_against_plain_search(spark, make_facts, make_entities, monkeypatch, limit):
    monkeypatch.setattr(traverse, "BROADCAST_ROWS", limit)
    rng = random.Random(11)
    nodes = [f"n{k}" for k in range(14)]
    pairs = [(f"e{rng.randrange(10**6):06d}-{k}", rng.choice(nodes), rng.choice(nodes)) for k in range(22)]
    f = make_facts(*[{"edge_id": i, "from_id": x, "to_id": y} for i, x, y in pairs])
    e = make_entities(*[(n, "person", n.upper()) for n in nodes])
    links = traverse.adjacency(f, "test_adjacency", 4)
    try:
        for a, b in [rng.sample(nodes, 2) for _ in range(4)]:
            want = plain_path(pairs, a, b, 4)
            for table in (None, links):
                found = traverse.shortest_path(f, e, a, b, links=table).orderBy("hop").collect()
                assert [r.edge_id for r in found] == want
    finally:
        spark.sql("DROP TABLE IF EXISTS test_adjacency")


def test_a_hub_is_not_flooded(spark, make_entities, make_facts, monkeypatch):
    """From a hub of many edges and a node of one: the small end grows."""
    hub = spark.range(20_000).selectExpr("concat('h', id) AS edge_id", "'hub' AS from_id", "concat('leaf', id) AS to_node")
    tail = spark.createDataFrame(
        [("t0", "a", "x"), ("t1", "x", "y"), ("t2", "leaf7", "y"), ("s", "a", "s0")], "edge_id string, from_id string, to_node string"
    )
    grown = []
    meet = traverse._Side.meet

    def counted(self, other, ahead):
        found = meet(self, other, ahead)
        grown.append(self.count)
        return found

    monkeypatch.setattr(traverse._Side, "meet", counted)
    assert traverse._search(hub.unionByName(tail), "a", "hub", 4, None) == ["t0", "t1", "t2", "h7"]
    assert sorted(grown)[-1] == 20_000 and sum(n for n in grown if n < 20_000) <= 6


def test_links_are_joined_without_an_exchange(spark, make_facts):
    f = make_facts(*[{"edge_id": f"e{k}", "from_id": f"n{k}", "to_id": f"n{k + 1}"} for k in range(40)])
    links = traverse.adjacency(f, "test_links", 4)
    try:
        side = traverse._Side(
            links.select("node").distinct().withColumn("path", F.expr("cast(array() as array<string>)")), links, 10**9
        )
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = traverse._touching(links, side, links)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 1  # of the frontier, not of the table
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE IF EXISTS test_links")
