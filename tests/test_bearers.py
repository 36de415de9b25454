"""Bearers of one name: who joins whom, and that the order of batches plays no part."""

from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import functions as F

from factloom.operators import build
from factloom.operators.bearers import bearers, unified
from factloom.operators.grouped import connected
from factloom.schema import ALIASES, ENTITIES


def entities(spark, *rows):
    full = [(i, kind, name, email, domain, {"from": i}, datetime(2024, 1, 1 + k % 28)) for k, (i, kind, name, email, domain) in enumerate(rows)]
    return spark.createDataFrame(full, ENTITIES)


def aliases(spark, *rows):
    blank = {f.name: None for f in ALIASES}
    return spark.createDataFrame(
        [tuple({**blank, "entity_id": i, "surface_form": form, "confidence": "stated"}.values()) for i, form in rows], ALIASES
    )


def outcome(df):
    return {r.entity_id: (r.canonical_id, r.outcome, r.candidates) for r in df.collect()}


def test_components_of_chains_and_stars(spark):
    links = [(f"c{k}", f"c{k + 1}") for k in range(40)] + [("hub", f"leaf{k}") for k in range(300)] + [("x", "x"), ("y", "z"), ("z", "y")]
    got = {r.id: r.component for r in connected(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {got[f"c{k}"] for k in range(41)} == {"c0"}
    assert {got[f"leaf{k}"] for k in range(300)} == {"hub"} == {got["hub"]}
    assert got["z"] == got["y"] == "y" and "x" not in got
    assert connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_name_joins_its_only_bearer(spark):
    e = entities(
        spark,
        ("a1", "person", "Ann", None, None), ("a2", "person", "Ann", "ann@x", None),
        ("b1", "person", "Bob", None, None), ("b2", "person", "Bob", "b@x", None), ("b3", "person", "Bob", "b@y", None),
        # the type tells names apart, and a blank identifier is none
        ("c1", "company", "Ann", " ", None), ("d1", "company", "Dash", None, None), ("d2", "company", "Dash", None, "dash.example"),
        # an email says nothing of a company, and projects have no identifier
        ("p1", "project", "Ann", "ann@x", None),
        # by alias, in two steps: Annie is an alias of the unidentified Ann
        ("n1", "person", "Annie", None, None), ("o1", "person", "Orla", None, None), ("o2", "person", "Ola", None, None),
    )
    known = aliases(spark, ("a1", "Annie"), ("o1", "Ola"), ("o2", "Orla"), ("b2", "Bobby"), ("a1", "Ann"))
    got = outcome(bearers(e, known))
    assert got["a1"] == ("a2", "joined", 1) and got["a2"] == ("a2", "own", 0)
    assert got["b1"] == ("b1", "ambiguous", 2) and got["b2"][1] == "own"
    assert got["c1"] == ("c1", "own", 0) and got["d1"] == ("d2", "joined", 1) and got["p1"][1] == "own"
    assert got["n1"] == ("a2", "joined", 1)
    assert got["o1"] == ("o1", "own", 1) and got["o2"] == ("o1", "joined", 1)


def test_a_hot_name(spark):
    """Thousands of bearers of one name: each is counted once, and one row says how many."""
    many = spark.range(5000).select(
        F.concat(F.lit("h"), "id").alias("entity_id"), F.lit("person").alias("entity_type"), F.lit("Li").alias("name"),
        F.when(F.col("id") > 0, F.concat("id", F.lit("@x"))).alias("email"), F.lit(None).cast("string").alias("domain"),
        F.expr("cast(map() as map<string,string>)").alias("metadata"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    got = bearers(many, aliases(spark)).groupBy("outcome").agg(F.count("*"), F.max("candidates")).collect()
    assert sorted(tuple(r) for r in got) == [("ambiguous", 1, 4999), ("own", 4999, 0)]


def extraction(spark, rows):
    from test_streams import extraction as one

    return one(spark, *rows)


ROWS = [
    ("r1", "Ann", {"role": "cto"}, "2024-01-01", None, "relevant"),
    ("r2", "Ann", {"email": "ann@x", "team": "t"}, "2024-03-01", None, "relevant"),
    ("r3", "Bob", {}, "2024-02-01", None, "relevant"),
    ("r4", "Bob", {"email": "b@x"}, "2024-04-01", None, "relevant"),
    ("r5", "Bob", {"email": "b@y"}, "2024-05-01", None, "relevant"),
    ("r6", "Ann", {}, "2024-06-01", None, "relevant"),
]


def test_unified_tables_in_any_order_of_batches(spark):
    now = F.lit("2024-06-01").cast("timestamp")

    def rows(df):
        return sorted(str(sorted(r.asDict(recursive=True).items(), key=str)) for r in df.collect())

    seen = []
    for order in (range(6), (5, 3, 1, 4, 0, 2)):
        stored = None
        for cut in (list(order)[:3], list(order)[3:]):
            stored = build.commit(extraction(spark, [ROWS[k] for k in cut]), now, stored=stored)
        made = unified(stored)
        seen.append({n: rows(getattr(made, n)) for n in ("entities", "facts", "fact_sources", "bearers")})
    assert seen[0] == seen[1]
    by_name = {(r.name, r.email): r for r in made.entities.collect()}
    assert set(by_name) == {("Ann", "ann@x"), ("Bob", None), ("Bob", "b@x"), ("Bob", "b@y")}
    ann = by_name["Ann", "ann@x"]
    assert ann.metadata == {"email": "ann@x", "team": "t", "role": "cto"} and ann.created_at == datetime(2024, 1, 1)
    anns = made.facts.filter(F.col("fact") == "Ann works")
    assert anns.count() == 3 and {r.from_id for r in anns.collect()} == {ann.entity_id}
    # as one claim of several records
    merged = unified(build.commit(extraction(spark, ROWS), now, mode="merge"), mode="merge")
    claims = merged.facts.filter(F.col("fact") == "Ann works").collect()
    assert {r.to_day for r in claims} and len({r.edge_id for r in claims}) == len(claims)
    assert merged.fact_sources.count() == 6


def test_random_graphs_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(f"e{k:02d}", "person", f"N{rng.randrange(12)}", f"m{k}@x" if rng.random() < 0.35 else None, None) for k in range(40)]
    # one entity of a name without an identifier, as committed tables have it
    seen, kept = set(), []
    for r in rows:
        if r[3] or r[2] not in seen:
            kept.append(r)
        if not r[3]:
            seen.add(r[2])
    known = {(rng.choice(kept)[0], f"N{rng.randrange(12)}") for _ in range(8)}
    got = outcome(bearers(entities(spark, *kept), aliases(spark, *sorted(known))))
    links, counts = [], {}
    for i, _, name, email, _ in kept:
        if email:
            continue
        who = {j for j, _, n, m, _ in kept if m and n == name} | {j for j, form in known if form == name and j != i}
        counts[i] = len(who)
        if len(who) == 1:
            links.append((i, who.pop()))
    parent = {r[0]: r[0] for r in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    groups = {}
    for r in kept:
        groups.setdefault(find(r[0]), []).append(r)
    for members in groups.values():
        head = min(members, key=lambda r: (r[3] is None, r[0]))[0]
        for i, *_ in members:
            want = "ambiguous" if counts.get(i, 0) > 1 else "joined" if head != i else "own"
            assert got[i] == (head if len(members) > 1 else i, want, counts.get(i, 0))
