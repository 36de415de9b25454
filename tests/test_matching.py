"""Containment by rare grams, near names by trigrams, and vector search over an index."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import ivf, records, resolve, vectors
from factloom.operators.grouped import containing, near_names, segments


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_containment_against_plain_python(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcé🙂 ", k=n))
    needles = [word(rng.choice([1, 2, 3, 5, 8, 9, 17, 40])) for _ in range(60)] + ["", None]
    texts = [word(rng.choice([0, 1, 3, 30, 255, 256, 257, 700])) for _ in range(60)] + [None]
    # needles that stand across the borders of segments
    long = "".join(rng.choices("xyz", k=3000))
    texts.append(long)
    needles += [long[k : k + n] for k, n in ((250, 10), (240, 300), (0, 256), (511, 2), (2990, 10), (100, 700))]
    n = spark.createDataFrame([(k, x) for k, x in enumerate(needles)], "k int, needle string")
    t = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "t int, text string")
    want = sorted((k, j) for k, x in enumerate(needles) if x for j, y in enumerate(texts) if y and x in y)
    assert pairs(containing(n, "needle", t, "text"), "k", "t") == want
    typed = lambda df, c: df.withColumn("kind", F.col(c) % 2)
    got = containing(typed(n, "k"), "needle", typed(t, "t"), "text", on=["kind"])
    assert pairs(got, "k", "t") == [(a, b) for a, b in want if a % 2 == b % 2]
    assert containing(n.limit(0), "needle", t, "text").count() == 0
    assert containing(n, "needle", t.limit(0), "text").count() == 0


def test_work_grows_with_the_length_of_a_text(spark):
    """A text of 10,000 addresses: segments of bounded size, and no row with all of it meets a needle."""
    text = ", ".join(f"person {k:05d} <p{k:05d}@n.example>" for k in range(10_000))
    t = spark.createDataFrame([(1, text)], "t int, text string")
    cut = segments(t, "text", 20).select(F.max(F.length("_segment")), F.count("*")).first()
    assert cut[0] <= 256 + 20 and cut[1] == -(-len(text) // 256)
    n = spark.range(0, 12_000).select(F.format_string("p%05d@n.example", "id").alias("needle"), "id")
    found = containing(n, "needle", t, "text")
    assert "text" not in found.columns and found.count() == 10_000


def test_mail_to_very_many_recipients(spark):
    everyone = ", ".join(f"P{k:05d} <p{k:05d}@n.example>" for k in range(10_000))
    mail = spark.createDataFrame(
        [("m1", "2024-01-02T00:00:00Z", "boss@n.example", everyone), ("m2", "2024-01-01T00:00:00Z", "P00007@N.example", "x")],
        "record_id string, received_at string, sender string, recipients string",
    )
    people = spark.range(9_990, 10_010).select(
        F.concat(F.lit("e"), "id").alias("entity_id"), F.lit(None).cast("string").alias("name"),
        F.format_string("p%05d@n.example", "id").alias("email"),
    )
    seven = spark.createDataFrame([("e7", "P00007", "p00007@n.example")], people.schema)
    got = records.communications_of_all(mail, people.unionByName(seven))
    assert pairs(got, "entity_id", "record_id") == sorted([(f"e{k}", "m1") for k in range(9_990, 10_000)] + [("e7", "m1"), ("e7", "m2")])


def trigrams(text):
    padded = f"  {text} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


@pytest.mark.parametrize("share", [0.4, 0.7, 1.0])
def test_near_names_against_plain_python(spark, share):
    rng = random.Random(8)
    name = lambda: "".join(rng.choices("abcd", k=rng.randint(1, 9)))
    a, b = sorted({name() for _ in range(80)}), sorted({name() for _ in range(80)} | {""})
    got = near_names(
        spark.createDataFrame([(x,) for x in a], "x string"), "x", spark.createDataFrame([(y,) for y in b], "y string"), "y", share
    )
    want = []
    for x in a:
        for y in b:
            both = len(trigrams(x) & trigrams(y))
            similarity = both / len(trigrams(x) | trigrams(y))
            if y and similarity >= share - 1e-9:
                want.append((x, y, round(similarity, 9)))
    assert sorted((r.x, r.y, round(r.similarity, 9)) for r in got.collect()) == sorted(want)


def test_totals_of_candidates_and_limits(spark, make_entities):
    e = make_entities(
        *[(f"p{k:02d}", "person", "Same Name") for k in range(9)],
        *[(f"q{k}", "person", f"Longer Title {k}", f"t{k}@x") for k in range(7)],
        ("r1", "person", "Katherine Johnson"), ("r2", "person", "Catherine Jonson"), ("r3", "project", "Katherine Jonson"),
    )
    m = spark.createDataFrame(
        [("person", "same name", None), ("person", "title", None), ("person", "Katherine Jonson", None), ("person", "zzz", None)],
        "entity_type string, name string, identifier string",
    )
    aliases = spark.createDataFrame([], "entity_id string, surface_form string")
    rows = resolve.resolve_entities(m, e, aliases).collect()
    by = {}
    for r in rows:
        by.setdefault(r.name, []).append(r)
    assert [r.entity_id for r in sorted(by["same name"])] == [f"p{k:02d}" for k in range(5)]
    assert {r.n_candidates for r in by["same name"]} == {9} and {r.via for r in by["same name"]} == {"exact_name_ambiguous"}
    assert len(by["title"]) == 3 and {r.n_candidates for r in by["title"]} == {7}
    assert by["zzz"][0].match == "none" and by["zzz"][0].n_candidates == 0 == by["Katherine Jonson"][0].n_candidates
    near = resolve.resolve_entities(m, e, aliases, max_candidates=20, max_fuzzy=1, near=0.5).collect()
    assert sum(r.name == "same name" for r in near) == 9 and sum(r.name == "title" for r in near) == 1
    (kj,) = [r for r in near if r.name == "Katherine Jonson"]
    assert (kj.entity_id, kj.via, kj.n_candidates) == ("r1", "near_name", 2)


VECTORS = "record_id string, embedding array<float>"


def test_many_queries_exact_and_indexed(spark, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK", 64)
    monkeypatch.setattr(ivf, "PACKET", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[:500] = x[0]  # a third of all vectors are equal
    rows = [(f"r{k:04d}", v.tolist()) for k, v in enumerate(x)] + [("zero", [0.0] * 16), ("null", None)]
    index = ivf.build(spark.createDataFrame(rows, VECTORS), lists=20)
    assert index.blocks.count() > 20 and index.blocks.agg(F.max(F.size("ids"))).first()[0] < 130
    asked = [(f"q{k}", v.tolist()) for k, v in enumerate(rng.permutation(x)[:200] + np.float32(0.01))]
    asked += [("self", x[0].tolist()), ("none", [0.0] * 16)]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    exact = ivf.search_many(index, queries, 7, probes=20).collect()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for q, v in asked[:200:20]:
        score = unit @ (np.float64(v) / np.linalg.norm(np.float64(v)))
        own = sorted((r for r in exact if r.query_id == q), key=lambda r: r["rank"])
        assert np.allclose([r.score for r in own], np.sort(score)[::-1][:7]) and [r["rank"] for r in own] == list(range(1, 8))
    assert [r.record_id for r in exact if r.query_id == "self"] == [f"r{k:04d}" for k in range(7)]
    assert not [r for r in exact if r.query_id == "none"]
    one = vectors.vector_search(spark.createDataFrame(rows[:-1], VECTORS), asked[3][1], 7).collect()
    assert [r.record_id for r in one] == [r.record_id for r in sorted((r for r in exact if r.query_id == "q3"), key=lambda r: r["rank"])]
    few = ivf.search_many(index, queries, 7, probes=6)
    told = ivf.recall(few, ivf.search_many(index, queries, 7, probes=20)).first()
    assert told.queries == 201 and told.pairs == 201 * 7 and 0.95 <= told.recall <= 1


def test_vectors_of_another_length_are_an_error(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], VECTORS)
    with pytest.raises(Exception, match="2 numbers"):
        vectors.vector_search(rows, [1.0, 0.0], 1).collect()
    with pytest.raises(Exception, match="numbers"):
        ivf.build(rows)
    index = ivf.build(rows.limit(1))
    with pytest.raises(Exception, match="2 numbers"):
        ivf.search_many(index, spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<float>")).collect()
    empty = ivf.build(rows.limit(0))
    assert empty.blocks.count() == 0


def test_grams_of_many_needles_are_not_broadcast(spark, monkeypatch):
    n = spark.createDataFrame([(i, f"name {i:03d}") for i in range(40)], "k int, needle string")
    t = spark.createDataFrame([(i, f"to name {i:03d}, name {i + 1:03d}") for i in range(40)], "t int, text string")
    monkeypatch.setattr("factloom.operators.grouped.FEW_NEEDLES", 39, raising=False)
    found = containing(n, "needle", t, "text")
    assert {(r.k, r.t) for r in found.collect()} == {(i + d, i) for i in range(40) for d in (0, 1) if i + d < 40}
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_vector_is_copied_for_each_list_and_a_task_keeps_the_best_of_all_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK", 8)
    monkeypatch.setattr(ivf, "PACKET", 16)
    x = np.random.default_rng(4).normal(size=(600, 8)).round(2)
    rows = spark.createDataFrame([(f"r{k:04d}", v.tolist()) for k, v in enumerate(x)], VECTORS)
    index, sizes, keep = ivf.build(rows, lists=40), {}, ivf.written

    def counted(df, name):
        out = keep(df, name)
        sizes[name] = out.agg(F.sum(F.size("query_ids"))).first()[0] if "query_ids" in out.columns else out.count()
        return out

    monkeypatch.setattr(ivf, "written", counted)
    asked = rows.withColumnRenamed("record_id", "query_id")
    for probes, least in ((40, 1.0), (30, 0.9)):
        found = ivf.search_many(index, asked, 3, probes).collect()
        tasks = spark.sparkContext.defaultParallelism
        assert sizes["found"] <= 600 * 3 * tasks and {v for k, v in sizes.items() if "packets" in k} == {600}
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        best = np.sort(unit @ unit.T, axis=1)[:, ::-1][:, :3]
        got = {(r.query_id, r["rank"]): r.score for r in found}
        right = [np.isclose(got[f"r{k:04d}", j + 1], best[k, j]) for k in range(600) for j in range(3)]
        assert np.mean(right) >= least
