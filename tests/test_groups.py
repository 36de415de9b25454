"""Work inside hot groups against plain Python, and the shape of the plans."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators import grouped
from factloom.plans.registry import catalogue

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, with ties and empty hours."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(60)}"
        rows.append((f"e{i:04d}", key, START + timedelta(minutes=rng.randrange(3000) * 7)))
    return rows


@pytest.mark.parametrize("forward", [True, False])
def test_neighbour_equals_brute_force(spark, skewed, forward):
    df = spark.createDataFrame(skewed, "edge_id string, key string, ts timestamp")
    out = grouped.neighbour(df, ["key"], "ts", ["edge_id"], "n", forward=forward)
    got = {r.edge_id: (r.n.edge_id if r.n else None) for r in out.collect()}
    assert len(got) == len(skewed)
    for edge, key, ts in skewed:
        if forward:
            later = [(t, e) for e, k, t in skewed if k == key and t > ts]
            want = min(later)[1] if later else None
        else:
            before = [t for _, k, t in skewed if k == key and t < ts]
            want = (
                min(e for e, k, t in skewed if k == key and t == max(before)) if before else None
            )
        assert got[edge] == want


def test_running_total_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"r{i % 7}", i, rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "run string, pos long, v long")
    out = grouped.running_total(df, ["run"], "pos", ["v"], width=16)
    for r in out.collect():
        assert r.running_v == sum(v for run, p, v in rows if run == r.run and p <= r.pos)


def test_containing_equals_brute_force(spark):
    rng = random.Random(7)
    texts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(80)}
    needles = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(30)}
    t = spark.createDataFrame([(x, x) for x in texts], "text string, key string")
    n = spark.createDataFrame([(x,) for x in needles] + [("",)], "needle string")
    got = {(r.needle, r.key) for r in grouped.containing(n, "needle", t, "text").collect()}
    assert got == {(a, b) for a in needles for b in texts if a in b}


def test_top_per_key_limits_before_the_shuffle(spark, skewed):
    df = spark.createDataFrame(skewed, "edge_id string, key string, ts timestamp")
    top = grouped.top_per_key(df, ["key"], [F.col("ts").desc(), F.col("edge_id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.filter("key = 'hot'").count() == 3


VECTOR = {"vector_search", "search"}
STREAMED = {"stream_commit", "stream_current_facts", "rebuild_graph", "write_eval_results"}


@pytest.mark.parametrize("name", sorted(set(catalogue()) - STREAMED))
def test_no_nested_loops_and_no_python_in_plans(spark, tables, name):
    df = catalogue()[name].run(spark, tables.folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    assert ("ArrowEvalPython" in plan) == (name in VECTOR)


def test_filters_and_columns_reach_the_scan(spark, tables):
    from factloom.operators.facts import filter_facts

    df = filter_facts(tables.commitments(), since="1997-01-01").select("edge_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
    assert "GreaterThanOrEqual(o_orderdate" in plan or "o_orderdate" in plan.split("PushedFilters")[1]
