"""Entity-resolution scores over time, and as-of sums, against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factloom.operators import evaluate
from factloom.operators.grouped import cumulative_at

START = datetime(2020, 12, 20)


def day(n):
    return START + timedelta(hours=7 * n)


def test_running_values_of_a_hot_key(spark):
    rng = random.Random(1)
    events = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", day(rng.randrange(400)), rng.randrange(1000))
              for _ in range(600)]
    probes = [(rng.choice(["hot", "k1", "none"]), day(rng.randrange(-5, 420)), i) for i in range(150)]
    e = spark.createDataFrame(events, "k string, at timestamp, v long")
    p = spark.createDataFrame(probes, "k string, at timestamp, id long")
    most = cumulative_at(p, e, ["k"], "at", "v", "x", grain="month").collect()
    sums = cumulative_at(p, e, [], "at", "v", "x", total=True).collect()
    for row, (k, at, _) in zip(sorted(most, key=lambda r: r.id), probes, strict=True):
        assert row.x == max((v for g, t, v in events if g == k and t <= at), default=None)
    for row, (_, at, _) in zip(sorted(sums, key=lambda r: r.id), probes, strict=True):
        assert row.x == sum(v for _, t, v in events if t <= at)


def plain_scores(expected, forms, slices):
    out = {}
    for s, at in slices.items():
        graph = [(i, n, a) for i, n, a, t in forms if t is not None and t <= at]
        lookup, held = {}, defaultdict(set)
        for i, n, a in graph:
            for kind, form in ((0, n), (1, a)):
                if form is not None:
                    lookup[form.lower()] = max(lookup.get(form.lower(), ("", 0, "")), (i, kind, n))
                    held[i].add(form.lower())
        own = [(c, f) for x, c, f in expected if x == s]
        right, total, owner = defaultdict(int), defaultdict(int), {}
        for c, f in own:
            if f is None:
                continue
            total[c] += 1
            hit = lookup.get(f.lower())
            right[c] += int(hit is not None and hit[2].lower() == c.lower())
            owner[f.lower()] = max(owner.get(f.lower(), ""), c.lower())
        nodes = [{owner[f] for f in fs if f in owner} for fs in held.values()]
        nodes = [n for n in nodes if n]
        out[s] = (
            len({c for c, _ in own}), len({i for i, _, _ in graph}), sum(total.values()), sum(right.values()),
            sum(n > 1 for n in total.values()), sum(n > 1 and right[c] == n for c, n in total.items()),
            len(nodes), sum(len(n) > 1 for n in nodes),
        )
    return out


def test_scores_at_many_slices(spark):
    rng = random.Random(2)
    names = [f"Person {k}" for k in range(25)]
    # one form ("hot") belongs to most nodes
    forms = [(f"p{k:02d}", n, rng.choice(["hot", "Hot", f"al{k % 6}", None]), day(rng.randrange(300))) for k, n in enumerate(names)]
    forms += [(f"p{k:02d}", names[k], f"late{k}", day(250 + k)) for k in range(10)] + [("q", "Nobody", None, None)]
    slices = {f"s{k}": day(k * 4) for k in range(-2, 90)}
    expected = [(rng.choice(list(slices)), rng.choice(names), rng.choice([rng.choice(names).upper(), "hot", f"al{rng.randrange(6)}", f"late{rng.randrange(10)}", "?", None]))
                for _ in range(400)]
    expected += [("unknown slice", names[0], "hot")]
    got = evaluate.er_timeslices(
        spark.createDataFrame(expected, "slice string, canonical_name string, surface_form string"),
        spark.createDataFrame(forms, "entity_id string, name string, alias string, recorded_at timestamp"),
        spark.createDataFrame(list(slices.items()), "slice string, at timestamp"),
    )
    counts = got.select(
        "slice", "node_count_expected", "node_count_actual", "merge_recall_total", "merge_recall_correct",
        "entity_merge_total", "entity_merge_correct", "false_merge_total", "false_merge_count",
    ).collect()
    assert {r[0]: tuple(r)[1:] for r in counts} == plain_scores(expected, forms, slices)


def test_forms_are_not_repeated_per_slice(spark):
    """Twice the slices: no operator gives out forms times slices."""
    forms = spark.range(300).select(
        F.concat(F.lit("p"), "id").alias("entity_id"), F.concat(F.lit("N"), "id").alias("name"),
        F.lit(None).cast("string").alias("alias"), F.timestamp_seconds(F.col("id") * 86400).alias("recorded_at"),
    )
    slices = spark.range(2000).select(
        F.concat(F.lit("s"), "id").alias("slice"), F.timestamp_seconds(F.col("id") * 20000).alias("at")
    )
    expected = spark.range(300).select(
        F.concat(F.lit("s"), F.col("id") * 5).alias("slice"), F.concat(F.lit("N"), "id").alias("canonical_name"),
        F.concat(F.lit("n"), "id").alias("surface_form"),
    )
    out = evaluate.er_timeslices(expected, forms, slices)
    assert out.count() == 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan and "NestedLoop" not in plan


def test_a_form_of_many_nodes_and_slices_is_counted_without_pairing_them(spark):
    """400 nodes share a form that 60 slices want: only their other forms meet slices."""
    start = START.replace(hour=0)
    since = [("shared", f"n{i}", start + timedelta(days=i % 50)) for i in range(400)]
    since += [(f"own {i}", f"n{i}", start + timedelta(days=i % 50)) for i in range(400)]
    slices = [(f"s{k:02d}", start + timedelta(days=k)) for k in range(60)]
    wanted = [(s, at, "shared", "a") for s, at in slices]
    wanted += [(*slices[i % 60], f"own {i}", "a" if i % 3 else "b") for i in range(400)]
    wanted.append(("alone", start + timedelta(days=70), "own 7", "c"))
    s = spark.createDataFrame(since, "_form string, entity_id string, _since timestamp")
    w = spark.createDataFrame(wanted, "slice string, at timestamp, _form string, _canonical string")
    got = evaluate._timed_false_merges(s, w)
    want = {}
    for name, at in [*slices, ("alone", start + timedelta(days=70))]:
        own = {f: c for x, _, f, c in wanted if x == name}
        nodes = defaultdict(set)
        for form, node, first in since:
            if form in own and first <= at:
                nodes[node].add(own[form])
        want[name] = (len(nodes), sum(len(n) > 1 for n in nodes.values()))
    assert {r["slice"]: (r.false_merge_total, r.false_merge_count) for r in got.collect()} == want
