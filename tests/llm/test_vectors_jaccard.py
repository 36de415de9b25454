"""Near-duplicate vectors, similar shingle sets, and connected components, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from llm_helpers import documents, groups, prose, rows_by_id

from factloom.llm import jaccard, store, vectors

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, a string, v string, component string"


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 80)]
    loose = [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)]
    links = chain + star + loose + [(9, 9), (7, 6)]
    rng.shuffle(links)
    got = {r["id"]: r["component"] for r in store.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == groups(ids, links)
    assert store.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def near_rows(seed=3):
    rng = np.random.default_rng(seed)
    rows, vec = [], 0
    for label in (0, 1, 2):
        for size in [1] * 60 + [2] * 20 + [25, 70]:
            base = rng.normal(size=24)
            for _ in range(size):
                x = base + rng.normal(size=24) * rng.choice([0.03, 0.2])
                rows.append((vec, [float(v) for v in x.astype(np.float32)], label))
                vec += 1
    same = rows[5][1]
    rows += [(vec + k, same, rows[5][2]) for k in range(30)]
    vec += 30
    rows += [
        (vec, None, 0), (vec + 1, [0.0] * 24, 0), (vec + 2, [float("nan")] * 24, 0), (vec + 3, [None] * 24, 0),
        (vec + 4, same, None), (vec + 5, [], 0), (vec + 6, [1.0] * 7, 0), (None, same, rows[5][2]), rows[5],
    ]
    return rows


def test_vectors_against_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS)
    out = vectors.near_vectors(df, how=vectors.Search(shard=100)).collect()
    assert len(out) == len(rows)
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v):
            good[i] = (np.array(v) / np.linalg.norm(v), label)
    links = [
        (a, b)
        for a, (x, p) in good.items()
        for b, (y, q) in good.items()
        if a < b and p == q and float(x @ y) >= 0.93
    ]
    count = {i: 0 for i, *_ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    want = groups([i for i in count if i is not None], links)
    got = {r["vec_id"]: r for r in out if r["vec_id"] is not None}
    found = sum(r["n_links"] for r in got.values())
    assert found <= sum(count.values()) and found >= 0.98 * sum(count.values())
    assert all(got[i]["n_links"] <= count[i] for i in got)
    assert sum(got[i]["component_id"] != c for i, c in want.items()) <= 0.01 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    lonely = [r for r in out if r["vec_id"] is None]
    assert [(r["n_links"], r["component_id"]) for r in lonely] == [(0, None)]


def test_a_dense_group_of_unequal_vectors_keeps_its_links(spark, monkeypatch):
    # no search at all stands for one that misses; two labels, one of which the graph serves well
    rng = np.random.default_rng(11)
    base = rng.normal(size=24)
    rows = [(k, [float(v) for v in (base + rng.normal(size=24) * 0.12).astype(np.float32)], 5) for k in range(900)]
    rows += [(1000 + k, [float(v) for v in rng.normal(size=24).astype(np.float32)], 5) for k in range(300)]
    rows += [(2000 + k, rows[3][1], 5) for k in range(4)] + [(3000 + k, rows[k // 2][1], 6) for k in range(20)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    want = groups(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    real, asked = vectors._pairs, []

    def lossy(own, how, least):
        asked.append(own.count())
        return real(own, how, least).filter("a % 7 = b % 7 or a >= 3000")

    monkeypatch.setattr(vectors, "_pairs", lossy)
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS)
    got = rows_by_id(vectors.near_vectors(df, how=vectors.Search(shard=200)), "vec_id")
    assert asked[1:] == [1200, 1200] and asked[0] > 1200
    assert {i: got[i]["n_links"] for i in ids} == dict(zip(ids, near.sum(axis=1).tolist()))
    assert {i: got[i]["component_id"] for i in ids} == want


def test_vectors_of_an_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_every_node_is_reached_in_a_dense_group():
    rng = np.random.default_rng(5)
    x = rng.normal(size=32) + rng.normal(size=(300, 32)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    how = vectors.Search()
    lists = vectors.robust_graph(x.astype(np.float32), how)
    padded = np.full((300, max(map(len, lists))), -1)
    for i, own in enumerate(lists):
        padded[i, : len(own)] = own
    i, j = vectors.range_search(x, padded, np.arange(300), np.array([0]), how, 0.93)
    s = x @ x.T
    np.fill_diagonal(s, 0)
    assert len(i) >= 0.98 * (s >= 0.93).sum()


def word_sets(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    out = {}
    for i, text in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(upper))
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        if i not in out or len(own) > len(out[i]):
            out[i] = own
    return out


def similar_rows():
    rng = random.Random(11)
    rows, i = [], 0
    for g in range(25):
        base = prose(g, rng.choice([4, 6, 40, 150])).split()
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = prose(rng.randrange(10**6), 1)
            rows.append((i, " ".join(own)))
            i += 1
    base, shared = prose(77, 60).split(), prose(78, 60)
    for _ in range(70):  # a large group of near copies that share all but a few words
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = prose(rng.randrange(10**6), 1)
        rows.append((i, " ".join(own)))
        i += 1
    rows += [(i + k, f"{shared} {prose(500 + k, rng.choice([5, 10, 14, 16, 30, 200]))}") for k in range(40)]
    i += 40
    rows += [(i + k, rows[0][1]) for k in range(20)]
    i += 20
    rows += [(i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "Two Words"), (i + 4, "two\twords"), (i + 5, "two")]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (i + 6, prose(9, 20_000)), (i + 7, prose(9, 20_000).upper())]
    return rows


@pytest.mark.parametrize("node_docs", [2048, 5])
def test_similar_sets_against_brute_force(spark, node_docs):
    rows = similar_rows()
    out = jaccard.similar_sets(documents(spark, rows, clashing=True), node_docs=node_docs).collect()
    assert len(out) == len(rows)
    sets = word_sets(rows)
    links = [
        (a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = groups(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert got.pop(None) == (0, None)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_similar_sets_of_an_empty_table_and_what_stays(spark):
    assert jaccard.similar_sets(documents(spark, [])).count() == 0
    text = prose(4, 50)
    docs = documents(spark, [(3, text), (2, text), (9, prose(5, 50)), (None, text), (10, None)], clashing=True)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["10", "2", "9", "None"]


def test_tree_traversal_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 62, rng.integers(20, 90)).astype(np.uint64)
        for _ in range(rng.integers(1, 6)):
            own = base.copy()
            own[: rng.integers(0, 8)] = rng.integers(0, 1 << 62)
            sets.append(np.unique(own))
    n = np.array([len(s) for s in sets])
    forest = jaccard._forest(np.arange(len(sets)), n, np.arange(len(sets)), [jaccard.bitmap(s) for s in sets])
    found = set()
    for w, (d, tree) in forest.items():
        for v, (e, other) in forest.items():
            if v in (w, 2 * w):
                i, j = jaccard.traverse(tree, other, v == w)
                found |= {(min(p, q), max(p, q)) for p, q in zip(d[i].tolist(), e[j].tolist(), strict=True)}
    true = {
        (a, b)
        for a in range(len(sets))
        for b in range(a + 1, len(sets))
        if 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (n[a] + n[b] - k)
    }
    assert true <= found and len(found) < len(sets) * (len(sets) - 1) / 4
