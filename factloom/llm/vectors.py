"""Near-duplicate embeddings by a robust-pruned flat graph.

Vectors of one label are clustered into shards of bounded size; a vector near a border belongs to several.
Each shard builds a graph in which a node keeps a neighbour only if no kept one is clearly closer to it.
The adjacency lists of all shards are united, and every vector searches over the united lists:
greedily from its home shard's medoids, then, range-expanding, through all nodes within the similarity.  Pairs
are verified in double precision, and bounded sets of queries are compared with all vectors to audit the
recall of each label; labels below the target are searched again with wider borders and beam, and those that
stay below it are compared exactly, block with block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import bounded_sample, components, stored

SIMILAR = 0.93
LEVELS = 8
SAMPLE = 2_048
AUDIT_QUERIES = 200
RECALL = 0.9
# So many queries are sent to the audit of all labels at most.
AUDIT_ROWS = 4_000


@dataclass(frozen=True)
class Search:
    """How wide to search: border width (chord), copies of a vector, lists, candidates, beam.

    `shard` is the number of vectors that a task builds a graph of.
    """

    shard: int = 4_096

    border: float = 0.2
    copies: int = 3
    degree: int = 24
    candidates: int = 48
    beam: int = 32
    medoids: int = 16
    alpha: float = 1.2

    def wider(self) -> Search:
        return replace(
            self, border=self.border * 2, copies=self.copies + 3, degree=self.degree * 2,
            candidates=self.candidates * 2, beam=self.beam * 2, medoids=self.medoids * 2,
        )


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _usable(column: pa.Array) -> pa.Array:
    """Whether vectors have only finite components and a length above zero."""
    good = []
    for v in column:
        if not v.is_valid or not len(v.values) or v.values.null_count:
            good.append(False)
            continue
        x = v.values.to_numpy().astype(np.float64)
        good.append(bool(np.isfinite(x).all() and np.any(x)))
    return pa.array(good, pa.bool_())


def _means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; deterministic starts, lines of length one."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm == 0, c, sums / np.where(norm == 0, 1, norm))
    return c


PARTS = 64


def _centres(how: Search):
    def run(table: pa.Table) -> pa.Table:
        """The centres of one shard from its sample, so many that parts, with copies, come out small enough."""
        x = _matrix(table.column("v"))
        size = table.column("size")[0].as_py()
        k = int(min(PARTS, max(how.copies + 1, np.ceil(1.25 * how.copies * size / how.shard)), len(x)))
        return pa.table(
            {
                "shard": table.column("shard").slice(0, 1),
                "centres": pa.array([_means(x, k).astype(np.float32).ravel()], pa.list_(pa.float32())),
            }
        )

    return run


def _nearest(border: float, copies: int):
    def assign(vector: pa.Array, centres: pa.Array, home: pa.Array) -> pa.Array:
        """The parts a vector belongs to, its home first; a copy of it goes to the nearest part only."""
        parts = []
        x = _matrix(vector)
        for row, c, own in zip(x, centres, home.to_pylist(), strict=True):
            c = c.values.to_numpy().reshape(-1, len(row))
            chord = np.sqrt(np.maximum(0, 2 - 2 * (c @ row)))
            order = np.argsort(chord, kind="stable")[: copies if own else 1]
            parts.append(order[chord[order] <= chord[order[0]] + border].astype(np.int32))
        return pa.array(parts, pa.list_(pa.int32()))

    return assign


def _shards(vectors: DataFrame, how: Search) -> DataFrame:
    """`shard`, `id`, `v`, `home` for every shard a vector belongs to."""
    rows = stored(vectors.select(F.xxhash64("label").alias("shard"), "id", "v", F.lit(True).alias("home")), "shards")
    assign = F.arrow_udf(_nearest(how.border, how.copies), "array<int>")
    done: DataFrame | None = None
    before: dict[int, int] | None = None
    for _ in range(LEVELS):
        sizes = stored(rows.groupBy("shard").agg(F.count("*").alias("size")), "sizes")
        large = stored(sizes.filter(F.col("size") > how.shard), "large")
        if large.isEmpty():
            break
        small = rows.join(large, "shard", "left_anti")
        done = small if done is None else done.union(small)
        many = rows.join(large.select("shard"), "shard", "left_semi")
        sample = bounded_sample(many.select("shard", "id", "v"), "shard", SAMPLE, "id").join(large, "shard")
        centres = stored(
            sample.groupBy("shard").applyInArrow(_centres(how), "shard bigint, centres array<float>"), "centres"
        )
        parts = many.join(centres, "shard").select("shard", "id", "v", "home", assign("v", "centres", "home").alias("p"))
        parts = parts.select("shard", "id", "v", "home", F.posexplode("p").alias("place", "part"))
        split = parts.select(
            F.xxhash64("shard", "part").alias("shard"), "id", "v", (F.col("home") & (F.col("place") == 0)).alias("home")
        )
        # a vector that reaches a part from several sides is there once, at home if it is on any
        split = split.groupBy("shard", "id").agg(F.first("v").alias("v"), F.max("home").alias("home"))
        rows = stored(split.select("shard", "id", "v", "home"), "shards")
        now = rows.agg(F.count("*"), F.max("shard")).first()
        if now == before:
            break
        before = now
    return rows if done is None else done.union(rows)


def _candidates(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node its `k` nearest others and some far ones, nearest first, with similarities."""
    n = len(x)
    k = min(k, n - 1)
    near = np.empty((n, k), dtype=np.int64)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
        near[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-s, axis=1)[:, :k]
    far = np.random.default_rng(7).integers(0, n, (n, 12))
    both = np.concatenate([near, far], axis=1)
    s = np.einsum("nkd,nd->nk", x[both], x)
    s[both == np.arange(n)[:, None]] = -9
    order = np.argsort(-s, axis=1, kind="stable")
    return np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1)


def robust_graph(x: np.ndarray, how: Search) -> list[np.ndarray]:
    """Adjacency lists: a candidate stays if no kept neighbour is `alpha` times closer to it than the node."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    kept: list[list[np.ndarray]] = [[] for _ in range(n)]
    block = max(64, (1 << 22) // ((how.candidates + 12) * x.shape[1]))
    near, s = _candidates(x, how.candidates)
    for a in range(0, n, block):
        ids, sims = near[a : a + block], s[a : a + block]
        distance = 1 - sims
        open_ = sims > -8
        vectors = x[ids]
        for _ in range(how.degree):
            if not open_.any():
                break
            first = open_.argmax(axis=1)
            some = open_[np.arange(len(ids)), first]
            pick = ids[np.arange(len(ids)), first]
            for r in np.flatnonzero(some):
                kept[a + r].append(pick[r])
            between = 1 - np.einsum("nkd,nd->nk", vectors, x[pick])
            open_ &= ~(some[:, None] & (how.alpha * between <= distance))
            open_[np.arange(len(ids)), first] = False
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(kept):
        for j in own:
            back[j].append(i)
    lists = [[*kept[i], *back[i][: 2 * how.degree]] for i in range(n)]
    # a node that very many chose leads to the rest of them through a heap of small degree
    for i in range(n):
        rest = [i, *back[i][2 * how.degree :]]
        for k in range(1, len(rest)):
            parent = rest[(k - 1) // 8]
            lists[parent].append(rest[k])
            lists[rest[k]].append(parent)
    return [np.unique(np.array(own, dtype=np.int64)) for own in lists]


def _build(how: Search):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _matrix(table.column("v"))[order].astype(np.float32)
        lists = robust_graph(x, how)
        return pa.table(
            {
                "id": np.repeat(ids, [len(own) for own in lists]),
                "to": ids[np.concatenate(lists)] if len(lists) else ids,
            }
        )

    return run


def range_search(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, medoids: np.ndarray, how: Search, least: float):
    """(query, node) pairs of similarity `least` found over the graph; `lists` is padded with -1."""
    left, right = [], []
    x32 = x.astype(np.float32)
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        m, n = len(q), len(x)
        seen = np.full((m, n), -2, dtype=np.float32)
        line = np.arange(m)
        seen[:, medoids] = x32[q] @ x32[medoids].T
        beam = np.tile(medoids, (m, 1))
        closed = np.zeros((m, n), dtype=bool)
        # greedy: always open the best node of the beam that is still closed
        for _ in range(3 * how.beam):
            value = np.where(closed[line[:, None], beam], -3, seen[line[:, None], beam])
            best = value.argmax(axis=1)
            busy = value[line, best] > -3
            if not busy.any():
                break
            node = beam[line, best]
            closed[line[busy], node[busy]] = True
            near = lists[node]
            fresh = (near >= 0) & busy[:, None]
            fresh &= seen[line[:, None], np.maximum(near, 0)] <= -2
            r, c = np.nonzero(fresh)
            if len(r):
                to = near[r, c]
                seen[r, to] = np.einsum("kd,kd->k", x32[q[r]], x32[to])
            both = np.concatenate([beam, np.where(fresh, near, beam[:, :1])], axis=1)
            value = seen[line[:, None], both]
            value[:, beam.shape[1] :][~fresh] = -3
            top = np.argsort(-value, axis=1, kind="stable")[:, : how.beam]
            beam = np.take_along_axis(both, top, 1)
        # range expansion: open every node within the range until none is new, the query's own node first
        seen[line, q] = 1.0
        inside = (seen >= least - 0.02)
        opened = np.zeros((m, n), dtype=bool)
        while True:
            r, c = np.nonzero(inside & ~opened)
            if not len(r):
                break
            opened[r, c] = True
            near = lists[c]
            keep = near >= 0
            rr, to = np.repeat(r, keep.sum(axis=1)), near[keep]
            new = seen[rr, to] <= -2
            flat = np.unique(rr[new] * n + to[new])
            rr, to = flat // n, flat % n
            if len(rr):
                seen[rr, to] = np.einsum("kd,kd->k", x32[q[rr]], x32[to])
                inside[rr, to] = seen[rr, to] >= least - 0.02
        r, c = np.nonzero(inside)
        other = q[r] != c
        left.append(q[r[other]])
        right.append(c[other])
    i, j = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
    exact = np.concatenate(
        [np.einsum("kd,kd->k", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]
    )
    return i[exact >= least], j[exact >= least]


def _search(how: Search, least: float):
    def run(table: pa.Table) -> pa.Table:
        """Searches one shard: its members with their united lists."""
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _matrix(table.column("v"))[order]
        n = len(ids)
        nothing = pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if n < 2:
            return nothing
        to = table.column("to").combine_chunks().take(pa.array(order))
        size = np.array([len(t) if t.is_valid else 0 for t in to])
        flat = to.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(ids, flat)
        at[at == n] = 0
        here = ids[at] == flat
        row = np.repeat(np.arange(n), size)[here]
        at = at[here]
        count = np.bincount(row, minlength=n)
        lists = np.full((n, max(1, int(count.max()))), -1, dtype=np.int64)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        lists[row, place] = at
        c = _means(x, min(how.medoids, n))
        medoids = np.unique(np.argmax(x @ c.T, axis=0))
        at_home = np.flatnonzero(table.column("home").to_numpy()[order])
        i, j = range_search(x, lists, at_home, medoids, how, least)
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return run


def _pairs(vectors: DataFrame, how: Search, least: float) -> DataFrame:
    shards = stored(_shards(vectors, how), "shards")
    edges = shards.select("shard", "id", "v").groupBy("shard").applyInArrow(_build(how), "id bigint, to bigint")
    lists = stored(edges.distinct().groupBy("id").agg(F.collect_list("to").alias("to")), "lists")
    members = shards.join(lists, "id", "left")
    pairs = members.groupBy("shard").applyInArrow(_search(how, least), "a bigint, b bigint")
    return stored(pairs.distinct(), "pairs")


def _audited(vectors: DataFrame, pairs: DataFrame, chosen: list, least: float) -> dict[str, tuple[int, int]]:
    """True pairs of the chosen queries, and how many of them were found, by label."""
    own = np.array([r["id"] for r in chosen])
    labels = np.array([str(r["label"]) for r in chosen])
    wanted = [_matrix(pa.array([r["v"]], pa.list_(pa.float64())))[0] for r in chosen]
    groups = {}
    for name in np.unique(labels):
        at = np.flatnonzero(labels == name)
        groups[str(name)] = own[at], np.stack([wanted[i] for i in at])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            label = np.array(batch.column(1).to_pylist())
            for name in np.unique(label):
                if name not in groups:
                    continue
                asked, q = groups[name]
                at = np.flatnonzero(label == name)
                s = _matrix(batch.column(2).take(pa.array(at))) @ q.T
                r, c = np.nonzero((s >= least) & (ids[at][:, None] != asked[None, :]))
                a, b = np.minimum(ids[at[r]], asked[c]), np.maximum(ids[at[r]], asked[c])
                yield pa.record_batch(
                    [a.astype(np.int64), b.astype(np.int64), pa.array([str(name)] * len(a), pa.string())],
                    names=["a", "b", "label"],
                )

    true = vectors.select("id", F.col("label").cast("string"), "v").mapInArrow(compare, "a bigint, b bigint, label string")
    true = stored(true.distinct(), "audit")
    hit = true.join(pairs.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    counts = hit.groupBy("label").agg(F.count("*").alias("n"), F.count("hit").alias("found")).collect()
    return {r["label"]: (r["n"], r["found"]) for r in counts}


def audit_recall(vectors: DataFrame, pairs: DataFrame, least: float = SIMILAR, queries: int = AUDIT_QUERIES) -> float:
    """Share of the true pairs of a bounded set of queries (by hash order) that were found; 1 if there are none."""
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(queries).select("id", "label", "v").collect()
    counts = _audited(vectors, pairs, chosen, least) if chosen else {}
    n = sum(c[0] for c in counts.values())
    return sum(c[1] for c in counts.values()) / n if n else 1.0


def missed_labels(vectors: DataFrame, pairs: DataFrame, least: float, queries: int = AUDIT_QUERIES) -> list[str]:
    """Labels whose recall is under the target, by up to `queries` queries of each (of fewer, if labels are very many)."""
    labels = vectors.select("label").distinct().count()
    if not labels:
        return []
    each = max(4, min(queries, AUDIT_ROWS // labels))
    chosen = bounded_sample(vectors.select("id", "label", "v"), "label", each, "id").orderBy(F.xxhash64("id"), "id")
    counts = _audited(vectors, pairs, chosen.limit(AUDIT_ROWS).collect(), least)
    return sorted(name for name, (n, found) in counts.items() if found < RECALL * n)


def _block(table: pa.Table) -> pa.Table:
    """A block's centre and the largest chord from it to a member."""
    x = _matrix(table.column("v"))
    c = x.mean(axis=0)
    norm = np.linalg.norm(c)
    c = c / norm if norm else x[0]
    radius = float(np.sqrt(np.maximum(0, 2 - 2 * (x @ c))).max())
    return pa.table(
        {"label": table.column("label").slice(0, 1), "block": table.column("block").slice(0, 1),
         "centre": pa.array([c], pa.list_(pa.float64())), "radius": [radius]}
    )


def _compared(least: float):
    def run(table: pa.Table) -> pa.Table:
        """All pairs of two blocks: links of each vector (`a`, `n`), and edges (`a`, `b`) that join the same vectors."""
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        x, side = _matrix(table.column("v")), table.column("side").to_numpy()
        left = np.flatnonzero(side == 0)
        same = bool(table.column("x")[0].as_py() == table.column("y")[0].as_py())
        right = left if same else np.flatnonzero(side == 1)
        near = np.empty((len(left), len(right)), bool)
        for a in range(0, len(left), 512):
            near[a : a + 512] = x[left[a : a + 512]] @ x[right].T >= least
        if same:
            np.fill_diagonal(near, False)
        node, links = [left], [np.array([copies[right][r].sum() for r in near], dtype=np.int64)]
        if not same:
            node.append(right)
            links.append(np.array([copies[left][r].sum() for r in near.T], dtype=np.int64))
        node, links = np.concatenate(node), np.concatenate(links)
        some = links > 0
        # from each left vector not yet reached, all that is connected with it
        from_, to = [], []
        open_l, open_r = near.any(axis=1), np.ones(len(right), bool)
        for start in np.flatnonzero(open_l):
            if not open_l[start]:
                continue
            wave = np.array([start])
            open_l[start] = False
            if same:
                open_r[start] = False
            while len(wave):
                over = np.flatnonzero(near[wave].any(axis=0) & open_r)
                open_r[over] = False
                to.append(ids[right[over]])
                if same:
                    open_l[over] = False
                    wave = over
                else:
                    wave = np.flatnonzero(near[:, over].any(axis=1) & open_l)
                    open_l[wave] = False
                    to.append(ids[left[wave]])
                from_.append(np.full(sum(map(len, to)) - sum(map(len, from_)), ids[left[start]]))
        a = np.concatenate([*from_, np.zeros(0, np.int64)])
        b = np.concatenate([*to, np.zeros(0, np.int64)])
        return pa.table(
            {
                "a": np.concatenate([ids[node][some], a]),
                "b": pa.array([*[None] * int(some.sum()), *b.tolist()], pa.int64()),
                "n": np.concatenate([links[some], np.zeros(len(a), np.int64)]),
            }
        )

    return run


def exact_links(vectors: DataFrame, copies: DataFrame, how: Search, least: float) -> tuple[DataFrame, DataFrame]:
    """`a`, `others` (links of each vector, counting copies) and edges `a`, `b` that give the same components.

    Home shards, salted to at most about `how.shard` vectors, are blocks; every pair of blocks of a label that
    can hold a pair within reach, by centre and radius, is compared as a whole in a task of its own.
    """
    home = _shards(vectors, how).filter("home").select("shard", "id")
    home = stored(home.join(vectors, "id").join(copies.withColumnRenamed("b", "id"), "id"), "home")
    sizes = home.groupBy("shard").agg(F.ceil(F.count("*") / how.shard).alias("salts"))
    block = F.xxhash64("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.col("salts"))).alias("block")
    rows = stored(home.join(sizes, "shard").select(F.col("label").cast("string").alias("label"), block, "id", "v", "copies"), "blocks")
    kind = "label string, block bigint, centre array<double>, radius double"
    blocks = stored(rows.groupBy("block").applyInArrow(_block, kind), "centres")

    @F.arrow_udf("double")
    def chord(p: pa.Array, q: pa.Array) -> pa.Array:
        x, y = _matrix(p), _matrix(q)
        return pa.array(np.sqrt(np.maximum(0, 2 - 2 * np.einsum("kd,kd->k", x, y))))

    one = blocks.select("label", F.col("block").alias("x"), F.col("centre").alias("p"), F.col("radius").alias("r"))
    two = blocks.select("label", F.col("block").alias("y"), F.col("centre").alias("q"), F.col("radius").alias("s"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    both = one.join(two, "label").filter("x <= y").withColumn("d", chord("p", "q"))
    both = stored(both.filter((F.col("x") == F.col("y")) | (F.col("d") <= F.col("r") + F.col("s") + reach)).select("x", "y"), "block-pairs")
    sides = both.select("x", "y", F.col("x").alias("block"), F.lit(0).alias("side"))
    sides = sides.union(both.filter("x < y").select("x", "y", F.col("y").alias("block"), F.lit(1).alias("side")))
    sent = rows.select("block", "id", "v", "copies").join(sides, "block").select("x", "y", "side", "id", "v", "copies")
    out = stored(sent.groupBy("x", "y").applyInArrow(_compared(least), "a bigint, b bigint, n bigint"), "compared")
    links = out.filter("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    return links, out.filter("b is not null").select("a", "b")


def near_vectors(embeddings: DataFrame, least: float = SIMILAR, how: Search | None = None) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept` for every row of `embeddings`.

    Only vectors of equal, non-null labels are compared.  A vector that is null, empty, zero, or has a null
    or non-finite component links with nothing, and neither does a row without an id or a vector whose
    length differs from its label's most frequent one.  Equal vectors of one label form a class that is
    searched once; its members link with each other and with all members of linked classes.  Rows that
    repeat an id are one vector (of different ones the first by hash counts).  Other columns are not read.
    """
    how = how or Search()
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    usable = F.arrow_udf(_usable, "boolean")
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v")
    ).filter("id is not null and label is not null")
    rows = rows.filter(usable("v"))
    rows = rows.withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(3), "v", "label"))
    width = rows.groupBy("label", F.size("v").alias("w")).agg(F.count("*").alias("c"))
    width = width.groupBy("label").agg(F.max(F.struct("c", (-F.col("w")).alias("w"))).alias("m"))
    width = stored(width.select("label", (-F.col("m.w")).alias("w")), "widths")
    rows = rows.join(width, "label").filter(F.size("v") == F.col("w")).drop("w")
    first = rows.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("m")).select("id", "m.*")
    first = stored(first, "one-vector-each")
    classes = stored(first.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    heads = classes.select(F.col("rep").alias("id"), "h1", "h2")
    vectors = rows.join(heads, ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"]).select("id", "label", "v")
    vectors = stored(vectors, "vectors")
    copies = stored(classes.select(F.col("rep").alias("b"), "copies"), "copies")
    pairs, missed = _pairs(vectors, how, least), None
    edges = counted = None
    for attempt in range(3):
        labels = missed_labels(vectors, pairs, least) if missed is None else missed_labels(missed, pairs, least)
        if not labels:
            break
        missed = stored(vectors.filter(F.col("label").cast("string").isin(labels)), "missed")
        if attempt < 2:
            how = how.wider()
            pairs = stored(pairs.union(_pairs(missed, how, least)).distinct(), "pairs")
        else:
            # the exact counts take the place of what was found in these labels
            counted, edges = exact_links(missed, copies, how, least)
            pairs = stored(pairs.join(missed.select(F.col("id").alias("a")), "a", "left_anti"), "pairs")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    if counted is not None:
        links = links.union(counted)
    reached = components(pairs if edges is None else pairs.select("a", "b").union(edges))
    member = first.join(classes, ["h1", "h2"]).select("id", "rep", "copies")
    member = member.join(links, member["rep"] == links["a"], "left").drop("a")
    member = member.join(reached.withColumnRenamed("id", "node"), F.col("rep") == F.col("node"), "left")
    member = member.select(
        "id",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    out = own.join(member, own["vec_id"] == member["id"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
