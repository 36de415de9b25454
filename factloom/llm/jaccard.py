"""N-gram Jaccard join by signature trees: documents whose word shingles overlap by 0.8 or more.

Equal sets are one class.  Under a fixed order of all shingles (those frequent in a sample last), two sets
that similar share one of their first fifth, so the shingles of those prefixes are the roots under which
documents meet.  Under a root, trees of nodes with OR- and AND-combined bitmaps and size ranges are
traversed in pairs, and a pair of nodes goes on only if the largest possible overlap of their documents
suffices and they are not known to be of one component already.  What arrives at the leaves is verified
with the whole sets.  Roots with very many documents are cut into nodes first, which are paired and pruned
as rows, so that no task gathers a whole root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import SENT_IDS, components, picked, stored
from factloom.llm.words import mix, pieces, shingles, words

SIZE = 5
# Frequent shingles are looked for in this many documents; they are ordered last, which changes no result.
SAMPLE_DOCS = 16_384
SAMPLE_TIMES = 4
FREQUENT = 200_000
# Documents of one root that a task compares; more are cut into nodes of about this size.
NODE_DOCS = 2_048
FANOUT = 8

_SCAN = "doc bigint, n bigint, s1 bigint, s2 bigint, prefix array<bigint>, bits binary"
_SCANNED = pa.schema(
    [
        ("doc", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
        ("prefix", pa.list_(pa.int64())), ("bits", pa.binary()),
    ]
)


def needed(a, b):
    """The least overlap of sets of sizes `a` and `b` with a Jaccard similarity of 0.8."""
    return (80 * (a + b) + 179) // 180


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for piece in pieces(column):
        h, row, _ = shingles(words(piece), size, piece.rows)
        cut = np.searchsorted(row, np.arange(piece.rows + 1))
        for r in range(piece.rows):
            yield piece.first + r, np.unique(h[cut[r] : cut[r + 1]])


def _sum(tokens: np.ndarray) -> int:
    return int(tokens.sum(dtype=np.uint64).astype(np.int64))


def bitmap(tokens: np.ndarray) -> bytes:
    """Which of at least four times as many bits (a power of two) the tokens hit."""
    m = max(64, 1 << int(4 * len(tokens) - 1).bit_length())
    hit = np.zeros(m, dtype=bool)
    hit[mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(m - 1)] = True
    return np.packbits(hit).tobytes()


def _scan(size: int, frequent: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            out: dict[str, list] = {name: [] for name in _SCANNED.names}
            for r, s in _sets(batch.column(1), size):
                n = len(s)
                if not n:
                    continue
                take = n - (4 * n + 4) // 5 + 1
                if len(frequent):
                    place = np.searchsorted(frequent, s)
                    place[place == len(frequent)] = 0
                    late = np.where(frequent[place] == s, rank[place], 0)
                    first = s[np.argsort(late, kind="stable")[:take]]
                else:
                    first = s[:take]
                out["doc"].append(int(keys[r]))
                out["n"].append(n)
                out["s1"].append(_sum(s))
                out["s2"].append(_sum(mix(s)))
                out["prefix"].append(first.view(np.int64))
                out["bits"].append(bitmap(s))
            yield pa.record_batch([pa.array(out[f.name], f.type) for f in _SCANNED], schema=_SCANNED)

    return run


def _tokens(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for _, s in _sets(batch.column(1), size)]
            token, times = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.record_batch([token.view(np.int64), times.astype(np.int64)], names=["token", "times"])

    return run


def _frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are frequent in a bounded sample, sorted, and their place from rare to frequent."""
    total = texts.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    few = texts.filter(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    counts = few.mapInArrow(_tokens(size), "token bigint, times bigint").groupBy("token")
    counts = counts.agg(F.sum("times").alias("times")).filter(F.col("times") >= SAMPLE_TIMES)
    rows = counts.orderBy(F.desc("times"), "token").limit(FREQUENT).collect()
    token = np.array([r["token"] for r in rows], dtype=np.int64).view(np.uint64)
    rank = np.arange(len(rows), 0, -1)
    order = np.argsort(token)
    return token[order], rank[order]


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (lines of 64-bit words) folded to `width` words by OR."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Tree:
    """Levels of nodes over documents of one bitmap width; level 0 are the documents themselves."""

    def __init__(self, n: np.ndarray, comp: np.ndarray, bits: np.ndarray):
        self.levels = [(bits, bits, n, n, comp)]
        while len(self.levels[-1][2]) > FANOUT:
            some, every, low, high, own = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            first, last = np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(some, at, axis=0),
                    np.bitwise_and.reduceat(every, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.where(first == last, first, -1),
                )
            )


def _folded(level: tuple, width: int) -> tuple:
    some, every, low, high, own = level
    if some.shape[1] == width:
        return level
    # folding by OR holds for AND-combined maps too: a bit that all documents have stays one of all
    return fold(some, width), fold(every, width), low, high, own


def _children(i: np.ndarray, other: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes, each with what its parent was paired with."""
    i = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    other = np.repeat(other, FANOUT)
    return i[i < size], other[i < size]


def traverse(a: Tree, b: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents (by number in each tree) whose largest possible overlap suffices."""
    width = min(a.levels[0][0].shape[1], b.levels[0][0].shape[1])
    left, right = ([_folded(level, width) for level in t.levels] for t in (a, b))
    x, y = len(a.levels) - 1, len(b.levels) - 1
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(a.levels[x][2])), np.arange(len(b.levels[y][2]))))
    if same:
        i, j = i[i <= j], j[i <= j]
    todo, found = [(x, y, i, j)], []
    chunk = max(256, (1 << 21) // (width * 8))
    while todo:
        x, y, i, j = todo.pop()
        if len(i) > chunk:
            todo += [(x, y, i[k : k + chunk], j[k : k + chunk]) for k in range(0, len(i), chunk)]
            continue
        some_a, every_a, low_a, high_a, own_a = left[x]
        some_b, every_b, low_b, high_b, own_b = right[y]
        most = np.minimum(
            high_a[i] - np.bitwise_count(every_a[i] & ~some_b[j]).sum(axis=1, dtype=np.int64),
            high_b[j] - np.bitwise_count(every_b[j] & ~some_a[i]).sum(axis=1, dtype=np.int64),
        )
        good = most >= needed(low_a[i], low_b[j])
        good &= (own_a[i] < 0) | (own_a[i] != own_b[j])
        good &= (5 * high_b[j] >= 4 * low_a[i]) & (5 * high_a[i] >= 4 * low_b[j])
        i, j = i[good], j[good]
        if x == 0 and y == 0:
            found.append((i, j) if not same else (i[i < j], j[i < j]))
            continue
        if x > 0:
            i, j = _children(i, j, len(left[x - 1][2]))
        if y > 0:
            j, i = _children(j, i, len(right[y - 1][2]))
        if same:
            i, j = i[i <= j], j[i <= j]
        if len(i):
            todo.append((max(x - 1, 0), max(y - 1, 0), i, j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest(doc: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: list[bytes]) -> dict[int, tuple[np.ndarray, Tree]]:
    """A tree for each bitmap width, over documents in order of size."""
    width = np.array([len(x) // 8 for x in bits])
    trees = {}
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        at = at[np.lexsort((doc[at], comp[at], n[at]))]
        m = np.frombuffer(b"".join(bits[k] for k in at), dtype=np.uint64).reshape(len(at), int(w))
        trees[int(w)] = (doc[at], Tree(n[at], comp[at], m))
    return trees


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each group of rows (root, left node, right node); side 0: left, 1: right, 2: both.

    A pair that several roots lead to is given out under the first of them only (`mine`: a document's roots).
    """
    held: list[pa.Table] = []

    def solved(table: pa.Table) -> pa.RecordBatch:
        key = [table.column(c).to_numpy() for c in ("token", "x", "y")]
        side, doc, n, comp = (table.column(c).to_numpy() for c in ("side", "doc", "n", "comp"))
        bits = table.column("bits").to_pylist()
        roots = {d: set(m.as_py()) for d, m in zip(doc.tolist(), table.column("mine"), strict=True)}
        edge = np.zeros(len(doc), bool)
        edge[0] = True
        for k in key:
            edge[1:] |= k[1:] != k[:-1]
        cut = np.append(np.flatnonzero(edge), len(doc))
        left, right = [], []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            at = np.arange(lo, hi)
            if hi - lo < 2 or (comp[at] == comp[lo]).all():
                continue
            sides = [at[side[at] == s] for s in (0, 1)] if side[lo] < 2 else [at]
            forests = [_forest(doc[s], n[s], comp[s], [bits[k] for k in s]) for s in sides]
            for w, (d, tree) in forests[0].items():
                for v, (e, other) in forests[-1].items():
                    if len(forests) == 1 and v not in (w, 2 * w) or v not in (w, 2 * w, w // 2):
                        continue
                    i, j = traverse(tree, other, len(forests) == 1 and v == w)
                    a, b = d[i].tolist(), e[j].tolist()
                    first = [min(roots[p] & roots[q]) == key[0][lo] for p, q in zip(a, b, strict=True)]
                    i, j = i[first], j[first]
                    left.append(np.minimum(d[i], e[j]))
                    right.append(np.maximum(d[i], e[j]))
        pairs = np.stack([np.concatenate([*s, np.zeros(0, np.int64)]) for s in (left, right)])
        pairs = np.unique(pairs, axis=1) if pairs.shape[1] else pairs
        return pa.record_batch([pairs[0], pairs[1]], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        table = pa.concat_tables(held).combine_chunks()
        last = [table.column(c)[table.num_rows - 1].as_py() for c in ("token", "x", "y")]
        same = np.ones(table.num_rows, bool)
        for c, v in zip(("token", "x", "y"), last, strict=True):
            same &= table.column(c).to_numpy() == v
        k = table.num_rows - int(same.sum())
        if k:
            yield solved(table.slice(0, k))
        held = [table.slice(k)]
    if held:
        yield solved(pa.concat_tables(held).combine_chunks())


_WHOLE = pa.schema([("doc", pa.int64()), ("s1", pa.int64()), ("s", pa.binary())])


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            rows: list[dict] = []
            for r, s in _sets(batch.column(1), size):
                rows.append({"doc": int(keys[r]), "s1": _sum(s), "s": s.tobytes()})
                if len(rows) == 512:
                    yield pa.RecordBatch.from_pylist(rows, schema=_WHOLE)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_WHOLE)

    return run


def _overlaps(a: pa.Array, b: pa.Array) -> pa.Array:
    linked = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        linked.append(100 * both >= 80 * (len(x) + len(y) - both))
    return pa.array(linked, pa.bool_())


def _verified(pairs: DataFrame, texts: DataFrame, heads: DataFrame | None, size: int) -> DataFrame:
    """The pairs (`a`, `b`) whose whole sets are similar enough; where ids repeat, `heads` tells which texts count."""
    ids = stored(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "pair-ids")
    sets = picked(texts, ids, "doc", "left_semi").mapInArrow(_whole_sets(size), "doc bigint, s1 bigint, s binary")
    if heads is not None:
        sets = sets.join(heads.select("doc", "s1"), ["doc", "s1"], "left_semi").dropDuplicates(["doc"])
    sets = stored(sets.drop("s1"), "sets")
    linked = F.arrow_udf(_overlaps, "boolean")
    both = (
        pairs.join(sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a")
        .join(sets.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")
        .select("a", "b", linked("sa", "sb").alias("ok"))
    )
    return both.filter("ok").select("a", "b")


def _node_rows(rows: DataFrame, node_docs: int) -> DataFrame:
    """Rows (token, doc, n, comp, bits, mine) with the node pair they are compared under (x, y) and their side.

    The documents of a large root are cut by size band, by the component that fills a node on its own,
    and by hash; pairs of nodes of one component or of sizes too far apart go.
    """
    size = rows.groupBy("token").agg(F.count("*").alias("all"))
    large = stored(size.filter(F.col("all") > node_docs), "large-roots")
    plain = rows.join(large, "token", "left_anti")
    plain = plain.select("token", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(2).alias("side"), "doc", "n", "comp", "bits", "mine")
    if large.isEmpty():
        return plain
    many = rows.join(large, "token", "left_semi").withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.12))))
    own = many.groupBy("token", "comp").agg(F.count("*").alias("own"))
    own = stored(own.filter(F.col("own") > node_docs).select("token", "comp", F.lit(True).alias("alone")), "large-comps")
    many = many.join(own, ["token", "comp"], "left")
    many = stored(many.withColumn("who", F.when(F.col("alone"), F.col("comp")).otherwise(-1)).drop("alone"), "large-rows")
    cells = many.groupBy("token", "band", "who").agg(F.count("*").alias("cell"))
    cells = stored(cells.withColumn("parts", F.ceil(F.col("cell") / node_docs).cast("int")).drop("cell"), "cells")
    split = many.join(cells, ["token", "band", "who"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    split = split.withColumn("node", F.xxhash64("band", "who", "part"))
    nodes = split.groupBy("token", "node", "who").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    nodes = stored(nodes, "nodes")
    left = nodes.select("token", F.col("node").alias("x"), F.col("who").alias("wx"), F.col("low").alias("lx"), F.col("high").alias("hx"))
    right = nodes.select("token", F.col("node").alias("y"), F.col("who").alias("wy"), F.col("low").alias("ly"), F.col("high").alias("hy"))
    met = left.join(right, "token").filter("x <= y and (wx < 0 or wx <> wy) and 5 * hy >= 4 * lx and 5 * hx >= 4 * ly")
    met = stored(met.select("token", "x", "y"), "node-pairs")
    split = split.select("token", "node", "doc", "n", "comp", "bits", "mine")
    side = F.when(F.col("x") == F.col("y"), 2)
    first = split.join(met.withColumn("node", F.col("x")), ["token", "node"]).withColumn("side", side.otherwise(0))
    second = split.join(met.filter("x <> y").withColumn("node", F.col("y")), ["token", "node"]).withColumn("side", F.lit(1))
    columns = ["token", "x", "y", "side", "doc", "n", "comp", "bits", "mine"]
    return plain.select(*columns).union(first.select(*columns)).union(second.select(*columns))


def similar_sets(docs: DataFrame, size: int = SIZE, node_docs: int = NODE_DOCS) -> DataFrame:
    """`doc_id`, `n_shingles` and `component_id` of every row of `docs` (a row per row).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case.  Two documents link when 100 times their common
    distinct shingles is at least 80 times all their shingles; a text of fewer words is one shingle, a
    null or empty one has none and links with nothing.  `component_id` is the smallest id reachable by
    links.  Rows that repeat an id are one document; of different texts the one with most shingles counts.
    A row without an id links with nothing and has neither shingles nor component.  Shingles are compared by 64 bits of hash, equal sets by 128
    bits and their size.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").filter("doc is not null")
    frequent, rank = _frequent(texts, size)
    scanned = stored(texts.mapInArrow(_scan(size, frequent, rank), _SCAN), "scanned")
    one = scanned.groupBy("doc").agg(F.max(F.struct("n", "s1", "s2")).alias("m"), F.count("*").alias("times"))
    one = stored(one.select("doc", "m.*", "times"), "one-text-each")
    classes = stored(one.groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep")), "classes")
    member = stored(one.join(classes, ["s1", "s2", "n"]).select("doc", "n", "rep"), "members")
    # the head of each class is searched, the other members are not
    heads = picked(scanned, member.filter("doc <> rep").select("doc"), "doc", "left_anti")
    repeated = not one.filter("times > 1").isEmpty()
    if repeated:
        heads = heads.join(one, ["doc", "n", "s1", "s2"], "left_semi").dropDuplicates(["doc"])
    rows = heads.select("doc", "n", F.explode("prefix").alias("token"))
    # roots that lead to the same documents are one root that counts several times
    held = rows.groupBy("token").agg(
        F.count("*").alias("all"), F.min("doc").alias("lead"),
        F.bit_xor(F.xxhash64("doc")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(5), "doc")).alias("x2"),
    )
    roots = held.filter("all > 1").groupBy("all", "lead", "x1", "x2")
    roots = stored(roots.agg(F.min("token").alias("token"), F.count("*").alias("weight")).select("token", "lead", "weight"), "roots")
    few = F.broadcast(roots) if roots.count() <= SENT_IDS else roots
    rows = stored(rows.join(few, "token"), "root-rows")
    # first links: every document with the leading document it shares most roots with
    shared = rows.filter("doc <> lead").groupBy("doc", "lead").agg(F.sum("weight").alias("times"), F.max("n").alias("n"))
    shared = shared.filter(F.col("times") * 12 >= F.col("n"))
    best = shared.groupBy("doc").agg(F.max(F.struct("times", (-F.col("lead")).alias("lead"))).alias("m"))
    stars = stored(best.select(F.col("doc").alias("a"), (-F.col("m.lead")).alias("b")), "stars")
    first = stored(_verified(stars, texts, heads if repeated else None, size), "links")
    early = stored(components(first), "components")
    # roots under which more than one component is left
    known = rows.drop("n").join(early.select(F.col("id").alias("doc"), "component"), "doc", "left")
    known = stored(known.select("token", "doc", F.coalesce("component", "doc").alias("comp")), "known")
    mixed = known.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    mixed = stored(mixed.select("token"), "mixed-roots")
    left = stored(picked(known, mixed, "token", "left_semi"), "mixed-rows")
    mine = left.groupBy("doc").agg(F.array_sort(F.collect_set("token")).alias("mine"))
    left = left.join(mine.join(heads.select("doc", "n", "bits"), "doc"), "doc")
    groups = _node_rows(stored(left, "tree-rows"), node_docs)
    groups = groups.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "side", "doc")
    pairs = stored(groups.mapInArrow(_candidates, "a bigint, b bigint").distinct(), "candidates")
    links = first.union(_verified(pairs, texts, heads if repeated else None, size))
    reached = stored(components(links), "components")
    # a class has the component of its head, or is one itself
    member = member.join(reached, member["rep"] == reached["id"], "left")
    member = member.select("doc", "n", F.coalesce("component", "rep").alias("component"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = own.join(member, own["doc_id"] == member["doc"], "left")
    return out.select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` without the documents of a component other than its smallest id; rows without an id stay."""
    gone = similar_sets(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    gone = stored(gone, "similar")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
