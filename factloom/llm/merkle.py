"""Merkle manifest of a dataset: one root over all rows, and a proof for each of them.

Rows are leaves, ordered within their source; 16 consecutive nodes become one until a source has a single
one, and the sources' nodes are reduced to the root in the same way.  Leaves are ranked without a global
sort: rows are dealt by ranges, numbered inside their partition, and counts per partition give the rest.

A superblock is a subtree of 16^2 leaves.  Its top comes from one aggregate; the levels above hold a 256th
of the leaves and are reduced with their children kept, so that walking down again gives each superblock
the nodes outside of it that its proofs need.  Leaves and these outer nodes then meet in one cogroup by
superblock, which reduces the leaves again, joins the proofs, and folds the claimed leaves to a root.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.lines import SMALL, UPPER
from factloom.llm.store import stored

FAN = 16
#: Levels inside a superblock, and its leaves.
DEPTH = 2
SUPER = FAN**DEPTH
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# So many rows of counts (one for each partition and source) are sent to all tasks; more are joined.
SENT_COUNTS = 200_000
PROOF = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after another."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**columns: Column) -> Column:
    return digest(*[field(columns[c]) for c in LEAF_COLUMNS])


def _above(hashes: Column, size: Column) -> Column:
    """The next level: every 16 consecutive hashes of an array (the last run has fewer) become one."""
    runs = F.sequence(F.lit(0), ((size - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(hashes, i * FAN + 1, FAN), "").cast("binary"), 256))


def _depth(n: Column) -> Column:
    """Levels above `n` leaves: the smallest d with 16^d >= n."""
    return reduce(lambda above, k: F.when(n > FAN**k, k + 1).otherwise(above), range(15), F.lit(0)).cast("int")


def numbered(df: DataFrame, group: str | None, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """`df` with `rank` within `group` (null is a group) by `order` and its group's `n`; and n per group.

    Dealt by ranges of (group, order), so a hot group lies in many partitions; what is gathered per group
    are counts, one for each partition that holds some of it.  `order` should tell all rows apart.
    """
    keys = ([F.col(group).asc_nulls_first()] if group else []) + [F.col(c).asc_nulls_first() for c in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33).alias("__part")
    own = (F.col(group) if group else F.lit(None).cast("string")).alias("__g")
    counts = placed.groupBy(part, own).agg(F.count("*").alias("__c"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = counts.groupBy("__g").agg(F.sum("__c").alias("__n"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    counts = counts.alias("c").join(whole.alias("w"), F.expr("c.__g <=> w.__g")).select(
        "c.__part", F.col("c.__g").alias("__cg"), (F.col("c.__before") - F.col("c.__first")).alias("__shift"), "w.__n"
    )
    counts = stored(counts, f"{name}-counts")
    if counts.count() <= SENT_COUNTS:
        counts = F.broadcast(counts)
    rows = placed.withColumn("__p", F.shiftright("__at", 33))
    same = (rows["__p"] == counts["__part"]) & (
        rows[group].eqNullSafe(counts["__cg"]) if group else counts["__cg"].isNull()
    )
    ranked = rows.join(counts, same).withColumn("rank", F.col("__at") + F.col("__shift")).withColumnRenamed("__n", "n")
    return ranked.drop("__at", "__p", "__part", "__cg", "__shift"), whole


def _reduced(nodes: DataFrame, done: int, top: int, name: str) -> list[DataFrame]:
    """Levels over `nodes` (g, idx, h, depth), which are `done` levels above the leaves, up to level `top`.

    Each level has (g, idx, h, depth, kids); a group of less depth stays out of the levels it has not.
    """
    levels = []
    for level in range(done, top):
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"])
        grown = (
            nodes.filter(F.col("depth") > level)
            .groupBy("g", "depth", F.floor(F.col("idx") / FAN).alias("up"))
            .agg(kids.alias("kids"))
        )
        nodes = stored(
            grown.select(
                "g", F.col("up").alias("idx"), F.sha2(F.array_join("kids", "").cast("binary"), 256).alias("h"),
                "depth", "kids",
            ),
            f"{name}-{level + 1}",
        )
        levels.append(nodes)
    return levels


def _outer(levels: list[DataFrame], tops: DataFrame, done: int) -> DataFrame:
    """(g, idx, path) of the nodes below all `levels`: siblings on the way up, nearest first.

    `tops` (g, depth, path) has each group's nodes above its own top.
    """
    same = F.expr("n.g <=> t.g")
    ways = tops.filter(F.col("depth") <= done).select("g", F.lit(0).cast("long").alias("idx"), "path")
    below: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        level = done + k + 1
        begun = levels[k].filter(F.col("depth") == level).alias("n").join(tops.alias("t"), same)
        begun = begun.select("n.g", "n.idx", "n.kids", "t.path")
        if below is not None:
            same_node = F.expr("n.g <=> t.g AND n.idx = t.idx")
            more = levels[k].alias("n").join(below.alias("t"), same_node)
            begun = begun.unionByName(more.select("n.g", "n.idx", "n.kids", "t.path"))
        below = begun.select("g", "idx", "path", "kids", F.posexplode("kids").alias("at", "h")).select(
            "g",
            (F.col("idx") * FAN + F.col("at")).alias("idx"),
            F.concat(
                F.array(
                    F.struct(
                        F.array_join(F.slice("kids", F.lit(1), F.col("at")), "").alias("before"),
                        F.array_join(F.slice("kids", F.col("at") + 2, F.lit(FAN)), "").alias("after"),
                    )
                ),
                F.col("path"),
            ).alias("path"),
        )
    return ways if below is None else ways.unionByName(below)


def _hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _fold(own: str, proof: list[tuple[str, str]]) -> str:
    for before, after in proof:
        own = _hash(before, own, after)
    return own


def _proved(leaves: list[str], levels: int) -> list[list[tuple[str, str]]]:
    """The siblings of each leaf on its way up `levels` levels."""
    proofs: list[list[tuple[str, str]]] = [[] for _ in leaves]
    nodes = leaves
    for level in range(levels):
        above = []
        for a in range(0, len(nodes), FAN):
            run = "".join(nodes[a : a + FAN])
            above.append(_hash(run))
            for k in range(len(nodes[a : a + FAN])):
                pair = (run[: 64 * k], run[64 * (k + 1) :])
                width = FAN**level
                for leaf in range((a + k) * width, min((a + k + 1) * width, len(leaves))):
                    proofs[leaf].append(pair)
        nodes = above
    return proofs


def _finish(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The rows of some superblocks with subroot, root, proof, and the root that the claimed leaf folds to."""
    ways = {(None if pd.isna(r.source) else r.source, r.block): r for r in outer.itertuples()}
    done = []
    for (source, block), own in leaves.groupby(["source", "block"], dropna=False, sort=False):
        way = ways[None if pd.isna(source) else source, block]
        own = own.sort_values("place", kind="stable")
        path = [(p["before"], p["after"]) for p in way.path]
        proofs = [p + path for p in _proved(own["leaf"].tolist(), int(way.levels))]
        own = own.assign(
            subroot=way.subroot,
            root=way.root,
            proof=[[{"before": a, "after": b} for a, b in p] for p in proofs],
            # a leaf that claims nothing else folds like its own
            folded_root=[
                _fold(leaf if claimed is None else claimed, p)
                for leaf, claimed, p in zip(own["leaf"], own["claimed"], proofs, strict=True)
            ],
        )
        done.append(own[["doc_id", "no_id", "leaf", "subroot", "root", "proof", "folded_root"]])
    if not done:
        return pd.DataFrame({c: [] for c in ("doc_id", "no_id", "leaf", "subroot", "root", "proof", "folded_root")})
    return pd.concat(done, ignore_index=True)


def manifest(docs: DataFrame, claimed_text: Column | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, leaf, subroot, root, proof (from the leaf up), folded_root, verified.

    `claimed_text` is the text that someone presents as a row's (default: its own); `folded_root` is what
    its leaf gives with the row's proof, and `verified` whether that is the root.  Nulls in any column are
    values of their own; a null source is a source, a null doc_id comes first.  Rows that share source
    and doc_id are ordered by their leaf, and fully equal rows are leaves each.  Columns beyond the five
    named in `LEAF_COLUMNS` play no part.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = {c: F.col(c) for c in LEAF_COLUMNS}
    claimed = F.lit(None).cast("string") if claimed_text is None else leaf_of(**own | {"text": claimed_text})
    leaves = docs.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(**own).alias("leaf"), claimed.alias("claimed"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = stored(leaves.withColumn("claimed", F.expr("nullif(claimed, leaf)")), "leaves")
    placed, sources = numbered(leaves, "source", ["doc_id", "leaf", "row"], "leaves-placed")
    placed = placed.withColumn("block", F.floor(F.col("rank") / SUPER)).withColumn(
        "place", F.pmod("rank", F.lit(SUPER)).cast("int")
    )
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"])
    blocks = placed.groupBy(F.col("source").alias("g"), F.col("block").alias("idx"), "n").agg(hashes.alias("l0"))
    blocks = blocks.withColumn("depth", _depth(F.col("n"))).withColumn("l1", _above(F.col("l0"), F.size("l0")))
    top = F.when(F.col("depth") == 0, F.col("l0")[0]).when(F.col("depth") == 1, F.col("l1")[0])
    whole = top.otherwise(_above(F.col("l1"), F.size("l1"))[0])
    blocks = stored(blocks.select("g", "idx", whole.alias("h"), "depth"), "superblocks")
    deepest = blocks.agg(F.max("depth")).first()[0]
    if deepest is None:
        deepest = 0
    levels = _reduced(blocks, DEPTH, deepest, "nodes")
    tops = [blocks.filter(F.col("depth") <= DEPTH)] + [
        level.filter(F.col("depth") == DEPTH + 1 + k) for k, level in enumerate(levels)
    ]
    subroots = reduce(DataFrame.unionByName, [t.select("g", "h", "depth") for t in tops])

    # the sources' nodes, null first, are the leaves of the tree above
    seats, _ = numbered(subroots, None, ["g"], "subroots")
    seats = stored(seats.select("g", "h", "depth", F.col("rank").alias("idx"), "n"), "seats")
    upper = seats.select(F.lit(None).cast("string").alias("g"), "idx", "h", _depth(F.col("n")).alias("depth"))
    height = upper.agg(F.max("depth")).first()[0] or 0
    crown = _reduced(upper, 0, height, "crown")
    root = (crown[-1] if crown else upper).select("h").first()
    nothing = spark.createDataFrame([(None, height, [])], f"g string, depth int, path {PROOF}")
    ways = _outer(crown, nothing, 0).select("idx", "path")
    tops = seats.join(ways, "idx").select("g", "depth", "path", F.col("h").alias("subroot"))
    tops = stored(tops, "source-paths")

    outer = _outer(levels, tops.select("g", "depth", "path"), DEPTH)
    bins = F.lit(max(1, -(-leaves.count() // SUPER)))
    outer = outer.alias("o").join(tops.alias("t"), F.expr("o.g <=> t.g")).select(
        F.col("o.g").alias("source"), F.col("o.idx").alias("block"), "o.path", "t.subroot",
        F.lit(root[0] if root else None).cast("string").alias("root"),
        F.least(F.col("t.depth"), F.lit(DEPTH)).alias("levels"),
    )
    # many small sources share a bin, so that groups are about as many as full superblocks
    outer = outer.withColumn("bin", F.pmod(F.xxhash64("source", "block"), bins))
    side = placed.select(
        F.pmod(F.xxhash64("source", "block"), bins).alias("bin"), "source", "block", "place",
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "leaf", "claimed",
    )
    out = side.groupBy("bin").cogroup(outer.groupBy("bin")).applyInPandas(
        _finish,
        f"doc_id long, no_id boolean, leaf string, subroot string, root string, proof {PROOF}, folded_root string",
    )
    return out.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "leaf", "subroot", "root", "proof", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def manifest_query(docs: DataFrame) -> DataFrame:
    """Every fifth document (by crc32 of its id) is presented with A-Z in lower case."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    claimed = F.when(tampered, F.translate("text", UPPER, SMALL)).otherwise(F.col("text"))
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), "")
    return manifest(docs, claimed).select(
        "doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", "verified"
    )


def _field_sql(name: str) -> str:
    value = f"CAST({name} AS VARCHAR)"
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    names = [text if c == "text" else c for c in LEAF_COLUMNS]
    return "sha256(" + " || ".join(_field_sql(c) for c in names) + ")"


def oracle(height: int = 6) -> str:
    """SQL for `manifest_query` over at most 16^`height` documents a source, and as many sources."""
    folds, last = [], "crown"
    for k in range(2 * height):
        folds.append(f"""fold_{k + 1} AS (
  SELECT doc_id, leaf, subroot, root, sib, ways,
         CASE WHEN {k} < len(ways) THEN sha256(ways[{k + 1}].before || h || ways[{k + 1}].after) ELSE h END AS h
  FROM {last})""")
        last = f"fold_{k + 1}"
    return f"""
WITH {_ways_sql(height)}, {', '.join(folds)}
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, h AS folded_root, h = root AS verified FROM {last}
"""


def _ways_sql(height: int) -> str:
    upper, lower = UPPER, SMALL
    crc = (
        "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
        "lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, crcs.t[(xor(a, b) & 255) + 1]))"
    )
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "range::BIGINT"
    steps = f"SELECT range AS i, {table} AS c FROM range(256)"
    for _ in range(8):
        steps = f"SELECT i, {step} AS c FROM ({steps})"
    parts = [
        f"crcs AS (SELECT list(c ORDER BY i) AS t FROM ({steps}))",
        f"""tampered AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 5 = 0
              THEN translate(text, '{upper}', '{lower}') ELSE text END AS shown, lang, n_chars, text
  FROM documents, crcs)""",
        f"""leaves AS (
  SELECT doc_id, source, leaf, {_leaf_sql('shown')} AS claimed, leaf AS h,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         []::STRUCT(before VARCHAR, after VARCHAR)[] AS ways FROM tampered)""",
    ]
    last = "leaves"

    def level(k: str, group: str) -> None:
        nonlocal last
        name = f"level_{k}"
        parts.append(f"""{name}_nodes AS (
  SELECT {group} AS g, idx // 16 AS up, string_agg(h, '' ORDER BY idx) AS run
  FROM (SELECT DISTINCT {group}, idx, h FROM {last}) GROUP BY ALL)""")
        parts.append(f"{name}_many AS (SELECT {group} AS g, max(idx) AS last FROM {last} GROUP BY ALL)")
        parts.append(f"""{name} AS (
  SELECT a.* EXCLUDE (idx, h, ways),
         CASE WHEN m.last = 0 THEN a.idx ELSE a.idx // 16 END AS idx,
         CASE WHEN m.last = 0 THEN a.h ELSE sha256(n.run) END AS h,
         CASE WHEN m.last = 0 THEN a.ways ELSE list_append(a.ways, {{'before': left(n.run, 64 * (a.idx % 16)),
              'after': substr(n.run, 64 * (a.idx % 16) + 65)}}) END AS ways
  FROM {last} a JOIN {name}_nodes n ON a.{group} IS NOT DISTINCT FROM n.g AND a.idx // 16 = n.up
  JOIN {name}_many m ON a.{group} IS NOT DISTINCT FROM m.g)""")
        last = name

    for k in range(height):
        level(f"s{k}", "source")
    parts.append(f"""seats AS (
  SELECT doc_id, leaf, claimed, h AS subroot, h, ways, 0 AS everything,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM {last})""")
    last = "seats"
    for k in range(height):
        level(f"r{k}", "everything")
    parts.append(f"""crown AS (
  SELECT doc_id, leaf, subroot, h AS root, claimed AS h, ways,
         array_to_string(list_transform(ways, lambda w: w.before || w.after), '') AS sib FROM {last})""")
    return ", ".join(parts)


ORACLE = oracle(4)
