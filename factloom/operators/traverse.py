"""Bounded traversal of the fact graph, hop by hop.

Each hop joins the set of newly reached nodes (every node once) to the edges. Paths are not
enumerated: through a busy node their number grows with the product of its edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import is_current, target_node
from factloom.session import durable, scratch, small_table, spread, written

BROADCAST_ROWS = 200_000


def _edges(
    facts: DataFrame, include_stale: bool, labels: Sequence[str] | None, need_fact: bool
) -> DataFrame:
    kept = facts if include_stale else facts.filter(is_current())
    if labels:
        kept = kept.filter(F.col("edge_label").isin([name.upper() for name in labels]))
    if need_fact:
        kept = kept.filter(F.col("fact").isNotNull())
    return kept.withColumn("to_node", target_node())


def _links(edges: DataFrame, *carry: str) -> DataFrame:
    """Each edge in both directions, from one scan."""
    ways = F.array(
        F.struct(
            F.col("from_id").alias("node"), F.col("to_node").alias("other"), F.lit(True).alias("out")
        ),
        F.struct(
            F.col("to_node").alias("node"), F.col("from_id").alias("other"), F.lit(False).alias("out")
        ),
    )
    return edges.select(*carry, F.explode(ways).alias("w")).select(*carry, "w.*")


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the (already written) rows are few; their number is looked at first."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df


@dataclass(frozen=True)
class Neighbourhood:
    nodes: DataFrame  # node, depth, name, node_type
    edges: DataFrame  # edges on some path of the given length
    source_records: DataFrame


def _name_nodes(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    names = entities.select(
        F.col("entity_id").alias("node"), "name", F.col("entity_type").alias("node_type")
    )
    day = F.startswith("node", F.lit("day:"))
    return nodes.join(names, "node", "left").select(
        *nodes.columns,
        F.when(day, F.substr("node", F.lit(5))).otherwise(F.coalesce("name", F.lit("?"))).alias(
            "name"
        ),
        F.when(day, "day").otherwise(F.col("node_type")).alias("node_type"),
    )


def connections(
    facts: DataFrame,
    entities: DataFrame,
    start: str,
    depth: int = 3,
    include_stale: bool = False,
    labels: Sequence[str] | None = None,
    include_start: bool = False,
) -> Neighbourhood:
    """Everything within `depth` edges of an entity, in either direction; days are nodes too.

    An edge belongs to the result when some path of at most `depth` edges uses it, which is when one
    of its ends lies less than `depth` away.
    """
    spark = facts.sparkSession
    edges = _edges(facts, include_stale, labels, need_fact=False)
    links = _links(edges).select("node", "other")
    origin = small_table(spark, [(start, 0)], "node string, depth int")
    reached, frontier = origin, None
    for hop in range(1, depth + 1):
        if frontier is None:
            step = links.filter(F.col("node") == start)
        else:
            step = links.join(_small(frontier.select("node")), "node", "left_semi")
        found = step.select(F.col("other").alias("node")).distinct()
        fresh = found.join(reached, "node", "left_anti").withColumn("depth", F.lit(hop))
        frontier = durable(fresh)
        reached = reached.unionByName(frontier)
    near = reached.filter(F.col("depth") < depth).select("node")
    near = _small(near)
    used = edges.join(near.withColumnRenamed("node", "from_id"), "from_id", "left_semi")
    more = edges.join(near.withColumnRenamed("node", "to_node"), "to_node", "left_semi").join(
        near.withColumnRenamed("node", "from_id"), "from_id", "left_anti"
    )
    all_edges = used.unionByName(more.select(*used.columns))
    nodes = reached if include_start else reached.filter("depth > 0")
    sources = (
        all_edges.filter(F.col("source_record").isNotNull()).select("source_record").distinct()
    )
    return Neighbourhood(_name_nodes(nodes, entities), all_edges, sources)


def direct_facts(facts: DataFrame, a: str, b: str) -> DataFrame:
    """Current facts between two nodes, in either direction."""
    edges = _edges(facts, include_stale=False, labels=None, need_fact=True)

    def ends(x: str, y: str) -> Column:
        return (F.col("from_id") == x) & (F.col("to_node") == y)

    return edges.filter(ends(a, b) | ends(b, a)).select(
        "edge_id", "edge_label", "fact_type", "fact", "source_at", "from_id"
    )


def adjacency(facts: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """Current edges by both of their ends, as a table bucketed and sorted by node.

    For many searches over the same facts: a hop from a large frontier joins the table without moving it.
    The table has its name in the session's catalogue, where it replaces one of that name, and its files
    below the shared folder.
    """
    edges = _edges(facts, include_stale=False, labels=None, need_fact=True)
    links = _links(edges, "edge_id").drop("out").filter("node IS NOT NULL AND other IS NOT NULL")
    spark = facts.sparkSession
    writer = links.write.mode("overwrite").option("path", scratch(spark, table))
    writer.bucketBy(buckets, "node").sortBy("node").saveAsTable(table)
    return spark.table(table)


@dataclass
class _Side:
    """One end of a search: its outermost nodes, each with its smallest list of edges to that end."""

    frontier: DataFrame  # node, path
    reached: DataFrame  # node
    count: int = 1
    depth: int = 0

    def grow(self, step: DataFrame, ahead: bool) -> None:
        """`step` has (other, edge_id, path): one edge further, at the path's end or at its beginning."""
        edge = F.array("edge_id")
        longer = F.concat("path", edge) if ahead else F.concat(edge, F.col("path"))
        best = step.groupBy(F.col("other").alias("node")).agg(F.min(longer).alias("path"))
        self.frontier = written(best.join(self.reached, "node", "left_anti"), "frontier")
        self.reached = self.reached.unionByName(self.frontier.select("node"))
        self.depth += 1

    def meet(self, other: _Side, ahead: bool) -> list[str] | None:
        """Counts the new frontier; the smallest whole list through a node that both sides have reached, if any."""
        there = other.frontier.withColumnRenamed("path", "rest").withColumn("met", F.lit(True))
        # the list of the search's first end decides before that of the second
        whole = F.concat("path", "rest") if ahead else F.concat("rest", "path")
        both = F.min(F.when(F.col("met"), whole))
        row = self.frontier.join(there, "node", "left").agg(F.count(F.lit(1)).alias("n"), both.alias("p")).first()
        self.count = row.n
        return None if row.p is None else list(row.p)


def _touching(edges: DataFrame, side: _Side, links: DataFrame | None) -> DataFrame:
    """(other, edge_id, path) of the edges at a frontier.

    A small frontier is sent to the edges, and only those it touches are turned round.  Beyond that size
    the links of an adjacency table, or else the edges by either end, are joined with it.
    """
    if links is not None:
        nodes = F.broadcast(side.frontier) if side.count <= BROADCAST_ROWS else side.frontier
        return links.join(nodes, "node").select("other", "edge_id", "path")
    ends = [side.frontier.select(F.col("node").alias(f"{e}_node"), F.col("path").alias(f"{e}_path")) for e in "xy"]
    if side.count > BROADCAST_ROWS:
        left = edges.join(ends[0], F.col("from_id") == F.col("x_node"))
        right = edges.join(ends[1], F.col("to_node") == F.col("y_node"))
        return left.select(F.col("to_node").alias("other"), "edge_id", F.col("x_path").alias("path")).unionByName(
            right.select(F.col("from_id").alias("other"), "edge_id", F.col("y_path").alias("path"))
        )
    met = edges.join(F.broadcast(ends[0]), F.col("from_id") == F.col("x_node"), "left").join(
        F.broadcast(ends[1]), F.col("to_node") == F.col("y_node"), "left"
    )
    ways = F.array(
        F.struct(F.col("to_node").alias("other"), F.col("x_path").alias("path")),
        F.struct(F.col("from_id").alias("other"), F.col("y_path").alias("path")),
    )
    met = met.filter("x_node IS NOT NULL OR y_node IS NOT NULL").select("edge_id", F.explode(ways).alias("w"))
    return met.select("w.other", "edge_id", "w.path").filter("path IS NOT NULL")


def shortest_path(
    facts: DataFrame,
    entities: DataFrame,
    a: str,
    b: str,
    max_depth: int = 4,
    links: DataFrame | None = None,
) -> DataFrame:
    """Hops of a shortest undirected path over current facts, empty when there is none in reach.

    Of several shortest paths the one with the smallest sequence of edge ids is taken. From a node to
    itself the path is empty. `links` is an `adjacency` table of the same facts, if there is one.

    The search goes from both ends, and the end with the smaller frontier grows. A frontier has every
    node once, with its smallest list of edges to its end. All shortest paths cross the two frontiers
    when they first meet, in one node each, so the smallest list of a meeting node decides.
    """
    edges = _edges(facts, include_stale=False, labels=None, need_fact=True)
    if a == b:
        return _hops(edges, entities, a, [])
    return _hops(edges, entities, a, _search(edges, a, b, max_depth, links))


def _search(edges: DataFrame, a: str, b: str, max_depth: int, links: DataFrame | None) -> list[str]:
    spark = edges.sparkSession
    slim = edges.select("edge_id", "from_id", "to_node").filter("from_id IS NOT NULL AND to_node IS NOT NULL")
    empty = F.expr("cast(array() as array<string>)")
    sides = []
    for end in (a, b):
        node = small_table(spark, [(end,)], "node string")
        sides.append(_Side(node.withColumn("path", empty), node))
    if links is None:
        # one pass over the facts leaves the three ids of each edge, which the hops read
        slim = written(spread(slim), "edges")
    while sides[0].depth + sides[1].depth < max_depth:
        grown = int(sides[1].count < sides[0].count)
        side = sides[grown]
        side.grow(_touching(slim, side, links), ahead=grown == 0)
        met = side.meet(sides[1 - grown], ahead=grown == 0)
        if met is not None:
            return met
        if not side.count:
            return []
    return []


def _hops(edges: DataFrame, entities: DataFrame, start: str, path: list[str]) -> DataFrame:
    """The edges of one path in walking order, with names and directions."""
    spark = edges.sparkSession
    places = small_table(spark, list(enumerate(path)), "hop int, edge_id string")
    on_path = edges.filter(F.col("edge_id").isin(path)).join(places, "edge_id")
    on_path = written(on_path.select("hop", "edge_id", "edge_label", "fact_type", "fact", "from_id", "to_node"), "path")
    by_hop = {
        r.hop: (r.from_id, r.to_node)
        for r in on_path.select("hop", "from_id", "to_node").collect()
    }
    here, walk = start, []
    for hop in range(len(path)):
        source, target = by_hop[hop]
        outgoing = source == here
        there = target if outgoing else source
        walk.append((hop, here, there, "outgoing" if outgoing else "incoming"))
        here = there
    steps = small_table(
        spark, walk, "hop int, node string, next_node string, direction string"
    )
    detailed = steps.join(
        on_path.select("hop", "edge_id", "edge_label", "fact_type", "fact"), "hop"
    )
    wanted = list({n for row in walk for n in row[1:3]})
    few = entities.filter(F.col("entity_id").isin(wanted))
    near = _name_nodes(detailed, few).withColumnsRenamed({"name": "from_name"}).drop("node_type")
    swapped = near.withColumnsRenamed({"node": "_here", "next_node": "node"})
    far = _name_nodes(swapped, few).withColumnsRenamed({"name": "to_name"})
    return far.select(
        "hop", "from_name", "to_name", "edge_id", "edge_label", "fact_type", "fact", "direction"
    )
