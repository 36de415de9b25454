"""Order-dependent work inside groups of any size.

A plain window puts a whole group into one task. One slot, run or entity may hold a large share of
all rows, so these helpers cut each group into slices, work inside the slices in parallel, and carry
one small row per slice across the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import written


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first `k` rows of each key.

    The `rank <= k` filter lets Spark keep only k rows per key in each map task before it shuffles
    (WindowGroupLimit), so a hot key sends k rows per task, not all of them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


#: A key is hot from so many rows on; at most so many of the hottest keys are broadcast.
HOT_ROWS, HOT_KEYS = 64, 500_000


def join_hot(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows with `table` on one column, without moving the rows of hot keys.

    Keys are counted first. What the table holds of the hottest is broadcast, so that a key with very many
    rows neither fills a task nor sends them over the network; the rows of all other keys are shuffled.
    """
    if rows.isStreaming or table.isStreaming:
        return rows.join(table, key)
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    size = F.floor(F.log2("_n")).alias("_size")
    often = written(counts.filter(F.col("_n") >= HOT_ROWS).select(key, size), "often")
    least, kept = None, 0
    for found in often.groupBy("_size").count().orderBy(F.desc("_size")).collect():
        kept += found["count"]
        if kept > HOT_KEYS:
            break
        least = found["_size"]
    if least is None:
        return rows.join(table, key)
    chosen = often.filter(F.col("_size") >= least).select(key)
    hot = written(table.join(F.broadcast(chosen), key, "left_semi"), "hot")
    if hot.count() > 2 * HOT_KEYS:
        return rows.join(table, key)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(chosen), key, "left_anti").join(table, key)
    return near.unionByName(far)


#: Of so many rows one is looked at to find keys of very many rows; a key met so often there is one.
SAMPLE, OFTEN = 1_000, 32


def apart(rows: DataFrame, key: str) -> list[DataFrame]:
    """The rows as one or two tables that share no key: most keys' rows side by side, those of hot keys as they are.

    A partial aggregate or limit of keys with few rows each takes nothing away, but sorts (and spills) all rows in
    the map tasks. Here they are moved once and need no further shuffle by this key. Keys of very many rows (tens
    of thousands, looked for in a sample) stay where they are, for operators that combine before a shuffle. Which
    keys those are decides how rows meet, never a result.
    """
    if rows.isStreaming:
        return [rows]
    met = rows.select(F.col(key).alias("_hot")).sample(1 / SAMPLE, seed=1)
    met = met.groupBy("_hot").agg(F.count(F.lit(1)).alias("_n"))
    hot = written(met.filter(F.col("_n") >= OFTEN).select("_hot"), "hot-keys")
    if hot.isEmpty():
        return [rows.repartition(key)]
    same = F.col(key).eqNullSafe(F.col("_hot"))
    few = rows.join(F.broadcast(hot), same, "left_anti")
    return [few.repartition(key), rows.join(F.broadcast(hot), same, "left_semi")]


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    carry: Sequence[str],
    out: str,
    forward: bool = True,
    grain: str = "hour",
) -> DataFrame:
    """Adds `out`: the `carry` fields of the next (or previous) later moment in the row's group.

    Rows of one moment share their neighbour; among several rows of the neighbouring moment the
    smallest `carry` is taken. Moments are cut into slices of one `grain`, so no task holds more
    than one slice of one group, plus one row per slice. Keys must not be null.
    """
    keys = list(keys)
    shift = F.lead if forward else F.lag
    moments = (
        df.filter(F.col(at).isNotNull())
        .groupBy(*keys, F.col(at).alias("_at"))
        .agg(F.min(F.struct(*carry)).alias("_carry"))
        .withColumn("_slice", F.date_trunc(grain, "_at"))
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("_at")
    within = moments.withColumn("_near", shift("_carry").over(inside))

    edge = F.min_by if forward else F.max_by
    across = Window.partitionBy(*keys).orderBy("_slice")
    slices = (
        moments.groupBy(*keys, "_slice")
        .agg(edge("_carry", "_at").alias("_edge"))
        .withColumn("_far", shift("_edge").over(across))
        .filter(F.col("_far").isNotNull())
        .select(*keys, "_slice", "_far")
    )
    found = (
        within.join(slices, [*keys, "_slice"], "left")
        .withColumn(out, F.coalesce("_near", "_far"))
        .filter(F.col(out).isNotNull())
        .select(*keys, F.col("_at").alias(at), out)
    )
    return df.join(found, [*keys, at], "left")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: Sequence[str],
    width: int = 4096,
) -> DataFrame:
    """Adds `running_<value>` for each value, summed over the positions up to the row's own.

    Positions are cut into segments of `width`; only one total per segment crosses the group.
    """
    keys = list(keys)
    cut = df.withColumn("_segment", F.floor(F.col(position) / width))
    inside = (
        Window.partitionBy(*keys, "_segment")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_segment").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    carried = totals.select(
        *keys, "_segment", *[F.sum(f"_sum_{v}").over(before).alias(f"_before_{v}") for v in values]
    )
    rows = cut.select("*", *[F.sum(v).over(inside).alias(f"_inside_{v}") for v in values])
    joined = rows.join(carried, [*keys, "_segment"], "left")
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_inside_{v}") + F.coalesce(F.col(f"_before_{v}"), F.lit(0))).alias(
                f"running_{v}"
            )
            for v in values
        ],
    )


def cumulative_at(
    probes: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    out: str,
    total: bool = False,
    grain: str = "day",
) -> DataFrame:
    """Adds `out` to `probes`: the largest `value` (or their sum) of the key's events up to the row's moment.

    An as-of join on a range of moments without pairing rows: equal probes and the events of one moment
    collapse first, both are put in one order, and moments are cut into slices of one `grain` as in
    `neighbour`; one row per key and slice crosses the slices. Without keys that is one row per slice of
    time. Null without an event. Keys and moments must not be null.
    """
    keys = list(keys)
    combine = F.sum if total else F.max
    asked = probes.select(*keys, F.col(at).alias("_at")).distinct()
    told = events.groupBy(*keys, F.col(at).alias("_at")).agg(combine(value).alias("_value"))
    rows = told.withColumn("_asks", F.lit(False)).unionByName(
        asked.withColumn("_asks", F.lit(True)), allowMissingColumns=True
    )
    rows = rows.withColumn("_slice", F.date_trunc(grain, "_at"))
    # events of a moment count for a probe of that moment
    inside = Window.partitionBy(*keys, "_slice").orderBy("_at").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    within = rows.withColumn("_inside", combine("_value").over(inside)).filter("_asks")
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(*keys, "_slice").agg(combine("_value").alias("_whole"))
    slices = slices.select(*keys, "_slice", combine("_whole").over(across).alias("_before"))
    both = F.greatest("_inside", "_before")
    if total:
        zero = F.lit(0)
        both = F.coalesce("_inside", zero) + F.coalesce("_before", zero)
    found = within.join(slices, [*keys, "_slice"]).select(*keys, F.col("_at").alias(at), both.alias(out))
    return probes.join(found, [*keys, at], "left")


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): for every end of `links` (a, b) the smallest end that it is connected to.

    Rounds of two star steps: all larger neighbours of a node are linked to the smallest one, then all
    smaller ones, until every component is a star; the rounds grow with the logarithm of the longest chain.
    Minima combine before the shuffle and are joined back, so a node of very many links is no hot group.
    """
    pairs = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a <> b").distinct(), "links")
    for _ in range(rounds):
        roots = pairs.select(F.col("b").alias("a")).distinct()
        several = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if several.isEmpty() and pairs.join(roots, "a", "left_semi").isEmpty():
            ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
            return ends.unionByName(roots.select(F.col("a").alias("id"), F.col("a").alias("component")))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        across = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = written(across.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "links")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


SEGMENT = 256
#: Up to so many needles their grams may be broadcast; those of more are joined by sorting.
FEW_NEEDLES = 10_000


def segments(texts: DataFrame, text: str, overlap: int, out: str = "_segment") -> DataFrame:
    """`texts` with `out` instead of `text`: a row for every 256 characters and the `overlap` behind them.

    What is at most `overlap` + 1 characters long and stands in a text stands in one of its segments.
    """
    cut = texts.withColumn("_pieces", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0)))
    ahead = -(-overlap // SEGMENT)
    tail = F.left(F.array_join(F.slice("_pieces", F.col("_at") + 2, F.lit(max(ahead, 1))), ""), F.lit(overlap))
    return (
        cut.drop(text)
        .select("*", F.posexplode("_pieces").alias("_at", "_piece"))
        .withColumn(out, F.concat("_piece", tail))
        .drop("_pieces", "_at", "_piece")
    )


def _grams(df: DataFrame, text: str, sizes: Sequence[int], longest_only: bool) -> DataFrame:
    """`df` with a row for each distinct gram of `text`, as a hash `_gram` of 2^k characters.

    Of all sizes that fit in, or of the largest one only.
    """
    length = F.length(text)

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(length - n + 1, F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.lit(n), F.substring(F.col(text), i, F.lit(n))))
        return F.when(length >= n, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))

    if longest_only:
        every = F.array().cast("array<bigint>")
        for n in sorted(sizes):
            every = F.when(length >= n, of(n)).otherwise(every)
    else:
        every = F.concat(*[of(n) for n in sizes])
    return df.withColumn("_gram", F.explode(every))


def containing(
    needles: DataFrame,
    needle: str,
    texts: DataFrame,
    text: str,
    on: Sequence[str] = (),
) -> DataFrame:
    """The columns of `needles` and of `texts` but `text`, where the text contains the needle.

    An inverted index of grams: texts are cut into segments of bounded size and those into grams of 1, 2, 4
    ... characters, as far as needles are that long; a needle looks up its rarest gram of the largest such
    size within it and is compared with the segments that hold it. Work and rows grow with the length of the
    texts and, for the comparison, with the holders of rare grams; there is no row with a whole text, and of many
    needles nothing passes through the driver. The other
    columns of `texts` should tell its rows apart (an id or a hash of the text), and rows that do not differ
    in them count once. Blank needles match nothing.
    """
    on = list(on)
    known = needles.filter(F.length(needle) > 0)
    length = F.length(needle)
    powers = F.collect_set(F.floor(F.log2(length)).cast("int")).alias("k")
    widths, longest, many = known.agg(powers, F.max(length), F.count(F.lit(1))).first()
    # the planner takes the grams of all needles for as small as their table, and would broadcast them
    join = (lambda df: df.hint("merge")) if many > FEW_NEEDLES else (lambda df: df)
    rest = [c for c in texts.columns if c != text]
    sizes, longest = sorted(1 << k for k in widths) or [1], longest or 1
    cut = segments(texts, text, longest - 1)
    # a short text becomes many grams, so the grams of few texts must not lie in few partitions
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(cut.withColumn("_seg", F.monotonically_increasing_id()), "segments")
    held = _grams(cut.select(*on, "_seg", "_segment").repartition(width, "_seg"), "_segment", sizes, False)
    held = held.drop("_segment")
    wanted = _grams(known.select(*on, needle).distinct(), needle, sizes, True)
    # only grams that some needle has are kept, and counted
    asked = wanted.select(*on, "_gram").distinct()
    held = written(held.join(join(asked), [*on, "_gram"], "left_semi"), "grams")
    counts = held.groupBy(*on, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    # a needle with a gram that no text has is in no text
    counted = wanted.join(join(counts), [*on, "_gram"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    chosen = counted.groupBy(*on, needle).agg(F.min(F.struct("_n", "_gram")).alias("_r")).filter("_r._n > 0")
    chosen = chosen.select(*on, F.col(needle).alias("_needle"), F.col("_r._gram").alias("_gram"))
    met = chosen.join(join(held), [*on, "_gram"]).join(join(cut.drop(*on)), "_seg")
    found = met.filter(F.contains("_segment", F.col("_needle"))).select("_needle", *rest, *[c for c in on if c not in rest])
    return known.withColumn("_needle", F.col(needle)).join(join(found.distinct()), ["_needle", *on]).drop("_needle")


def near_names(
    names: DataFrame, name: str, pool: DataFrame, other: str, share: float, on: Sequence[str] = ()
) -> DataFrame:
    """Columns of `names` and `pool` and `similarity`, where the trigram sets overlap by `share` or more.

    Similarity is the Jaccard coefficient of the trigrams of "  name ". A set of n trigrams can only reach the
    share with sets of n * share to n / share, and shares one of its rarest n - ceil(n * share) + 1 trigrams
    with each of them; these are joined, and the sets decide. Names should be distinct within `on`.
    """
    on = list(on)

    def grams(df: DataFrame, column: str, out: str) -> DataFrame:
        padded = F.concat(F.lit("  "), F.col(column), F.lit(" "))
        starts = F.sequence(F.lit(1), F.length(padded) - 2)
        of = F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(3)))))
        return df.filter(F.length(column) > 0).withColumn(out, of)

    a, b = grams(names, name, "_a"), grams(pool, other, "_b")
    counts = b.select(*on, F.explode("_b").alias("_gram")).groupBy(*on, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts, "trigrams")

    def prefix(df: DataFrame, column: str, id: str) -> DataFrame:
        """The rarest trigrams of each name, of which one must be shared."""
        every = df.select(*on, id, F.explode(column).alias("_gram"), F.size(column).alias("_size"))
        ranked = every.join(counts, [*on, "_gram"], "left").groupBy(*on, id, "_size").agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram"))).alias("_g")
        )
        first = F.col("_size") - F.ceil(F.col("_size") * share - 1e-9).cast("int") + 1
        return ranked.select(*on, id, "_size", F.explode(F.slice("_g", F.lit(1), first)).alias("_r")).select(
            *on, id, F.col("_size").alias(f"_size{column}"), F.col("_r._gram").alias("_gram")
        )

    met = prefix(a, "_a", name).join(prefix(b, "_b", other), [*on, "_gram"])
    low, high = F.least("_size_a", "_size_b"), F.greatest("_size_a", "_size_b")
    pairs = met.filter(low >= high * share - 1e-9).select(*on, name, other).distinct()
    both = F.size(F.array_intersect("_a", "_b"))
    scored = pairs.join(a, [*on, name]).join(b, [*on, other])
    scored = scored.withColumn("similarity", both / (F.size("_a") + F.size("_b") - both))
    return scored.filter(F.col("similarity") >= share - 1e-9).drop("_a", "_b")
