"""Exact top-k search by integer inner product, block at a time.

Vectors are quantised to integers, dealt by their nearest centroids and cut into ranges of 16 blocks with
256 vectors each.  A block has its term maxima (per dimension, for weights of either sign) and its forward
index (the vectors); a range is one row of the index.  A query is scored in its own range first, which
gives a score its k-th best cannot be under.  Pages of range maxima then say which other ranges can reach
that score; only those meet the query.  Ranges lie in shelves of 16, and a query is sent once to a shelf that
holds some of its ranges.  There its blocks are ordered by the sum of weighted maxima and scored from the
highest on, until the next bound is under the k-th best score.

Bounds never underestimate and a block is left out only if its bound is under the k-th score, so results
are exact whatever the clustering.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.store import stored

SCALE = 64
BLOCK = 256
RANGE = 16 * BLOCK
PAGE = 256
#: Ranges of a shelf and their bytes on average, queries that are scored there together, and partitions that shelves
#: lie in, at most.
SHELF, SHELF_BYTES = 16, 16 << 20
TOGETHER = 2_048
PARTITIONS = 1_000
#: Pages of range maxima are broadcast up to so many bytes (counted first).
SENT_BYTES = 8 << 20
#: Rows that the centroids are fitted on at most (first ones by hash of the id), and centroids.
SAMPLE = 8_192
CENTROIDS = 64
#: Components saturate here, so that sums of up to 2^12 products stay within a long.
MOST = 1 << 25
_NONE = -(1 << 62)

_RANGES = "range long, n int, dim int, ids binary, rows binary, seats binary, high binary, low binary, asks binary"
_FOUND = "query_row long, query_id long, vec_id long, row long, score long"
_ASKED = "shelf long, own long, dim int, q_rows binary, q_ids binary, q_vectors binary, q_least binary, may binary"


def quantised(embedding: Column) -> Column:
    """floor(64 x) of each component as a long, saturating; null if a component is null or not finite."""
    as_double = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(as_double, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = F.transform(
        as_double, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * SCALE))).cast("long")
    )
    return F.when(finite, whole)


def _longs(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and each row's length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).combine_chunks().to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    values, size = _longs(column)
    dim = max(1, int(size.max(initial=0))) if dim is None else dim
    x = np.zeros((len(size), dim), dtype=np.int64)
    x[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return x


def _packed(x: np.ndarray) -> bytes:
    """Integers in the smallest width that holds them; the first byte names it."""
    for kind in "bhi":
        span = np.iinfo(kind)
        if x.min(initial=0) >= span.min and x.max(initial=0) <= span.max:
            return kind.encode() + x.astype(kind).tobytes()
    return b"q" + x.astype(np.int64).tobytes()


def _array(data: bytes, dim: int | None = None) -> np.ndarray:
    x = np.frombuffer(data, dtype=chr(data[0]), offset=1).astype(np.int64)
    return x if dim is None else x.reshape(-1, dim)


def _wide(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b^T, exact: in doubles where no sum can pass 2^53, else in longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Per query and block the sum over dimensions of the weight times its maximum for that sign."""
    return _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)


def _centroids(sample: np.ndarray, k: int = CENTROIDS, rounds: int = 8) -> np.ndarray:
    """Spherical k-means with deterministic starts."""
    x = sample.astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    c = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1) if len(x) else np.zeros(0, int)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-9), c)
    return c


def _cells(centroids: np.ndarray):
    """The nearest and second nearest centroid of each vector as one number."""

    def cell(vectors: pa.Array) -> pa.Array:
        values, size = _longs(vectors)
        dim = max(centroids.shape[1], int(size.max(initial=0)))
        near = _matrix(vectors, dim).astype(np.float64)[:, : centroids.shape[1]] @ centroids.T
        order = np.argsort(-near, axis=1, kind="stable")
        second = order[:, 1] if order.shape[1] > 1 else order[:, 0]
        return pa.array(order[:, 0] * CENTROIDS + second, pa.int32())

    return F.arrow_udf(cell, "int")


def _no_cell(vectors: pa.Array) -> pa.Array:
    return pa.array(np.zeros(len(vectors)), pa.int32())


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, in order, to ranges: one row each with blocks, maxima and forward index."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    waiting: list[pa.RecordBatch] = []
    count = made = 0

    def flush(table: pa.Table, number: int) -> pa.RecordBatch:
        x = _matrix(table["v"])
        starts = np.arange(0, len(x), BLOCK)
        parts = {
            "range": [(task << 33) + number], "n": [len(x)], "dim": [x.shape[1]],
            "ids": [_packed(_flat(table["vec_id"]))], "rows": [_packed(x)], "seats": [_packed(_flat(table["row"]))],
            "high": [_packed(np.maximum.reduceat(x, starts))], "low": [_packed(np.minimum.reduceat(x, starts))],
            "asks": [_packed(np.flatnonzero(_flat(table["asks"])))],
        }
        return pa.RecordBatch.from_arrays(
            [pa.array(v, pa.int64() if k == "range" else pa.int32() if k in ("n", "dim") else pa.binary())
             for k, v in parts.items()],
            names=list(parts),
        )

    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        while count >= RANGE:
            table = pa.Table.from_batches(waiting)
            yield flush(table.slice(0, RANGE), made)
            waiting, made, count = table.slice(RANGE).to_batches(), made + 1, count - RANGE
    if count:
        yield flush(pa.Table.from_batches(waiting), made)


class _Best:
    """The k best (score, vec_id, row) of each query, by score, then smaller vec_id, then row."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.score = np.full((n, k), _NONE, dtype=np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.row = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        some = np.flatnonzero((scores >= self.least[who][:, None]).any(axis=1))
        if not len(some):
            return
        who, scores = who[some], scores[some]
        shape = scores.shape
        s = np.concatenate([self.score[who], scores], axis=1)
        i = np.concatenate([self.id[who], np.broadcast_to(ids, shape)], axis=1)
        r = np.concatenate([self.row[who], np.broadcast_to(rows, shape)], axis=1)
        order = np.lexsort((r, i, -s), axis=1)[:, : self.k]
        self.score[who], self.id[who], self.row[who] = (np.take_along_axis(x, order, axis=1) for x in (s, i, r))
        self.least[who] = np.maximum(self.least[who], self.score[who][:, -1])

    def join(self, who: np.ndarray, found: _Best) -> None:
        """Takes in what the queries `who` found elsewhere."""
        s, i, r = (
            np.concatenate([getattr(self, c)[who], getattr(found, c)], axis=1) for c in ("score", "id", "row")
        )
        order = np.lexsort((r, i, -s), axis=1)[:, : self.k]
        self.score[who], self.id[who], self.row[who] = (np.take_along_axis(x, order, axis=1) for x in (s, i, r))
        self.least[who] = np.maximum(self.least[who], self.score[who][:, -1])


def search_range(
    queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int, index: dict[str, np.ndarray]
) -> tuple[_Best, int]:
    """The k best of a range for each query that score `least` or more, and how many blocks were scored.

    In round r each query takes its r-th best block; those that take the same one are scored together.
    """
    best = _Best(len(queries), k, least)
    bounds = _bounds(queries, index["high"], index["low"])
    order = np.argsort(-bounds, axis=1, kind="stable")
    alive = np.arange(len(queries))
    scored = 0
    for step in range(bounds.shape[1]):
        block = order[alive, step]
        # a query is done when its next bound, and so all later ones, are under its k-th score
        on = bounds[alive, block] >= best.least[alive]
        alive, block = alive[on], block[on]
        if not len(alive):
            break
        for b in np.unique(block):
            who = alive[block == b]
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            ids = index["ids"][part]
            scores = _product(queries[who], index["rows"][part])
            scores[query_ids[who][:, None] == ids[None, :]] = _NONE
            best.add(who, scores, ids, index["seats"][part])
            scored += len(who)
    return best, scored


def _index(row: dict, dim: int) -> dict[str, np.ndarray]:
    own = row["dim"]
    return {"ids": _array(row["ids"]), "seats": _array(row["seats"])} | {
        c: _wide(_array(row[c], own), dim) for c in ("rows", "high", "low")
    }


def _rows_found(best: _Best, rows: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    # what is under the k-th score found so far is not among the k best
    q, place = np.nonzero((best.score > _NONE) & (best.score >= best.least[:, None]))
    columns = [rows[q], ids[q], best.id[q, place], best.row[q, place], best.score[q, place]]
    names = [c.split()[0] for c in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _seeded(k: int):
    """Each range's own queries: their candidates in the range, and the queries themselves with the k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _index(row, row["dim"])
                asks = _array(row["asks"])
                if not len(asks):
                    continue
                queries, ids, rows = own["rows"][asks], own["ids"][asks], own["seats"][asks]
                best, _ = search_range(queries, ids, np.full(len(asks), _NONE), k, own)
                found = _rows_found(best, rows, ids)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "range": row["range"], "dim": row["dim"], "q_rows": _packed(rows), "q_ids": _packed(ids),
                            "q_vectors": _packed(queries), "q_least": _packed(best.least),
                            "found": found.to_pylist(),
                        }
                    ],
                    schema=_SEEDED_ARROW,
                )

    return run


_FOUND_ARROW = pa.list_(pa.struct([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")]))
_SEEDED_ARROW = pa.schema(
    [("range", pa.int64()), ("dim", pa.int32())]
    + [(c, pa.binary()) for c in ("q_rows", "q_ids", "q_vectors", "q_least")]
    + [("found", _FOUND_ARROW)]
)
_SEEDED = (
    "range long, dim int, q_rows binary, q_ids binary, q_vectors binary, q_least binary, "
    "found array<struct<query_row: bigint, query_id: bigint, vec_id: bigint, row: bigint, score: bigint>>"
)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of a range beside a page of other ranges' maxima: for each shelf the queries that some of its ranges
    may serve, and which ranges those are (in their order on the shelf)."""
    names = [c.split()[0] for c in _ASKED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    for batch in batches:
        for row in batch.to_pylist():
            dim = max(row["dim"], row["page_dim"])
            queries = _wide(_array(row["q_vectors"], row["dim"]), dim)
            least, rows, ids = _array(row["q_least"]), _array(row["q_rows"]), _array(row["q_ids"])
            ranges, shelves = (np.array(row[c], dtype=np.int64) for c in ("ranges", "shelves"))
            high = _wide(_array(row["page_high"], row["page_dim"]), dim)
            low = _wide(_array(row["page_low"], row["page_dim"]), dim)
            may = (_bounds(queries, high, low) >= least[:, None]) & (ranges != row["range"])[None, :]
            out = []
            for shelf in np.unique(shelves[may.any(axis=0)]):
                here = may[:, shelves == shelf]
                on = here.any(axis=1)
                out.append((int(shelf), row["range"], dim, *[_packed(x[on]) for x in (rows, ids, queries, least)],
                            np.packbits(here[on], axis=1).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names
                )


def _paged(key: tuple, pages: pa.Table) -> pa.Table:
    """The maxima of a page's ranges as one row."""
    rows = pages.sort_by("range").to_pylist()
    dim = max(r["dim"] for r in rows)
    high = np.stack([_wide(_array(r["high"], r["dim"]), dim).max(axis=0) for r in rows])
    low = np.stack([_wide(_array(r["low"], r["dim"]), dim).min(axis=0) for r in rows])
    return pa.table(
        {
            "page": pa.array([key[0].as_py()], pa.int64()),
            "ranges": pa.array([[r["range"] for r in rows]], pa.list_(pa.int64())),
            "shelves": pa.array([[r["shelf"] for r in rows]], pa.list_(pa.int64())),
            "page_dim": pa.array([dim], pa.int32()),
            "page_high": pa.array([_packed(high)], pa.binary()),
            "page_low": pa.array([_packed(low)], pa.binary()),
        }
    )


def _scored(k: int):
    """A cell's ranges, in their order, and the queries behind them: the k best of its ranges for each query."""

    def score(held: list[dict], asked: list[dict]) -> pa.RecordBatch:
        dim = max(r["dim"] for r in held + asked)
        queries = np.concatenate([_wide(_array(r["q_vectors"], r["dim"]), dim) for r in asked])
        rows, ids, least = (np.concatenate([_array(r[c]) for r in asked]) for c in ("q_rows", "q_ids", "q_least"))
        bits = np.frombuffer(b"".join(r["may"] for r in asked), dtype=np.uint8).reshape(len(rows), -1)
        may = np.unpackbits(bits, axis=1, count=len(held)).astype(bool)
        best = _Best(len(rows), k, least)
        for place, row in enumerate(held):
            who = np.flatnonzero(may[:, place])
            if len(who):
                found, _ = search_range(queries[who], ids[who], best.least[who], k, _index(row, dim))
                best.join(who, found)
        return _rows_found(best, rows, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, asked, count = None, [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != cell or count >= TOGETHER:
                    if asked:
                        yield score(held, asked)
                    asked, count = [], 0
                if row["cell"] != cell:
                    cell, held = row["cell"], []
                if row["range"] is not None:
                    held.append(row)
                else:
                    asked.append(row)
                    count += len(_array(row["q_rows"]))
        if asked:
            yield score(held, asked)

    return run


def _slices(seeds: DataFrame, shelves: int, held: int) -> int:
    """Into how many slices the queries are cut: a shelf meets each slice in a cell of its own.

    The `held` bytes of all shelves are sent once for each slice, a query once for each shelf; slices are as many as
    keep the first no more than the second, or as give every core some cells.
    """
    asks = seeds.agg(F.sum(F.octet_length("q_vectors"))).first()[0] or 0
    cells = 4 * seeds.sparkSession.sparkContext.defaultParallelism
    return max(1, shelves * asks // max(1, held), -(-cells // shelves))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, rows_at_once: int = 8) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` rows of highest score for each row that `is_query`.

    The score is the inner product of floor(64 x), x as double; equal scores go to the smaller vec_id.  A
    query meets all rows but those with its own vec_id; with fewer than `k` of them it gets all.  Vectors
    that are null or hold null or non-finite components, and rows without a vec_id, take no part.  A vector
    of fewer components counts as if it ended in zeros; components saturate at +-2^25.  Rows that repeat
    a vec_id are rows each: each may be found (equal scores then by an inner row number), and each that is
    a query asks for itself.  An empty table gives no rows.  Other columns play no part.

    Ranges are large rows, of which Python gets `rows_at_once` at a time.
    """
    spark = vectors.sparkSession
    usable = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"),
    )
    usable = stored(usable.filter("vec_id IS NOT NULL AND v IS NOT NULL"), "integer-vectors")
    sample = usable.select("v", F.xxhash64("vec_id").alias("h"), "row").orderBy("h", "row").limit(SAMPLE)
    fitted = sample.select("v").toArrow()["v"]
    cell = _cells(_centroids(_matrix(fitted))) if len(fitted) else F.arrow_udf(_no_cell, "int")
    # the hash keeps copies of a vector together, the id deals a large group of them out
    dealt = usable.withColumn("cell", cell("v")).withColumn("same", F.xxhash64("v"))
    keys = ["cell", "same", "vec_id", "row"]
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys)
    index = stored(dealt.select("vec_id", "v", "asks", "row").mapInArrow(_ranged, _RANGES), "ranges")

    n_ranges, size = index.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("rows")), F.lit(0))).first()
    n_pages, n_shelves = max(1, -(-n_ranges // PAGE)), max(1, -(-n_ranges // SHELF), -(-size // SHELF_BYTES))
    index = index.withColumn("shelf", F.pmod(F.xxhash64("range"), F.lit(n_shelves)))
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_at_once))
    try:
        seeds = stored(index.filter(F.octet_length("asks") > 1).mapInArrow(_seeded(k), _SEEDED), "seeds")
        # a shelf lies on one page
        maxima = index.select("range", "shelf", "dim", "high", "low")
        pages = maxima.groupBy(F.pmod("shelf", F.lit(n_pages)).alias("page")).applyInArrow(
            _paged, "page long, ranges array<long>, shelves array<long>, page_dim int, page_high binary, page_low binary"
        )
        pages = stored(pages, "pages")
        sent = pages.agg(F.sum(F.octet_length("page_high") + F.octet_length("page_low"))).first()[0] or 0
        # every row of queries meets every page; an equi-join, as pages are numbered. Files say little of the size of
        # their rows (equal ones are written once), so what is sent is decided by the bytes counted here
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long")))
        near = F.broadcast(pages) if sent <= SENT_BYTES else pages.hint("merge")
        beside = seeds.drop("found").withColumn("page", each).join(near, "page")
        n_slices = _slices(seeds, n_shelves, size)
        slices = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slices - 1).cast("long")))
        held = index.drop("asks").withColumn("slice", slices)
        asked = beside.mapInArrow(_chosen, _ASKED).withColumn("slice", F.pmod(F.xxhash64("own"), F.lit(n_slices)))
        met = held.unionByName(asked.drop("own"), allowMissingColumns=True)
        met = met.withColumn("cell", F.col("shelf") * n_slices + F.col("slice")).drop("shelf", "slice")
        cells = n_shelves * n_slices
        met = met.repartitionById(min(cells, PARTITIONS), F.pmod("cell", F.lit(min(cells, PARTITIONS))).cast("int"))
        # of a cell, its ranges come first
        met = met.sortWithinPartitions("cell", F.col("range").isNull(), "range")
        others = stored(met.mapInArrow(_scored(k), _FOUND), "found")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    found = seeds.select(F.explode("found").alias("f")).select("f.*").unionByName(others)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_k_query(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 20 == 0)


ORACLE = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM usable
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
