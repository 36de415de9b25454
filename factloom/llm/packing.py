"""Packing by lexical retrieval: each window is filled with unused neighbours of its seed document.

One scan encodes every text, cuts it into full windows and a rest, and keeps of each document only
lengths, checksums and a bag of hashed words (the tokenizer's chunks).  Documents are then sharded so that those with the same
leading words meet; a shard of a few thousand has a BM25 inverted index, from which each seed (the
longest unused rest) draws its best unused neighbours that fit.  What gap remains is closed by the unused
rests whose lengths fit best, the last of which may take the place of a neighbour.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.encode import encoder
from factloom.llm.store import stored
from factloom.llm.words import pieces

WINDOW = 4096
END = 2
SHARD_DOCS = 2048
TERMS = 1 << 16
K1, B = 1.2, 0.75

_ENCODED = pa.schema(
    [
        ("doc_id", pa.int64()), ("tokens", pa.int64()), ("crc", pa.list_(pa.int64())),
        ("term", pa.binary()), ("count", pa.binary()), ("lead", pa.int64()), ("near", pa.int64()),
    ]
)
_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for piece in pieces(batch.column(1)):
                ids, bounds, w = encode(piece)
                cut = np.searchsorted(w.row, np.arange(piece.rows + 1))
                # the distinct terms of all rows at once, in the order of rows and terms
                held = np.sort(w.row.astype(np.uint64) << np.uint64(16) | w.hash >> np.uint64(48))
                begin = np.flatnonzero(np.diff(held, prepend=held[:1] + np.uint64(1)))
                terms, times = held[begin], np.diff(begin, append=len(held))
                own_terms = np.searchsorted(terms, np.arange(piece.rows + 1, dtype=np.uint64) << np.uint64(16))
                terms, short = terms.astype(np.uint16), np.minimum(times, 255).astype(np.uint8)
                out: dict[str, list] = {name: [] for name in _ENCODED.names[1:]}
                for r in range(piece.rows):
                    own = np.append(ids[bounds[r] : bounds[r + 1]], np.uint32(END)).astype("<u4", copy=False)
                    out["tokens"].append(len(own))
                    out["crc"].append([zlib.crc32(own[i : i + WINDOW]) for i in range(0, len(own), WINDOW)])
                    h, a, b = w.hash[cut[r] : cut[r + 1]], own_terms[r], own_terms[r + 1]
                    out["term"].append(terms[a:b].tobytes())
                    out["count"].append(short[a:b].tobytes())
                    out["lead"].append(int(terms[a + times[a:b].argmax()]) if b > a else -1)
                    out["near"].append(int(h.min() >> np.uint64(1)) if len(h) else -1)
                key = keys.slice(piece.first, piece.rows).cast(pa.int64())
                yield pa.record_batch(
                    [key, *(pa.array(out[name], _ENCODED.field(name).type) for name in _ENCODED.names[1:])],
                    schema=_ENCODED,
                )

    return run


_SLICES = 64


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the task's documents each term stands, in slices."""
    n = np.zeros(TERMS, dtype=np.int64)
    for batch in batches:
        joined = b"".join(t.as_py() for t in batch.column(0))
        n += np.bincount(np.frombuffer(joined, dtype=np.uint16), minlength=TERMS)
    yield pa.record_batch(
        [pa.array(range(_SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(n, _SLICES)], pa.binary())],
        names=["slice", "n"],
    )


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("n"))
    return pa.table({"slice": table.column("slice").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})


class Index:
    """A shard's inverted index with BM25 weights."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray, idf: np.ndarray, mean: float):
        self.terms, self.n = terms, len(terms)
        doc = np.repeat(np.arange(self.n), [len(t) for t in terms])
        term = np.concatenate(terms).astype(np.int64) if terms else np.zeros(0, np.int64)
        tf = np.concatenate(counts).astype(np.float64) if counts else np.zeros(0)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=TERMS))])

    def scores(self, seed: int) -> np.ndarray:
        t = self.terms[seed].astype(np.int64)
        low, size = self.begin[t], self.begin[t + 1] - self.begin[t]
        total = np.cumsum(size) - size
        at = np.repeat(low - total, size) + np.arange(int(size.sum()))
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def fill(length: np.ndarray, index: Index, window: int = WINDOW) -> list[list[int]]:
    """Sequences of rests (numbers into `length`), each at most `window` long."""
    free = np.ones(len(length), bool)
    by_length = sorted((int(n), i) for i, n in enumerate(length))
    sequences = []
    while by_length:
        size, seed = by_length.pop()
        free[seed] = False
        own, room = [seed], window - size
        if by_length and room >= by_length[0][0]:
            score = index.scores(seed)
            fits = np.flatnonzero(free & (length <= room) & (score > 0))
            for i in fits[np.lexsort((fits, -score[fits]))]:
                if length[i] <= room:
                    own.append(int(i))
                    free[i] = False
                    room -= int(length[i])
                    by_length.pop(bisect_right(by_length, (int(length[i]), int(i))) - 1)
                    if not by_length or by_length[0][0] > room:
                        break
            while by_length and by_length[0][0] <= room:
                n, i = by_length.pop(bisect_right(by_length, (room, len(length))) - 1)
                own.append(i)
                free[i] = False
                room -= n
            if room and len(own) > 1 and by_length:
                # the last one gives way to an unused rest that closes the gap better
                last = own[-1]
                at = bisect_right(by_length, (room + int(length[last]), len(length))) - 1
                if at >= 0 and by_length[at][0] > length[last]:
                    n, i = by_length.pop(at)
                    own[-1] = i
                    free[i], free[last] = False, True
                    insort(by_length, (int(length[last]), last))
        sequences.append(own)
    return sequences


def _pack(idf: np.ndarray, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = list(batches)
        if not sum(b.num_rows for b in shard):
            return
        table = pa.Table.from_batches(shard).sort_by(
            [("lead", "ascending"), ("near", "ascending"), ("doc_id", "ascending"), ("tokens", "ascending")]
        )
        doc_id, tokens = table.column("doc_id").to_pylist(), table.column("tokens").to_pylist()
        crc = table.column("crc").to_pylist()
        terms = [np.frombuffer(x.as_py(), dtype=np.uint16) for x in table.column("term")]
        counts = [np.frombuffer(x.as_py(), dtype=np.uint8) for x in table.column("count")]
        rows = []
        sequence = TaskContext.get().partitionId() << 32
        rest, of = [], []
        for i, n in enumerate(tokens):
            for start in range(0, n - n % WINDOW, WINDOW):
                rows.append((doc_id[i], start, WINDOW, crc[i][start // WINDOW], n, sequence, 0))
                sequence += 1
            if n % WINDOW:
                rest.append(n % WINDOW)
                of.append(i)
        sizes = np.array([tokens[i] for i in of], dtype=np.float64)
        index = Index([terms[i] for i in of], [counts[i] for i in of], sizes, idf, mean)
        for own in fill(np.array(rest, dtype=np.int64), index):
            offset = 0
            for j in own:
                i = of[j]
                rows.append((doc_id[i], tokens[i] - rest[j], rest[j], crc[i][-1], tokens[i], sequence, offset))
                offset += rest[j]
            sequence += 1
        columns = list(zip(*rows, strict=True))
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_PIECES)

    return run


def pack(docs: DataFrame, tokenizer: str, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens: `doc_id`, `start`, `length`,
    `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`.

    A document's tokens are its ids by the tokenizer file, without special tokens, and the id 2; a null or
    empty text is just that one token.  A document longer than a window is cut into full windows and a
    rest.  Every row is a document, also rows that repeat an id or have none.  Document frequencies and
    the mean length are those of all documents; equal scores go to the document that sorts first.  No
    rows give no sequences.  A shard is a range of (leading word, smallest word hash, doc_id) with about
    `shard_docs` documents, however many share those words.
    """
    kind = (
        "doc_id bigint, tokens bigint, crc array<bigint>, term binary, count binary, lead bigint, near bigint"
    )
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(tokenizer), kind)
    encoded = stored(encoded, "encoded")
    n, mean = encoded.agg(F.count("*"), F.avg("tokens")).first()
    parts = encoded.select("term").mapInArrow(_frequencies, "slice int, n binary")
    parts = parts.groupBy("slice").applyInArrow(_summed, "slice int, n binary").collect()
    df = np.zeros(TERMS)
    for r in parts:
        size = TERMS // _SLICES
        df[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["n"], dtype=np.int64)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shards = max(1, round(n / shard_docs))
    ordered = encoded.repartitionByRange(shards, "lead", "near", "doc_id")
    return ordered.mapInArrow(_pack(idf, float(mean or 1)), PIECES)
