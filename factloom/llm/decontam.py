"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of the passages they hit.

Documents are scanned once for the word trigrams of the test items.  Every passage of a document that holds
two of an item's trigrams on near diagonals is aligned with the item word by word, so that inserted, missing
and replaced words cost a little instead of hiding the copy.  How many documents hold a trigram plays no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import stored
from factloom.llm.words import WORD_BYTES, Words, pieces, shingles, words

GRAM = 3
LEAST_SCORE = 0.5
# About this many trigrams of test items (some 30 bytes each) are sent to the scanning tasks at once; of a
# larger benchmark, shares of the items are sent one after the other, each with a scan of its own.
SENT_GRAMS = 2_000_000
# Hits are matched with items in slices of about this many pairs.
_SLICE = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_FOUND = pa.schema(
    [("doc", pa.int64()), ("item", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]
)
_KIND = "doc bigint, item bigint, score double, start bigint, end bigint"


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """Ids and texts; case is levelled, and words are runs of letters and digits."""
    return df.select(F.col(key).cast("long").alias("k"), F.lower("text").alias("text")).filter("k is not null and text is not null")


def _word_array(text: pa.Array) -> pa.Array:
    found = []
    for piece in pieces(text):
        w = words(piece, WORD_BYTES[piece.data])
        cut = np.searchsorted(w.row, np.arange(piece.rows + 1))
        found += [w.hash[cut[r] : cut[r + 1]].view(np.int64) for r in range(piece.rows)]
    return pa.array(found, pa.list_(pa.int64()))


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and where it begins and ends in the passage."""
    m = len(passage)
    step = np.arange(1, m + 1) * -GAP
    above, start_above = np.zeros(m + 1, int), np.arange(m + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(passage == word, MATCH, MISMATCH)
        down = above[1:] + GAP
        cell = np.maximum(diagonal, down)
        origin = np.where(diagonal >= down, start_above[:-1], start_above[1:])
        fresh = cell <= 0
        cell, origin = np.where(fresh, 0, cell), np.where(fresh, np.arange(1, m + 1), origin)
        # a gap within the row: the best earlier cell less its distance
        lead = np.maximum.accumulate(cell + step)
        source = np.maximum.accumulate(np.where(cell + step == lead, np.arange(m), 0))
        value = lead - step
        origin = np.where(value > cell, origin[source], origin)
        cell = np.maximum(cell, value)
        above = np.concatenate([[0], cell])
        start_above = np.concatenate([[0], origin])
        top = int(cell.argmax())
        if cell[top] > best[0]:
            best = (int(cell[top]), int(origin[top]), top + 1)
    return best


class _Bank:
    """Test items' words, and where in which item each of their trigrams stands."""

    def __init__(self, ids: list[int], spelled: list[np.ndarray]):
        self.ids, self.words = np.array(ids, dtype=np.int64), spelled
        self.size = np.array([len(x) for x in spelled], dtype=np.int64)
        hashes = np.concatenate(spelled).view(np.uint64)
        w = Words(np.repeat(np.arange(len(spelled)), self.size), np.zeros(0, np.int64), np.zeros(0, np.int64), hashes)
        gram, item, at = shingles(w, GRAM, len(spelled))
        order = np.argsort(gram.view(np.int64), kind="stable")
        gram, self.item = gram.view(np.int64)[order], item[order].astype(np.int64)
        self.own = (at - np.concatenate([[0], np.cumsum(self.size)])[item])[order].astype(np.int64)
        self.gram, first = np.unique(gram, return_index=True)
        self.first = np.concatenate([first, [len(gram)]])


def _bands(bank: _Bank, gram: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, band) in which two trigrams of an item stand: diagonals in one of two overlapping rows of bands."""
    place = np.searchsorted(bank.gram, gram)
    place[place == len(bank.gram)] = 0
    hit = np.flatnonzero(bank.gram[place] == gram)
    place, gram, row, at = place[hit], gram[hit], row[hit], at[hit]
    count = bank.first[place + 1] - bank.first[place]
    total = np.concatenate([[0], np.cumsum(count)])
    done = [np.zeros(0, np.int64)] * 4
    a = 0
    while a < len(hit):
        b = max(a + 1, int(np.searchsorted(total, total[a] + _SLICE, side="right")) - 1)
        which = np.repeat(np.arange(a, b), count[a:b])
        entry = np.arange(total[a], total[b]) - total[which] + bank.first[place[which]]
        item = bank.item[entry]
        half = np.floor((at[which] - bank.own[entry]) / bank.size[item] * 2).astype(np.int64)
        pair, g = row[which] * len(bank.ids) + item, gram[which]
        new = [np.concatenate([x, y]) for x, y in ((pair, pair), (half, half - 1), (g, g), (g, g))]
        pair, band, low, high = (np.concatenate([x, y]) for x, y in zip(done, new, strict=True))
        order = np.lexsort((band, pair))
        pair, band, low, high = pair[order], band[order], low[order], high[order]
        fresh = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])]))
        done = [pair[fresh], band[fresh], np.minimum.reduceat(low, fresh), np.maximum.reduceat(high, fresh)]
        a = b
    pair, band, low, high = done
    row, item = pair // len(bank.ids), pair % len(bank.ids)
    keep = (low < high) | (bank.size[item] <= GRAM + 1)
    return row[keep], item[keep], band[keep]


def _search(bank: _Bank, least: float):
    """Scans (row key, text) batches and gives out every passage that aligns with an item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column(1)):
                w = words(piece, WORD_BYTES[piece.data])
                begin = np.concatenate([[0], np.cumsum(np.bincount(w.row, minlength=piece.rows))])
                gram, row, at = shingles(w, GRAM, piece.rows)
                row = row.astype(np.int64)
                hash = w.hash.view(np.int64)
                found = []
                for r, i, band in zip(*_bands(bank, gram.view(np.int64), row, at - begin[row]), strict=True):
                    size, own = int(bank.size[i]), bank.words[i]
                    slack = size / 4 + 8
                    low = max(0, int(np.floor(band * size / 2 - slack)))
                    high = int(np.ceil((band + 2) * size / 2 + size + slack))
                    part = hash[begin[r] + low : min(begin[r] + high, begin[r + 1])]
                    # no alignment scores more than all words of the item that the passage has
                    if np.isin(own, part).sum() < least * size:
                        continue
                    score, start, end = align(part, own)
                    if score / (MATCH * size) >= least:
                        found.append((int(keys[piece.first + r]), int(bank.ids[i]), score / (MATCH * size), low + start, low + end))
                if found:
                    yield pa.record_batch([np.array(x) for x in zip(*found, strict=True)], schema=_FOUND)

    return scan


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """One row per document and test item that it holds a copy of: `doc_id`, `item_id`, `score` (alignment
    score as a share of the item's full score, at least `least`), and the passage's words `start` and
    `end` (exclusive) in the document.

    Null ids and null or empty texts, on either side, match nothing, and neither does an item of fewer
    than three words.  Rows that repeat an id are searched each for itself and answer with their best
    passage; of equal ones with the first.  Other columns are not looked at.
    """
    items = _keyed(benchmark, "item_id").dropDuplicates()
    to_words = F.arrow_udf(_word_array, "array<bigint>")
    spelled = items.select(F.col("k").alias("item"), to_words("text").alias("item_words"))
    spelled = stored(spelled.filter(F.size("item_words") >= GRAM), "items")
    texts = _keyed(docs, "doc_id")
    count, grams = spelled.agg(F.count("*"), F.sum(F.size("item_words") - GRAM + 1)).first()
    shares = min(count, -(-(grams or 0) // max(1, SENT_GRAMS)))
    parts = []
    for k in range(shares):
        own = spelled.filter(F.pmod(F.xxhash64("item", "item_words"), F.lit(shares)) == k).collect()
        if own:
            bank = _Bank([r["item"] for r in own], [np.array(r["item_words"], dtype=np.int64) for r in own])
            parts.append(stored(texts.mapInArrow(_search(bank, least), _KIND), "found"))
    found = reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], _KIND)
    best = F.max(F.struct("score", (-F.col("start")).alias("s"), "end"))
    out = found.groupBy("doc", "item").agg(best.alias("b"))
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("b.score").alias("score"),
        (-F.col("b.s")).alias("start"),
        F.col("b.end").alias("end"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """`docs` without the documents that hold a copy of a test item; rows without an id stay."""
    gone = stored(contaminated(docs, benchmark, least).select("doc_id").distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
