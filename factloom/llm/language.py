"""Language ID by nearest centroid.

A text is a TF-IDF vector of hashed letter bigrams and trigrams, scaled to length one.  Each language has
a few centroids from spherical k-means, and a text gets the language of the centroid with the highest
cosine.  A text is marked as rejected if it is much farther from it than that language's own texts of the
same length are; medians tell how far that is, so that junk among the training rows does not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import bounded_sample, picked, stored
from factloom.llm.words import Piece, pieces

BUCKETS = 1 << 12
PER_LANGUAGE = 600
CENTROIDS = 4
UNKNOWN = "und"
# A text is rejected below this share of the median cosine of its language's own texts cut to as many letters.
TYPICAL = 1 / 3
# The numbers of letters to which texts are cut, and how many texts of each language at most and at least.
BANDS = 8 << np.arange(10)
CUT_TEXTS = 100
LEAST_TEXTS = 10
_ROWS = 512


def _tables() -> tuple[np.ndarray, np.ndarray]:
    letter = np.zeros(0x10000, dtype=bool)
    small = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            letter[c] = True
            low = ch.lower()
            if len(low) == 1 and ord(low) < 0x10000:
                small[c] = ord(low)
    return letter, small


_TABLES: list = []


def _letters(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points with runs of other characters as one space; their rows; letters per row."""
    if not _TABLES:
        _TABLES.extend(_tables())
    letter, small = _TABLES
    lead = (piece.data & 0xC0) != 0x80
    bounds = np.concatenate([[0], np.cumsum(lead)])[piece.offsets]
    code = np.frombuffer(piece.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    wide = code >= 0x10000
    near = np.where(wide, 0, code)
    is_letter = letter[near] | wide & (code >= 0x20000)
    row = np.repeat(np.arange(piece.rows), np.diff(bounds))
    code = np.where(is_letter, np.where(wide, code & 0xFFFF, small[near]), 0x20).astype(np.uint32)
    keep = is_letter.copy()
    if len(keep):
        keep[1:] |= ~is_letter[1:] & is_letter[:-1]
        keep[0] = True
    counts = np.bincount(row[is_letter], minlength=piece.rows)
    return code[keep], row[keep], counts


def gram_counts(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed bigrams and trigrams, one line per row; letters per row."""
    code, row, letters = _letters(piece)
    cells = []
    a = code * np.uint32(0x9E3779B1)
    for n in (2, 3):
        if len(code) < n:
            continue
        h = a[: len(code) - n + 1] + code[1 : len(code) - n + 2] * np.uint32(0x85EBCA77)
        if n == 3:
            h = h + code[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        same = row[: len(code) - n + 1] == row[n - 1 :]
        cells.append(row[: len(code) - n + 1][same] * BUCKETS + (h[same] % BUCKETS))
    if not cells:
        return np.zeros((piece.rows, BUCKETS), np.float32), letters
    flat = np.bincount(np.concatenate(cells), minlength=piece.rows * BUCKETS)
    return flat.reshape(piece.rows, BUCKETS).astype(np.float32), letters


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


@dataclass
class Model:
    """Centroids (one line each, length one), their languages, the least cosine each accepts at each of BANDS, and the IDF."""

    languages: list[str]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def limits(self, best: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The least cosine that centroids accept of texts of so many letters."""
        at = np.log2(np.maximum(letters, 1) / BANDS[0])
        low = np.clip(np.floor(at), 0, len(BANDS) - 2).astype(int)
        part = np.clip(at - low, 0, 1)
        limit = self.least[best, low] * (1 - part) + self.least[best, low + 1] * part
        return limit * np.minimum(1.0, letters / BANDS[0]) ** 0.5


def _limits(texts: list[str], centroids: np.ndarray, idf: np.ndarray) -> list[float]:
    """Least cosines at BANDS; where too few texts are long enough, that of the band before."""
    places = [[i for i, ch in enumerate(t) if ch.isalpha()] for t in texts]
    out: list[float] = []
    for n in BANDS.tolist():
        cut = [t[: p[n - 1] + 1] for t, p in zip(texts, places, strict=True) if len(p) >= n]
        if len(cut) < min(LEAST_TEXTS, len(texts)):
            if out:
                out.append(out[-1])
                continue
            cut = texts
        counts = [gram_counts(piece)[0] for piece in pieces(pa.array(cut), max_rows=_ROWS)]
        reach = np.concatenate([(unit(c, idf) @ centroids.T).max(axis=1) for c in counts])
        out.append(TYPICAL * float(np.median(reach)))
    return out


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from far-apart starts; deterministic."""
    k = min(k, len(x))
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[start[0]]
    while len(start) < k:
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = sums / np.where(norm == 0, 1, norm)
    return c


def _sparse(text: pa.Array) -> pa.Array:
    rows = []
    for piece in pieces(text, max_rows=_ROWS):
        counts, letters = gram_counts(piece)
        for r in range(piece.rows):
            at = np.flatnonzero(counts[r])
            rows.append({"cell": at.astype(np.int32), "count": counts[r][at], "letters": int(letters[r])})
    kind = pa.struct([("cell", pa.list_(pa.int32())), ("count", pa.list_(pa.float32())), ("letters", pa.int64())])
    return pa.array(rows, kind)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model | None:
    """Learns from `text` and non-null `lang`: at most `per_language` rows of each language, by hash order.

    Rows without letters teach nothing.  Returns None if nothing can be learned.
    """
    known = docs.select("doc_id", "lang").filter("lang is not null and doc_id is not null")
    chosen = bounded_sample(known, "lang", per_language)
    chosen = stored(chosen.select("doc_id").distinct(), "training-ids")
    texts = picked(docs.select("doc_id", "lang", "text"), chosen, "doc_id", "left_semi")
    sparse = F.arrow_udf(_sparse, "struct<cell: array<int>, count: array<float>, letters: bigint>")
    rows = (
        texts.filter("lang is not null")
        .select("doc_id", "lang", sparse("text").alias("v"), F.substring("text", 1, 2 * int(BANDS[-1])).alias("head"))
        .filter("v.letters > 0").collect()
    )
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["v"]["letters"]))
    if not rows:
        return None
    counts = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, r in enumerate(rows):
        counts[i, r["v"]["cell"]] = r["v"]["count"]
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = unit(counts, idf)
    names = np.array([r["lang"] for r in rows])
    languages, found, least = [], [], []
    for name in sorted(set(names)):
        own = x[names == name]
        c = _centroids(own, centroids)
        heads = [r["head"] for r in rows if r["lang"] == name]
        languages += [str(name)] * len(c)
        found.append(c)
        least += [_limits(heads[:: -(-len(heads) // CUT_TEXTS)], c, idf)] * len(c)
    return Model(languages, np.concatenate(found).astype(np.float32), np.array(least, np.float32), idf)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` (cosine, 0 to 1) and `rejected`.

    A text that is null or has no letters is `und` with score 0 and rejected; with no model every text
    is.  Whole texts count.  Equal cosines go to the language that comes first.  Columns of those three
    names are replaced; all others are kept, and repeated rows get equal results.
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    names = np.array(model.languages, dtype=object) if model else None

    @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def predicted(column: pa.Array) -> pa.Array:
        rows = []
        for piece in pieces(column, max_rows=_ROWS):
            if model is None:
                rows += [{"lang": UNKNOWN, "score": 0.0, "rejected": True}] * piece.rows
                continue
            counts, letters = gram_counts(piece)
            near = unit(counts, model.idf) @ model.centroids.T
            best = np.argmax(near, axis=1)
            score = np.clip(near[np.arange(len(best)), best], 0, 1)
            limit = model.limits(best, letters)
            for b, s, n, least in zip(best, score, letters, limit, strict=True):
                if n:
                    rows.append({"lang": names[b], "score": float(s), "rejected": bool(s < least)})
                else:
                    rows.append({"lang": UNKNOWN, "score": 0.0, "rejected": True})
        return pa.array(rows, kind)

    given = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    out = docs.select(*given, predicted(F.col(f"`{text}`")).alias("__p"))
    return out.select(
        *given,
        F.col("__p.lang").alias("lang_pred"),
        F.col("__p.score").alias("score"),
        F.col("__p.rejected").alias("rejected"),
    )


def language_query(docs: DataFrame) -> DataFrame:
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
