"""Toxicity: a learned lexicon, misspellings of its terms, and the context in which they stand.

The lexicon holds words that labelled toxic documents use far more often than others.  A Levenshtein
automaton is intersected with the lexicon's trie, determinised as it is used, and finds terms within one
edit (two in long terms), also if digits or marks stand between a word's letters.  Windows around the hits tell how dense they are and whether they stand in
quotation marks, which speaks for quotation rather than abuse; a logistic regression weighs it all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.language import held_out
from factloom.llm.store import bounded_sample, stored
from factloom.llm.words import Words, distinct, mix, pieces, running, span_hashes, words

TRAINING_ROWS = 8_000
LEXICON_SIZE = 2_000
WINDOW = 25
FUZZY_FROM = 5
TWO_EDITS_FROM = 9
# What a misspelled term counts for, of what the term itself does.
MISSPELLED = 0.7
_EVIDENCE = 12.0
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
# Digits and marks that may stand for a letter inside a word; at most MOST_EDITS in all.
_MARK = np.zeros(256, dtype=bool)
_MARK[33:127] = True
_MARK[_LETTER] = False
_MARK[ord('"')] = False
MOST_EDITS = 2


def _quote_marks(data: np.ndarray) -> np.ndarray:
    """Where quotation marks begin: the plain double one, guillemets, curly doubles and lows."""
    mark = data == ord('"')
    if len(data) > 2:
        mark[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))
        mark[:-2] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x9C) & (data[2:] <= 0x9E)
    return mark


class Automaton:
    """Words within a few edits of a lexicon term, as a deterministic automaton built on demand.

    A state is a set of (trie node, edits used); each transition is computed once and kept, at most
    `limit` of them (the table is then started anew, which changes no answer).
    """

    def __init__(self, terms: dict[str, float], limit: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.budget: list[int] = [0]
        self.terms = terms
        for term in terms:
            node, edits = 0, self.allowed(term)
            self.budget[0] = max(self.budget[0], edits)
            for ch in term:
                if ch not in self.children[node]:
                    self.children.append({})
                    self.term.append(None)
                    self.budget.append(0)
                    self.children[node][ch] = len(self.children) - 1
                node = self.children[node][ch]
                self.budget[node] = max(self.budget[node], edits)
            self.term[node] = term
        self.limit = limit
        self._reset()

    @staticmethod
    def allowed(term: str) -> int:
        return 0 if len(term) < FUZZY_FROM else 1 if len(term) < TWO_EDITS_FROM else 2

    def _reset(self) -> None:
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.start = self._closed({0: 0})

    def _closed(self, states: dict[int, int]) -> frozenset:
        """With the states reached by leaving out letters of terms; nodes past their edits go."""
        best = dict(states)
        todo = list(states)
        while todo:
            node = todo.pop()
            used = best[node] + 1
            for child in self.children[node].values():
                if used <= self.budget[child] and used < best.get(child, 99):
                    best[child] = used
                    todo.append(child)
        return frozenset(best.items())

    def step(self, state: frozenset, ch: str) -> frozenset:
        key = (state, ch)
        known = self.steps.get(key)
        if known is None:
            after: dict[int, int] = {}
            for node, used in state:
                if used < self.budget[node]:
                    after[node] = min(used + 1, after.get(node, 99))
                for letter, child in self.children[node].items():
                    cost = used + (letter != ch)
                    if cost <= self.budget[child] and cost < after.get(child, 99):
                        after[child] = cost
            known = self._closed(after) if after else frozenset()
            if len(self.steps) >= self.limit:
                self._reset()
            self.steps[key] = known
        return known

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term (of equals the weightiest, then the first) and the edits to it, or None."""
        state = self.start
        for ch in word:
            state = self.step(state, ch)
            if not state:
                return None
        hits = [
            (used, -self.terms[t], t)
            for node, used in state
            if (t := self.term[node]) is not None and used <= self.allowed(t)
        ]
        return (min(hits)[2], min(hits)[0]) if hits else None


def _hash_all(parts: set[bytes]) -> np.ndarray:
    """Hashes of byte strings as `span_hashes` gives them."""
    data = np.frombuffer(b"".join(sorted(parts)), dtype=np.uint8)
    end = np.cumsum([len(p) for p in sorted(parts)])
    return span_hashes(running(data), end - [len(p) for p in sorted(parts)], end)


@dataclass
class Matcher:
    """Finds terms in hashed words of lower-cased texts; what a word matches is remembered by its hash."""

    terms: dict[str, float]
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    edits: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))
    middles: set[bytes] = field(default_factory=set)

    def __post_init__(self):
        self.automaton = Automaton(self.terms)
        self.longest = max((len(t.encode()) for t in self.terms), default=0) + 8
        heads: dict[int, set[bytes]] = {}
        tails: dict[int, set[bytes]] = {}
        for term in self.terms:
            parts = Automaton.allowed(term) + 1
            cuts = [len(term) * k // parts for k in range(parts + 1)]
            cut = [term[a:b].encode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            heads.setdefault(len(cut[0]), set()).add(cut[0])
            tails.setdefault(len(cut[-1]), set()).add(cut[-1])
            for part in cut[1:-1]:
                self.middles.add(part)
        self.heads, self.tails = ({n: _hash_all(s) for n, s in x.items()} for x in (heads, tails))

    def _possible(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words that can be within reach of a term: of a term cut into one part more than its edits, one
        part is untouched, the first at the word's head, the last at its tail, another inside."""
        some, total = np.zeros(len(start), bool), running(data)
        for sides, at_head in ((self.heads, True), (self.tails, False)):
            for n, known in sides.items():
                at = np.flatnonzero(~some & (end - start >= n))
                a = start[at] if at_head else end[at] - n
                some[at] = np.isin(span_hashes(total, a, a + n), known)
        if self.middles:
            inside = re.compile(b"|".join(re.escape(m) for m in sorted(self.middles)))
            for i in np.flatnonzero(~some & (end - start >= TWO_EDITS_FROM - 2)):
                word = data[start[i] : end[i]].tobytes()
                some[i] = inside.search(word) is not None
        return some

    def __call__(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Weight (0: no term) and edits of each word."""
        weight, edits = np.zeros(len(w.hash), np.float32), np.zeros(len(w.hash), np.int8)
        if not self.terms or not len(w.hash):
            return weight, edits
        at = np.flatnonzero(w.end - w.start <= self.longest)
        unique, first, back = distinct(w.hash[at])
        place = np.searchsorted(self.hashes, unique)
        place[place == len(self.hashes)] = 0
        new = np.ones(len(unique), bool) if not len(self.hashes) else self.hashes[place] != unique
        if new.any():
            fresh = at[first[new]]
            more_w, more_e = np.zeros(len(fresh), np.float32), np.zeros(len(fresh), np.int8)
            for k in np.flatnonzero(self._possible(data, w.start[fresh], w.end[fresh])):
                i = fresh[k]
                hit = self.automaton.find(data[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace"))
                if hit:
                    more_w[k], more_e[k] = self.terms[hit[0]], hit[1]
            hashes = np.concatenate([self.hashes, unique[new]])
            order = np.argsort(hashes)
            self.hashes = hashes[order]
            self.weight = np.concatenate([self.weight, more_w])[order]
            self.edits = np.concatenate([self.edits, more_e])[order]
            place = np.searchsorted(self.hashes, unique)
        weight[at] = self.weight[place][back]
        edits[at] = self.edits[place][back]
        if len(self.hashes) > 2_000_000:
            self.hashes, self.weight, self.edits = self.hashes[:0], self.weight[:0], self.edits[:0]
        return weight, edits


_MATCHERS: dict[int, Matcher] = {}


def _matcher(terms: dict[str, float]) -> Matcher:
    """The worker's matcher for a lexicon."""
    key = hash(tuple(sorted(terms.items())))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(terms)
    return _MATCHERS[key]


def _joined(data: np.ndarray, w: Words, weight: np.ndarray, edits: np.ndarray, matcher: Matcher) -> None:
    """Terms written with up to MOST_EDITS digits or marks between letters, put to the first of their pieces.

    Pieces that are terms by themselves stay so.
    """
    gap = w.start[1:] - w.end[:-1]
    close = np.flatnonzero((w.row[1:] == w.row[:-1]) & (gap >= 1) & (gap <= MOST_EDITS))
    inside = np.concatenate([[0], np.cumsum(_MARK[data])])
    close = close[inside[w.start[close + 1]] - inside[w.end[close]] == gap[close]]
    if not len(close):
        return
    joins = np.zeros(len(w.hash), bool)
    joins[close] = True
    two = close[(gap[close] == 1) & joins[np.minimum(close + 1, len(joins) - 1)]]
    two = two[gap[two + 1] == 1]
    first, last = np.concatenate([close, two]), np.concatenate([close + 1, two + 2])
    free = np.concatenate([[0], np.cumsum(weight > 0)])
    some = (free[last + 1] == free[first]) & (w.end[last] - w.start[first] <= matcher.longest)
    first, last = first[some], last[some]
    if not len(first):
        return
    start, end = w.start[first], w.end[last]
    more = Words(w.row[first], start, end, span_hashes(running(data), start, end))
    found, how_far = matcher(data, more)
    taken = np.zeros(len(w.hash), bool)
    hits = np.flatnonzero(found > 0)
    for k in hits[np.lexsort((first[hits], how_far[hits]))]:
        if not taken[first[k] : last[k] + 1].any():
            taken[first[k] : last[k] + 1] = True
            weight[first[k]], edits[first[k]] = found[k], how_far[k]


FEATURES = ("hits", "misspelled", "quoted", "weight", "dense", "share")


def features(column: pa.Array, matcher: Matcher) -> np.ndarray:
    """One line of FEATURES per text."""
    out = np.zeros((len(column), len(FEATURES)), dtype=np.float64)
    for piece in pieces(column):
        w = words(piece, _LETTER[piece.data])
        weight, edits = matcher(piece.data, w)
        _joined(piece.data, w, weight, edits, matcher)
        at = np.flatnonzero(weight > 0)
        if not len(at):
            continue
        counts = np.bincount(w.row, minlength=piece.rows)
        marks = np.concatenate([[0], np.cumsum(_quote_marks(piece.data))])
        row = w.row[at]
        # quoted: an odd number of quotation marks since the text's beginning, and one more behind
        since = marks[w.start[at]] - marks[piece.offsets[row]]
        behind = marks[piece.offsets[row + 1]] - marks[w.end[at]]
        quoted = (since % 2 == 1) & (behind > 0)
        # context window: weight of the hits within WINDOW words on both sides, in the same text
        total = np.concatenate([[0], np.cumsum(np.where(edits > 0, MISSPELLED, 1.0) * weight)])
        first = np.concatenate([[0], np.cumsum(counts)])
        low = np.maximum(at - WINDOW, first[row])
        high = np.minimum(at + WINDOW + 1, first[row + 1])
        near = (total[high] - total[low]) * np.where(quoted, 0.5, 1.0)
        line = np.zeros((piece.rows, len(FEATURES)))
        sure = np.where(edits[at] > 0, MISSPELLED, 1.0)
        plain = np.bincount(row[~quoted], weights=sure[~quoted], minlength=piece.rows)
        line[:, 0] = np.log1p(plain)
        line[:, 1] = np.log1p(np.bincount(row[(edits[at] > 0) & ~quoted], minlength=piece.rows))
        line[:, 2] = np.log1p(np.bincount(row[quoted], minlength=piece.rows))
        np.maximum.at(line[:, 3], row, np.where(quoted, 0.5, 1.0) * weight[at] * sure)
        np.maximum.at(line[:, 4], row, near)
        line[:, 4] = np.log1p(line[:, 4])
        line[:, 5] = plain / np.maximum(counts, 1) ** 0.5
        out[piece.first : piece.first + piece.rows] = line
    return out


@dataclass
class Model:
    terms: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-penalised logistic regression by Newton steps; intercept first."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    penalty = np.full(z.shape[1], 1.0)
    penalty[0] = 1e-6
    b = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (p - y) + penalty * b
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        change = np.linalg.solve(hessian, gradient)
        b -= change
        if np.abs(change).max() < 1e-8:
            break
    return mean, scale, b


def _distinct_words(text: pa.Array) -> pa.Array:
    found = []
    for piece in pieces(text):
        w = words(piece, _LETTER[piece.data])
        _, first = np.unique(w.hash + mix(w.row.astype(np.uint64)), return_index=True)
        own: list[list[str]] = [[] for _ in range(piece.rows)]
        for i in first:
            if 2 < w.end[i] - w.start[i] <= 40:
                own[w.row[i]].append(piece.data[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace").lower())
        found += own
    return pa.array(found, pa.list_(pa.string()))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, size: int = LEXICON_SIZE) -> Model | None:
    """Learns from at most `rows` toxic and `rows` other labelled documents, by hash order.

    A document with several labels counts as toxic if any says so; null labels teach nothing.  None if
    there are no labelled documents of both kinds.
    """
    marked = labels.filter("doc_id is not null and toxic is not null")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = bounded_sample(marked, "y", rows)
    # at most 2 * rows ids, so they can be sent to the scan of the texts
    texts = docs.select("doc_id", F.lower("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = stored(texts.dropDuplicates(["doc_id"]), "training-texts")
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return None
    distinct = F.arrow_udf(_distinct_words, "array<string>")
    held = texts.select("y", F.explode(distinct("text")).alias("word")).groupBy("word")
    held = held.agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    # log-likelihood ratio of the word's share of toxic documents against the share of all documents
    share = n1 / (n1 + n0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    own = a / (a + b)
    evidence = a * F.log(own / share) + F.when(b > 0, b * F.log((1 - own) / (1 - share))).otherwise(0.0)
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    best = (
        held.filter(own > 3 * share if share < 0.25 else own > (1 + share) / 2)
        .select("word", evidence.alias("e"), odds.alias("o"))
        .filter((F.col("e") >= _EVIDENCE) & (F.col("o") >= 2.0))
        .orderBy(F.desc("e"), "word").limit(size).collect()
    )
    terms = {r["word"]: float(min(r["o"], 12.0)) for r in best}

    @F.arrow_udf("array<double>")
    def lines(text: pa.Array) -> pa.Array:
        return pa.array(list(features(text, _matcher(terms))), pa.list_(pa.float64()))

    # at most 2 * rows lines of six numbers
    sample = sorted(texts.select("doc_id", "y", lines("text").alias("x")).collect(), key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in sample], dtype=np.float64)
    y = np.array([r["y"] for r in sample], dtype=np.float64)
    return Model(terms, *_fit_logistic(x, y))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1) of the whole text and `predicted` (1 from 0.5 on).

    A null or empty text has no hits and gets the score of such texts; with no model every score is 0.
    Columns of those two names are replaced, all others kept; repeated rows get equal results.
    """
    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(len(column)))
        x = features(column, _matcher(model.terms))
        z = model.coefficients[0] + ((x - model.mean) / model.scale) @ model.coefficients[1:]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    given = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*given, scored(F.lower(F.col(f"`{text}`"))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    def learn(c: Column) -> Column:
        return ~held_out(c)

    model = fit(docs, labels.filter(learn(F.col("doc_id"))))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
