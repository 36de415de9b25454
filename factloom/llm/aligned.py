"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes of the corpus.

Byte offsets where tokens of both end cut a text into groups; all pairs inside a group are links.  Most
groups hold one token of either side with the same bytes, and an array from A's ids to B's ids of the same
bytes names their pair: documents that hold such a pair are counted in one vector as long as A's
vocabulary per task.  Only the other, irregular groups become pairs that are shuffled, once for each
bucket of documents that holds them, with the number of documents.  Counts return to the buckets, where
each group is summed once and each document adds up its groups.

Both tokenizers never join a character before a blank or line end with what follows, so a text is encoded
in chunks, and each worker encodes a chunk once.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import stored
from factloom.llm.words import distinct, pieces, running, span_hashes

#: Bytes of text looked at together: types are learned by the piece.
PIECE = 1 << 20
#: A bucket of documents ends at so many bytes of text or documents, and a worker keeps so many chunks.
BUCKET_BYTES = 16 << 20
BUCKET_DOCS = 4_096
KEPT_CHUNKS = 150_000
#: Chunks that are looked up, and bytes that are encoded, at once.
SLICE = 200_000
RUN_BYTES = 1 << 16
#: Groups are mostly of two or three tokens: so few pairs are listed without arrays.
FEW_PAIRS = 64
_ONES = np.ones(FEW_PAIRS, dtype=np.int64)

_PRINTED = np.zeros(256, dtype=bool)
_PRINTED[0x21:0x7F] = True
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x0A]] = True

_ROWS = {
    "kind": pa.int32(), "bucket": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(),
    "n_groups": pa.int64(), "n_links": pa.int64(), "sha": pa.string(), "same": pa.binary(), "same_n": pa.binary(),
    "odd": pa.binary(), "odd_n": pa.binary(), "keys": pa.list_(pa.int64()), "docs": pa.list_(pa.int64()),
    "group_size": pa.binary(), "group_pair": pa.binary(), "group_weight": pa.binary(), "vector": pa.list_(pa.int64()),
}
_SCHEMA = (
    "kind int, bucket long, doc_id long, n_a long, n_b long, n_groups long, n_links long, sha string, same binary, "
    "same_n binary, odd binary, odd_n binary, keys array<long>, docs array<long>, group_size binary, "
    "group_pair binary, group_weight binary, vector array<long>"
)
_DOC, _BUCKET, _VECTOR = 0, 1, 2


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the smallest width that holds them; the first byte names it."""
    kind = next(k for k in "BHIQ" if x.max(initial=0) <= np.iinfo(k).max)
    return kind.encode() + x.astype(kind).tobytes()


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=chr(data[0]), offset=1).astype(np.int64)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones, then 256 and up in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and A's ids as B's ids of the same bytes (-1: none)."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = _byte_letters()
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = added[i] if i in added else bytes(letters[c] for c in token)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        first: dict[bytes, int] = {}
        # a byte piece stands for its byte only where no other piece does
        for i in sorted(range(len(self.b_bytes)), key=lambda i: (self.b.is_byte(i), i)):
            if self.b_bytes[i]:
                first.setdefault(self.b_bytes[i], i)
        self.same = np.array([first.get(t, -1) if t else -1 for t in self.a_bytes], dtype=np.int64)
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self._batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(re.fullmatch("<0x(..)>", piece)[1], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both for a text (A's with a space before it), or None if their bytes are not the text's."""
        a = self._batch([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return None
        return a, b


class Aligner:
    """Chunks and the groups in them, remembered by the chunks' bytes (at most KEPT_CHUNKS, then anew)."""

    def __init__(self, a_file: str, b_file: str):
        self.v = Vocabularies(a_file, b_file)
        self.a_text = [str(i) for i in range(len(self.v.a_bytes))]
        self.b_text = [str(i) for i in range(len(self.v.b_bytes))]
        self.types: dict[tuple, int] = {}
        self.forget()

    def forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.shown: list[str] = []
        # per chunk: tokens, groups, links, and whether its bytes are not those of the tokens
        self.n_a, self.n_b, self.n_groups, self.n_links, self.bad = (np.zeros(0, np.int64) for _ in range(5))
        # one-to-one groups by A's id, others by their type: where they begin, how many, and all of them
        self.same_at, self.same_size, self.odd_at, self.odd_size = (np.zeros(0, np.int64) for _ in range(4))
        self.same_ids, self.odd_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.types.clear()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def _type(self, a: tuple, b: tuple) -> int:
        """The number of an irregular group; its distinct pairs and how often each occurs in it."""
        number = self.types.get((a, b))
        if number is None:
            number = self.types[a, b] = len(self.pairs)
            if len(a) * len(b) <= FEW_PAIRS:
                keys = sorted([x << 32 | y for x in a for y in b])
                if len(set(keys)) == len(keys):
                    self.pairs.append((np.array(keys, dtype=np.int64), _ONES[: len(keys)]))
                    return number
            x, n = np.unique(np.array(a, dtype=np.int64), return_counts=True)
            y, m = np.unique(np.array(b, dtype=np.int64), return_counts=True)
            self.pairs.append(((x[:, None] << 32 | y[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()))
        return number

    def _runs(self, chunks: list[bytes]) -> Iterator[tuple[list[bytes], tuple[list[int], list[int]] | None]]:
        """Chunks with the ids of both tokenizers behind those of a leading letter, many at a time."""

        def encoded(run: list[bytes]):
            found = self.v.encode("a" + b"".join(run).decode("utf-8", "replace"))
            if found and self.v.a_bytes[found[0][0]] == self.v.b_bytes[found[1][0]] == b" a":
                return found[0][1:], found[1][1:]
            return None

        run: list[bytes] = []
        size = 0
        for chunk in [*chunks, None]:
            # what ends in anything but a printed character can only be the end of a text
            alone = chunk is not None and not _PRINTED[chunk[-1]]
            if run and (chunk is None or alone or size > RUN_BYTES):
                found = encoded(run)
                if found is None and len(run) > 1:
                    yield from ((([c]), encoded([c])) for c in run)
                else:
                    yield run, found
                run, size = [], 0
            if alone:
                yield [chunk], encoded([chunk])
            elif chunk is not None:
                run.append(chunk)
                size += len(chunk)

    def _groups(self, run: list[bytes], a: list[int], b: list[int]) -> dict[str, np.ndarray]:
        """Columns of a run's chunks, its one-to-one groups in order, and the numbers of its other groups."""
        ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends, at, to = np.intersect1d(
            np.cumsum(self.v.a_size[ids_a]), np.cumsum(self.v.b_size[ids_b]), assume_unique=True, return_indices=True
        )
        stops_a, stops_b = at + 1, to + 1
        n_a, n_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
        chunk_ends = np.cumsum([len(c) for c in run])
        last = np.searchsorted(ends, chunk_ends)
        if last[-1] >= len(ends) or (ends[last] != chunk_ends).any():
            raise RuntimeError("a chunk's end is no end of tokens")
        first = np.concatenate([[0], last[:-1] + 1])
        one = (n_a == 1) & (n_b == 1)
        regular = one.copy()
        regular[one] = self.v.same[ids_a[stops_a[one] - 1]] == ids_b[stops_b[one] - 1]
        text_a, text_b = [self.a_text[i] for i in a], [self.b_text[i] for i in b]
        shown = [
            f"{text_a[i]}|{text_b[j]}" if x - i == 1 == y - j
            else ",".join(text_a[i:x]) + "|" + ",".join(text_b[j:y])
            for i, x, j, y in zip(
                (stops_a - n_a).tolist(), stops_a.tolist(), (stops_b - n_b).tolist(), stops_b.tolist(), strict=True
            )
        ]
        self.shown.extend([";".join(shown[g:h]) for g, h in zip(first.tolist(), (last + 1).tolist(), strict=True)])
        odd = np.flatnonzero(~regular)
        types = [
            self._type(tuple(a[i:x]), tuple(b[j:y]))
            for i, x, j, y in zip(
                (stops_a - n_a)[odd].tolist(), stops_a[odd].tolist(), (stops_b - n_b)[odd].tolist(),
                stops_b[odd].tolist(), strict=True,
            )
        ]
        total = lambda x: np.add.reduceat(x.astype(np.int64), first)
        return {
            "n_a": total(n_a), "n_b": total(n_b), "n_groups": last + 1 - first, "n_links": total(n_a * n_b),
            "same_size": total(regular), "odd_size": total(~regular), "same": ids_a[stops_a[regular] - 1],
            "odd": np.array(types, dtype=np.int64), "bad": np.zeros(len(run), np.int64),
        }

    def learn(self, chunks: list[bytes]) -> None:
        parts: list[dict[str, np.ndarray]] = []
        for run, found in self._runs(chunks):
            for chunk in run:
                self.codes[chunk] = len(self.codes)
            if found:
                parts.append(self._groups(run, *found))
            else:
                none = {c: np.zeros(len(run), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "same_size", "odd_size")}
                empty = np.zeros(0, np.int64)
                parts.append({**none, "same": empty, "odd": empty, "bad": np.ones(len(run), np.int64)})
                self.shown.extend([""] * len(run))
        whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        n_a, n_b, n_groups, n_links, bad = (whole[c] for c in ("n_a", "n_b", "n_groups", "n_links", "bad"))
        same, same_size, odd, odd_size = (whole[c] for c in ("same", "same_size", "odd", "odd_size"))
        grow = lambda old, new: np.concatenate([old, new])
        starts = lambda size, first: first + np.cumsum(size) - size
        self.same_at = grow(self.same_at, starts(same_size, len(self.same_ids)))
        self.odd_at = grow(self.odd_at, starts(odd_size, len(self.odd_ids)))
        self.same_size, self.odd_size = grow(self.same_size, same_size), grow(self.odd_size, odd_size)
        self.same_ids, self.odd_ids = grow(self.same_ids, same), grow(self.odd_ids, odd)
        self.n_a, self.n_b, self.bad = grow(self.n_a, n_a), grow(self.n_b, n_b), grow(self.bad, bad)
        self.n_groups, self.n_links = grow(self.n_groups, n_groups), grow(self.n_links, n_links)

    def code(self, chunks: list[bytes]) -> np.ndarray:
        """The chunks' numbers; unknown ones are learnt."""
        found = list(map(self.codes.get, chunks))
        unknown = [i for i, code in enumerate(found) if code is None]
        if unknown:
            self.learn(list(dict.fromkeys([chunks[i] for i in unknown])))
            for i in unknown:
                found[i] = self.codes[chunks[i]]
        return np.array(found, dtype=np.int64)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """The worker's aligner for two vocabulary files."""
    if (a_file, b_file) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[a_file, b_file] = Aligner(a_file, b_file)
    return _ALIGNERS[a_file, b_file]


def _gathered(at: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slices of `flat` one after another."""
    total = np.cumsum(size) - size
    return flat[np.repeat(at - total, size) + np.arange(int(size.sum()))]


def _tallied(row: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.unique(row * width + ids, return_counts=True)
    return key, n


class _Bucket:
    """Documents until they are written: a row each, and the irregular groups of all with their pairs."""

    def __init__(self, al: Aligner):
        self.al = al
        self.rows: list[dict] = []
        self.same: list[np.ndarray] = []
        self.odd: list[tuple[np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, piece, ids: list) -> None:
        al, data, offsets = self.al, piece.data, piece.offsets
        self.bytes += len(data)
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[1:-1] = _GAP[data[1:]] & _PRINTED[data[:-1]]
        inside[offsets] = True
        starts = np.flatnonzero(inside[:-1])
        ends = np.append(starts[1:], len(data))
        rows = np.searchsorted(offsets, starts, side="right") - 1
        raw = data.tobytes()
        sums = np.zeros((5, piece.rows), dtype=np.int64)
        shas = [hashlib.sha256() for _ in range(piece.rows)]
        same, odd = [], []
        for k in range(0, len(starts), SLICE):
            part = slice(k, k + SLICE)
            codes = self._codes(data, raw, starts[part], ends[part])
            row = rows[part]
            for j, x in enumerate((al.n_a, al.n_b, al.n_groups, al.n_links, al.bad)):
                np.add.at(sums[j], row, x[codes])
            same.append(_tallied(np.repeat(row, al.same_size[codes]),
                                 _gathered(al.same_at[codes], al.same_size[codes], al.same_ids), len(al.v.same)))
            odd.append(_tallied(np.repeat(row, al.odd_size[codes]),
                                _gathered(al.odd_at[codes], al.odd_size[codes], al.odd_ids), 1 << 31))
            known, shown = codes.tolist(), al.shown
            cuts = np.flatnonzero(np.diff(row, prepend=-1, append=-1)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                r = int(row[a])
                if k + a and rows[k + a - 1] == r:
                    shas[r].update(b";")
                shas[r].update(";".join([shown[c] for c in known[a:b]]).encode())
        same_of, odd_of = self._by_row(same, len(al.v.same), piece.rows), self._by_row(odd, 1 << 31, piece.rows)
        none = np.zeros(0, np.int64)
        for r in range(piece.rows):
            good = bool(sums[0, r]) and not sums[4, r]
            s, o = (same_of[r], odd_of[r]) if good else ((none, none), (none, none))
            self.rows.append(
                {"kind": _DOC, "doc_id": ids[r], "sha": shas[r].hexdigest() if good else "",
                 "same": _packed(s[0]), "same_n": _packed(s[1])}
                | {c: int(sums[j, r]) if good else 0 for j, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            )
            self.same.append(s[0])
            self.odd.append(o)

    def _codes(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The chunks' numbers; repeats are told by their hashes, so that each chunk is looked up once."""
        low = starts[0]
        unique, first, back = distinct(span_hashes(running(data[low : ends[-1]]), starts - low, ends - low))
        cuts = zip(starts[first].tolist(), ends[first].tolist(), strict=True)
        return self.al.code([raw[a:b] for a, b in cuts])[back]

    @staticmethod
    def _by_row(parts: list, width: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and counts of each row from the tallies of all slices."""
        if not parts:
            return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:
            key, back = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, back, count)
            count = total
        cuts = np.searchsorted(key, np.arange(n + 1) * width)
        return [(key[a:b] % width, count[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def full(self) -> bool:
        return self.bytes >= BUCKET_BYTES or len(self.rows) >= BUCKET_DOCS

    def written(self, number: int, vector: np.ndarray) -> pa.RecordBatch:
        """The bucket's rows; `vector` counts its documents by the ids of their one-to-one groups."""
        al = self.al
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *[t for t, _ in self.odd]]))
        size = np.array([len(al.pairs[t][0]) for t in used.tolist()], dtype=np.int64)
        every = np.concatenate([np.zeros(0, np.int64), *[al.pairs[t][0] for t in used.tolist()]])
        weight = np.concatenate([np.zeros(0, np.int64), *[al.pairs[t][1] for t in used.tolist()]])
        keys, pair = np.unique(every, return_inverse=True)
        begin = np.cumsum(size) - size
        # documents that hold a pair in irregular groups only
        a, b = keys >> 32, keys & 0xFFFFFFFF
        regular = al.v.same[a] == b if len(keys) else np.zeros(0, bool)
        docs = np.zeros(len(keys), dtype=np.int64)
        for row, s, (t, n) in zip(self.rows, self.same, self.odd, strict=True):
            vector[s] += 1
            local = np.searchsorted(used, t)
            row["odd"], row["odd_n"], row["bucket"] = _packed(local), _packed(n), number
            held = np.unique(_gathered(begin[local], size[local], pair)) if len(t) else local
            named = held[regular[held]]
            if len(named):
                held = np.setdiff1d(held, named[np.isin(a[named], s)], assume_unique=True)
            docs[held] += 1
        own = {
            "kind": _BUCKET, "bucket": number, "keys": keys, "docs": docs, "group_size": _packed(size),
            "group_pair": _packed(pair), "group_weight": _packed(weight),
        }
        return _batch([*self.rows, own])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(c) for r in rows], kind) for c, kind in _ROWS.items()], names=list(_ROWS)
    )


def _encoded(a_file: str, b_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        al = aligner(a_file, b_file)
        first, made = TaskContext.get().partitionId() << 32, 0
        vector = np.zeros(len(al.v.same), dtype=np.int64)
        bucket = _Bucket(al)
        some = False
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for piece in pieces(batch.column(1), PIECE):
                some = True
                bucket.add(piece, ids[piece.first : piece.first + piece.rows])
                if bucket.full():
                    yield bucket.written(first + made, vector)
                    made += 1
                    # types are numbers of the aligner, so it starts anew only between buckets
                    if len(al.shown) > KEPT_CHUNKS:
                        al.forget()
                    bucket = _Bucket(al)
        if bucket.rows:
            yield bucket.written(first + made, vector)
        if some:
            yield _batch([{"kind": _VECTOR, "vector": vector}])
        if len(al.shown) > KEPT_CHUNKS:
            al.forget()

    return run


def _summed(total: np.ndarray, highest: np.ndarray):
    """Per bucket: its documents with their sums; `total` and `highest` are of A's ids beside the same bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, n, best = (right[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "n", "best"))
        order = np.argsort(keys)
        keys, n, best = keys[order], n[order], best[order].astype(np.int64)
        head = left.filter(pa.compute.equal(left["kind"], _BUCKET)).to_pylist()[0]
        at = np.searchsorted(keys, np.array(head["keys"], dtype=np.int64))
        size, pair, weight = (_array(head[c]) for c in ("group_size", "group_pair", "group_weight"))
        starts = np.cumsum(size) - size
        group_sum = np.add.reduceat(weight * n[at][pair], starts) if len(size) else size
        group_best = np.add.reduceat(weight * best[at][pair], starts) if len(size) else size
        docs = left.filter(pa.compute.equal(left["kind"], _DOC))
        sums, bests = [], []
        for same, same_n, odd, odd_n in zip(
            *[docs[c].to_pylist() for c in ("same", "same_n", "odd", "odd_n")], strict=True
        ):
            s, m, o, k = _array(same), _array(same_n), _array(odd), _array(odd_n)
            sums.append(int(m @ total[s] + k @ group_sum[o]))
            bests.append(int(m @ highest[s] + k @ group_best[o]))
        out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(bests, pa.int64()))
        out = out.append_column("count_sum", pa.array(sums, pa.int64()))
        return out.append_column("groups_sha256", docs["sha"])

    return run


def alignment(docs: DataFrame, a_file: str, b_file: str) -> tuple[DataFrame, DataFrame]:
    """Per document its tokens, groups, links and their counts; and per linked pair of ids its count.

    `a_file` is a byte-level BPE (tokenizers), `b_file` a sentencepiece model with byte fallback; both are
    read where the tasks run.  The first table has doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum
    and groups_sha256 as the contract of `op13` names them, the second a_id, b_id, n_docs and `best`
    (whether that is the highest of a_id).  A null or empty text, and one that either tokenizer changes,
    has no tokens: zeros and an empty string.  Rows are documents each, also if they repeat an id or have
    none.  Other columns play no part; empty tables give empty tables.
    """
    spark = docs.sparkSession
    text = F.when(F.col("text") != "", F.concat(F.lit(" "), F.col("text")))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = stored(given.mapInArrow(_encoded(a_file, b_file), _SCHEMA), "aligned")

    # bounded by A's vocabulary: documents by id of a one-to-one group
    same = Vocabularies(a_file, b_file).same
    counted = rows.filter(F.col("kind") == _VECTOR).select(F.posexplode("vector").alias("a", "n")).filter("n > 0")
    counted = counted.groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    a, n = (counted[c].to_numpy().astype(np.int64) for c in ("a", "n"))
    regular = spark.createDataFrame(
        pa.table({"key": pa.array(a << 32 | same[a], pa.int64()), "n": pa.array(n, pa.int64())})
    )

    odd = rows.filter(F.col("kind") == _BUCKET).select("bucket", F.arrays_zip("keys", "docs").alias("p"))
    odd = odd.select("bucket", F.explode("p").alias("p")).select(
        "bucket", F.col("p.keys").alias("key"), F.col("p.docs").alias("n")
    )
    pairs = odd.select("key", "n").unionByName(regular).groupBy("key").agg(F.sum("n").alias("n"))
    pairs = stored(pairs, "pair-counts").withColumn("a", F.shiftright("key", 32))
    # one row for each id of A at most
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    pairs = pairs.join(F.broadcast(most), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    known = pairs.join(F.broadcast(regular.select("key")), "key").toArrow()
    at = known["key"].to_numpy() >> 32
    total, highest = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    total[at] = known["n"].to_numpy()
    highest[at] = known["best"].combine_chunks().to_numpy(zero_copy_only=False)

    back = odd.select(F.col("bucket").alias("of"), "key").join(pairs, "key")
    own = rows.filter(F.col("kind") != _VECTOR).select(
        "kind", "bucket", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "same", "same_n", "odd", "odd_n",
        "keys", "group_size", "group_pair", "group_weight",
    )
    out = own.groupBy("bucket").cogroup(back.groupBy("of")).applyInArrow(
        _summed(total, highest),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string",
    )
    linked = pairs.select(
        F.shiftright("key", 32).alias("a_id"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("b_id"),
        F.col("n").alias("n_docs"), "best",
    )
    return out, linked


def alignment_query(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    return alignment(docs, a_file, b_file)[0]
