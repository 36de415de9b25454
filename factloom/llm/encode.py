"""Token ids of whole texts by a word-wise tokenizer, each distinct word encoded once per worker.

For a tokenizer that drops white space and never joins a letter with a following punctuation mark, the
ids of a text are those of its chunks in order.  Chunks end at white space and between an ASCII letter
and ASCII punctuation (but an apostrophe).  Case is levelled for A-Z only where the tokenizer does so
itself.  A text that holds one of the tokenizer's special strings is encoded as a whole.
"""

from __future__ import annotations

import os

import numpy as np

from factloom.llm.words import Piece, Words, distinct, words

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[i for i in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)) if i != 39]] = True

KEPT_CHUNKS = 1_500_000


class ChunkEncoder:
    """Encodes pieces; remembers the ids of chunks by their hash (at most KEPT_CHUNKS, then anew)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        marked = [i for token, i in vocabulary.items() if token.endswith("</w>")]
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool) if marked else None
        if marked:
            self.ends[marked] = True
        # without offsets where the library can do that
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of chunks, and for each chunk where its own begin and how many it has.

        Chunks of letters alone are encoded many at a time: each is one word to the tokenizer, whose last
        token is marked as a word's end.  Where the marks do not add up, each is encoded by itself.
        """
        start, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        parts, n = [np.zeros(0, np.uint32)], 0
        plain = [k for k, c in enumerate(chunks) if self.ends is not None and c.lower().isalpha()]
        rest = sorted(set(range(len(chunks))).difference(plain))
        for a in range(0, len(plain), 1000):
            run = plain[a : a + 1000]
            text = " ".join([chunks[k] for k in run])
            ids = np.array(self._batch([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(run) and stops[-1] == len(ids):
                size[run] = np.diff(stops, prepend=0)
                start[run] = n + stops - size[run]
                parts.append(ids)
                n += len(ids)
            else:
                rest.extend(run)
        alone: list[int] = []
        for k, e in zip(rest, self._batch([chunks[k] for k in rest], add_special_tokens=False), strict=True):
            start[k] = n + len(alone)
            alone.extend(e.ids)
            size[k] = n + len(alone) - start[k]
        return np.concatenate([*parts, np.array(alone, dtype=np.uint32)]), start, size

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        """Takes in chunks whose hashes are in order and new."""
        ids, start, size = self._encoded(chunks)
        start = (len(self.ids) + start).astype(np.int32)
        self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.start = np.insert(self.start, place, start)
        self.size = np.insert(self.size, place, size.astype(np.int32))

    def __call__(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, Words]:
        """All ids of a piece in order, where each row's begin (one more entry than rows), and the chunks."""
        data = piece.data
        breaks = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1 if len(data) else np.zeros(0, np.int64)
        w = words(piece, extra_breaks=breaks)
        if len(self.hashes) > KEPT_CHUNKS:
            self._forget()
        unique, first, back = distinct(w.hash)
        # hashes in order are found much faster among those in order
        order = np.argsort(unique)
        unique, first = unique[order], first[order]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        back = rank[back]
        place = np.searchsorted(self.hashes, unique)
        place[place == len(self.hashes)] = 0
        new = self.hashes[place] != unique if len(self.hashes) else np.ones(len(unique), bool)
        if new.any():
            chunks = [
                data[a:b].tobytes().decode("utf-8", "replace")
                for a, b in zip(w.start[first[new]], w.end[first[new]], strict=True)
            ]
            self._learn(unique[new], chunks)
            place = np.searchsorted(self.hashes, unique)
        size, start = self.size[place][back].astype(np.int64), self.start[place][back]
        total = np.cumsum(size) - size
        n = int(size.sum())
        ids = self.ids[np.repeat(start - total, size) + np.arange(n)]
        per_row = np.bincount(w.row, weights=size, minlength=piece.rows).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(per_row)])
        return *self._whole(piece, ids, bounds), w

    def _whole(self, piece: Piece, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes the rows that hold a special string as a whole."""
        raw, rows = piece.data.tobytes(), set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(piece.offsets, at, side="right")) - 1)
                at = raw.find(token, at + 1)
        if not rows:
            return ids, bounds
        parts = [
            np.array(self.tokenizer.encode(piece.text(r), add_special_tokens=False).ids, dtype=np.uint32)
            if r in rows
            else ids[bounds[r] : bounds[r + 1]]
            for r in range(piece.rows)
        ]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
