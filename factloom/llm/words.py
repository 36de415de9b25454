"""Words of whole texts as numpy arrays, for Python stages that read Arrow batches.

A batch is cut into pieces of a quarter of a megabyte (a longer text is a piece of its own), and the words of
a piece are found and hashed together, without a loop over its texts.  White space is
`[\\x20\\x09-\\x0D]`; A-Z count as a-z; a null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Each byte takes up to 15 words of 8 bytes on its way, and workers keep what their largest piece took.
PIECE_BYTES = 1 << 18
# What a batch used goes back to the system, so that idle workers stay small.
pa.set_memory_pool(pa.system_memory_pool())

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters and digits, for rules that look past punctuation; all bytes beyond ASCII count as letters.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first `n` powers of the hash's base (or of its inverse) modulo 2^64."""
    k = int(inverse)
    if len(_powers[k]) < n:
        base = _INVERSE if inverse else _BASE
        steps = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[k] = np.multiply.accumulate(steps)
    return _powers[k][:n]


@dataclass
class Piece:
    """Some rows of a batch: their numbers in the batch, their bytes, and where each text begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> str:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode("utf-8", "replace")


def pieces(
    column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES, max_rows: int = 1 << 20
) -> Iterator[Piece]:
    """The texts of an Arrow column, at most `limit` bytes at a time unless one text is longer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, dtype=np.uint8) if what is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), row + max_rows, len(column))
        yield Piece(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


@dataclass
class Words:
    """Words in order: the row of a piece, the bytes, and a 64-bit hash of the lower-cased word."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def runs(inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values; a run never crosses a break."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[breaks[breaks <= n]] = True
    cut[0] = cut[n] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def running(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any byte range follows."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * powers(len(data)), out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges (from `running`), equal for equal bytes wherever they stand."""
    h = (total[ends] - total[starts]) * powers(len(total), inverse=True)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, where each stands first, and for every value the number of its distinct one."""
    # Arrow's encoding, not that of pandas, which every worker would have to load
    coded = pa.array(values).dictionary_encode()
    codes, unique = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()
    first = np.empty(len(unique), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(values) - 1, -1, -1)
    return unique, first, codes


def words(piece: Piece, inside: np.ndarray | None = None, extra_breaks: np.ndarray | None = None) -> Words:
    """The words of a piece, or the runs of `inside` where another rule says what a word is."""
    data = _LOWER[piece.data]
    if inside is None:
        inside = ~_SPACE[piece.data]
    breaks = piece.offsets if extra_breaks is None else np.concatenate([piece.offsets, extra_breaks])
    starts, ends = runs(inside, breaks)
    row = np.repeat(np.arange(piece.rows), np.diff(np.searchsorted(starts, piece.offsets)))
    return Words(row, starts, ends, span_hashes(running(data), starts, ends))


def shingles(w: Words, size: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of each run of `size` words; a shorter text is one run, none if empty."""
    n = len(w.hash)
    counts = np.bincount(w.row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    if n >= size:
        h = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            h += w.hash[k : n - size + 1 + k] * powers(size + 1)[k + 1]
        at = np.flatnonzero(w.row[: n - size + 1] == w.row[size - 1 :])
        h, row = mix(h[at]), w.row[at]
    else:
        h, row, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = [
            sum(int(w.hash[first[r] + k]) * int(powers(size + 1)[k + 1]) for k in range(counts[r])) % (1 << 64)
            for r in short
        ]
        whole = mix(np.array(whole, dtype=np.uint64) + counts[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        h, row, at = (
            np.concatenate([h, whole]),
            np.concatenate([row, short]),
            np.concatenate([at, first[short]]),
        )
        order = np.argsort(row, kind="stable")
        h, row, at = h[order], row[order], at[order]
    return h, row, at
