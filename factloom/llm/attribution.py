"""Token counts by section: a whole text is encoded once, and every token is allotted to a section.

Tokens of a byte-level BPE cover the text without gaps, so their byte ends are running sums of token
lengths.  They are joined with the sections' ranges by binary search, row by row.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import pieces

RULES = ("most", "start", "end")
SECTIONS = "array<struct<section: string, start: bigint, end: bigint>>"
COUNTS = "array<struct<section: string, n_tokens: bigint, n_crossing: bigint>>"
_COUNTS = pa.list_(pa.struct([("section", pa.string()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())]))
_ENCODINGS: dict[str, tuple] = {}


def _encoding(path: str):
    """The encoder of a ranks file, and the bytes of each token."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        coder = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        _ENCODINGS[path] = (coder, size)
    return _ENCODINGS[path]


def allot(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens per section and how many of them cross its borders, and tokens of no section.

    `ends` are the byte ends of tokens that cover the text; sections are sorted and do not overlap.
    """
    begins = np.concatenate([[0], ends[:-1]])
    size = np.maximum(ends - begins, 1)
    n = len(starts)
    # a token meets a run of sections; a point between sections belongs to none
    low = np.searchsorted(stops, begins, side="right")
    high = np.searchsorted(starts, ends, side="left") - 1
    own = np.full(len(ends), n)
    if n:
        one = low == high
        own[one] = low[one]
        for t in np.flatnonzero(low < high):
            run = np.arange(low[t], high[t] + 1)
            shared = np.minimum(stops[run], ends[t]) - np.maximum(starts[run], begins[t])
            own[t] = run[int(shared.argmax())] if rule == "most" else run[0] if rule == "start" else run[-1]
        inside = own < n
        at = np.minimum(own, n - 1)
        shared = np.minimum(stops[at], ends) - np.maximum(starts[at], begins)
        if rule == "most":
            inside &= shared * 2 >= size
        elif rule == "start":
            inside &= starts[at] <= begins
        else:
            inside &= stops[at] >= ends
        crossing = inside & (shared < ends - begins)
    else:
        inside = crossing = np.zeros(len(ends), bool)
    return (
        np.bincount(own[inside], minlength=n)[:n],
        np.bincount(own[crossing], minlength=n)[:n],
        int((~inside).sum()),
    )


def token_counts(
    docs: DataFrame, sections: Column, tokenizer: str, rule: str = "most", text: str = "text", out: str = "tokens"
) -> DataFrame:
    """`docs` with `out`: for each section its tokens and those of them that reach over its borders.

    `sections` is an array of (section, start, end) in code points, ends exclusive; empty ones count
    nothing, sections may leave gaps, and those that overlap an earlier one are cut to what is left.
    A token that crosses a border belongs to one section: the one with `most` of its bytes (of equal
    ones the first, and none if under half of it lies in sections), the one where it begins (`start`) or
    the one where it ends (`end`).  Tokens of no section are counted under the null name, so that counts
    always add up to the tokens of the text.  `tokenizer` is the path of a ranks file.  A null text has
    no tokens; null sections are none.  A column named like `out` is replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def counted(texts: pa.Array, spans: pa.Array) -> pa.Array:
        coder, size = _encoding(tokenizer)
        rows: list[list[dict]] = []
        for piece in pieces(texts):
            lead = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
            for r in range(piece.rows):
                ids = coder.encode_ordinary(piece.text(r))
                ends = np.cumsum(size[np.array(ids, dtype=np.int64)]) if ids else np.zeros(0, np.int64)
                own = sorted(
                    (s for s in spans[piece.first + r].as_py() or [] if s and None not in (s["start"], s["end"])),
                    key=lambda s: (s["start"], s["end"]),
                )
                # code points to bytes of this text
                a, b = piece.offsets[r], piece.offsets[r + 1]
                points = lead[a : b + 1] - lead[a]

                def byte(at: int, points=points) -> int:
                    return int(np.searchsorted(points, at, side="left")) if at < points[-1] else len(points) - 1

                starts, stops, names, reached = [], [], [], 0
                for s in own:
                    x, y = max(byte(s["start"]), reached), byte(s["end"])
                    if y > x:
                        starts.append(x)
                        stops.append(y)
                        names.append(s["section"])
                        reached = y
                n, crossing, rest = allot(
                    ends, np.array(starts, dtype=np.int64), np.array(stops, dtype=np.int64), rule
                )
                line = [
                    {"section": name, "n_tokens": int(i), "n_crossing": int(j)}
                    for name, i, j in zip(names, n, crossing, strict=True)
                ]
                if rest:
                    line.append({"section": None, "n_tokens": rest, "n_crossing": 0})
                rows.append(line)
        return pa.array(rows, _COUNTS)

    return docs.withColumn(out, F.arrow_udf(counted, COUNTS)(F.col(f"`{text}`"), sections))


def with_sections(docs: DataFrame, spans: DataFrame, out: str = "sections") -> DataFrame:
    """`docs` with the sections of a table of (doc_id, section, start, end) as an array."""
    own = spans.groupBy("doc_id").agg(F.collect_list(F.struct("section", "start", "end")).alias(out))
    return docs.join(own, "doc_id", "left")


def prose_sections(text: Column) -> Column:
    """Lead (to the blank behind the first full stop, or the first line's end), body, and last line."""
    size = F.char_length(text)
    stop = F.locate(". ", text)
    line = F.locate("\n", text)
    lead = F.when((stop > 0) & ((line == 0) | (stop < line)), stop + 1).when(line > 0, line).otherwise(size)
    tail = F.greatest(lead, size - F.char_length(F.substring_index(text, "\n", -1)))
    part = lambda name, a, b: F.struct(
        F.lit(name).alias("section"), a.cast("long").alias("start"), b.cast("long").alias("end")
    )
    return F.array(part("lead", F.lit(0), lead), part("body", lead, tail), part("tail", tail, size))


def token_count_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document and section (null: outside all): tokens, and those that cross a border.

    A document without tokens has one row: no section, and counts of 0.
    """
    rows = token_counts(docs.select("doc_id", "text"), prose_sections(F.col("text")), tokenizer)
    count = lambda name: F.coalesce(f"t.{name}", F.lit(0).cast("bigint")).alias(name)
    return rows.select("doc_id", F.explode_outer("tokens").alias("t")).select(
        "doc_id", "t.section", count("n_tokens"), count("n_crossing")
    )
