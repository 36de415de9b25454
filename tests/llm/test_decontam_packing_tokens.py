"""Decontamination, packing, and token attribution."""

from __future__ import annotations

import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import documents, prose, rows_by_id
from pyspark.sql import functions as F

from factloom.llm import attribution, decontam, encode, packing
from factloom.llm.queries import tokenizer_file
from factloom.llm.words import distinct, pieces

WORD = "word_bpe_49k.json"


def plain_score(passage, item):
    """Smith-Waterman with two for a match and one off for all else."""
    above, best = [0] * (len(passage) + 1), 0
    for word in item:
        row = [0]
        for k, other in enumerate(passage):
            row.append(max(0, above[k] + (2 if word == other else -1), above[k + 1] - 1, row[k] - 1))
        above, best = row, max(best, *row)
    return best


def test_alignment_against_plain_python():
    rng = random.Random(4)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 15))]
        passage = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        score, start, end = decontam.align(np.array(passage), np.array(item))
        assert score == plain_score(passage, item)
        assert 0 <= start <= end <= len(passage) and (score == 0 or plain_score(passage[start:end], item) == score)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(k, prose(1000 + k, 30)) for k in range(25)] + [(25, None), (26, ""), (27, "two words"), (None, prose(1, 30))]
    rows += [(3, rows[3][1])]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, doc string")


def test_copies_are_found_and_clean_documents_are_not(spark, benchmark):
    items = {k: prose(1000 + k, 30) for k in range(25)}
    rng = random.Random(8)

    def edited(text: str, changes: int) -> str:
        own = text.split()
        for _ in range(changes):
            at = rng.randrange(len(own))
            if rng.random() < 0.4:
                own[at] = prose(rng.randrange(10**6), 1)
            elif rng.random() < 0.5:
                del own[at]
            else:
                own.insert(at, prose(rng.randrange(10**6), 1))
        return " ".join(own)

    rows, want = [], {}
    for k in range(25):
        for how in (0, 2, 4):
            i = len(rows)
            rows.append((i, f"{prose(i, 50)} {edited(items[k], how)} {prose(5000 + i, 30)}"))
            want[i] = k
    clean = [(len(rows) + k, prose(9000 + k, 120)) for k in range(40)]
    rows += clean
    n = len(rows)
    # half of a passage stays under the score; marks and case do not matter; a long text; a popular passage
    rows += [(n, " ".join(items[5].split()[:12]) + " " + prose(77, 60)), (n + 1, items[6].upper().replace(" ", " !! "))]
    rows += [(n + 2, f"{prose(31, 30_000)} {items[7]} {prose(32, 10)}"), (n + 3, None), (n + 4, ""), (None, items[1])]
    rows += [(n + 10 + k, f"{prose(600 + k, 5)} {items[9]}") for k in range(150)] + [rows[0]]
    want |= {n + 1: 6, n + 2: 7} | {n + 10 + k: 9 for k in range(150)}
    docs = documents(spark, rows, clashing=True)
    out = decontam.contaminated(docs, benchmark).collect()
    assert {r["doc_id"]: r["item_id"] for r in out} == want and len(out) == len(want)
    assert all(0.5 <= r["score"] <= 1 and r["start"] < r["end"] for r in out)
    kept = decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - set(want)


def test_copies_edited_alike_are_found_however_many_they_are(spark):
    item = prose(4100, 40)
    edited = " ".join(prose(7000 + k, 1) if k % 5 == 4 else word for k, word in enumerate(item.split()))
    rows = [(0, f"{prose(1, 40)} {item}")] + [(k, f"{prose(k, 40)} {edited} {prose(800 + k, 9)}") for k in range(1, 61)]
    benchmark = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = rows_by_id(decontam.contaminated(documents(spark, rows), benchmark))
    assert set(got) == set(range(61)) and all(0.5 < got[k]["score"] < 1 for k in range(1, 61))


def test_large_benchmarks_are_joined_and_empty_tables_work(spark, benchmark, monkeypatch):
    docs = documents(spark, [(1, prose(1004, 30) + " end"), (2, prose(3, 50))])
    sent = decontam.contaminated(docs, benchmark).collect()
    monkeypatch.setattr(decontam, "SENT_GRAMS", 0)
    assert decontam.contaminated(docs, benchmark).collect() == sent and [r["doc_id"] for r in sent] == [1]
    assert decontam.contaminated(documents(spark, []), benchmark).count() == 0
    assert decontam.contaminated(docs, benchmark.limit(0)).count() == 0


ODD = [
    "", " ", "Hello, World! it's don't we'll", "é É ß ẞ İstanbul ŞAŞKIN", "áb é ́x", "x y z",
    "<|endoftext|> and <|ENDOFTEXT|>tail", "a<|startoftext|>b", "1234 5a6b ½ ²", "日本語のテキスト。", "🙂🙂 ok🙂", "''s 's's.'s-'re",
    "_under_score_ a_b", "tab\tnew\nline\r\nend\x0b\x0c", "\x00\x1c\x85", "ﬁ Ǆ ʼn", "..." * 50, "a" * 3000,
]


def test_chunks_give_the_tokenizers_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_file(WORD))
    rng = random.Random(2)
    marks = [" ", ", ", ".", "'", "'s ", "-", " ", "\n", "é", "Ü", "3", "”", "<|endoftext|>"]
    texts = ODD + ["".join(prose(k * 50 + j, 1) + rng.choice(marks) for j in range(40)) for k in range(60)]
    coder = encode.encoder(tokenizer_file(WORD))
    for _ in range(2):  # the second time from what is remembered
        got = []
        for piece in pieces(pa.array([None, *texts]), max_rows=7):
            ids, bounds, _ = coder(piece)
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [[], *(own.encode(t, add_special_tokens=False).ids for t in texts)]


@pytest.mark.parametrize("shard_docs", [2048, 9])
def test_pieces_cover_every_document_once(spark, shard_docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_file(WORD))
    rng = random.Random(6)
    rows = [(i, prose(i, rng.choice([3, 40, 300, 900]))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, prose(62, 9_000)), (None, prose(63, 30)), (5, rows[5][1])]
    rows += [(70 + k, "same words again") for k in range(20)]
    out = packing.pack(documents(spark, rows, clashing=True), tokenizer_file(WORD), shard_docs=shard_docs).collect()
    wanted = sorted(
        (-1 if i is None else i, np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for i, t in rows
    )
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i in {i for i, _ in rows}:
        texts = [ids for k, ids in wanted if k == (-1 if i is None else i)]
        assert {r["doc_tokens"] for r in by_doc[i]} == {len(t) // 4 for t in texts}
        covered = sorted((r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i])
        cuts = [(a, min(4096, len(t) // 4 - a)) for t in texts for a in range(0, len(t) // 4, 4096)]
        assert covered == sorted((a, n, zlib.crc32(texts[0][4 * a : 4 * (a + n)])) for a, n in cuts)
    sequences: dict = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own_pieces in sequences.values():
        at = 0
        for offset, length in sorted(own_pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    assert packing.pack(documents(spark, []), tokenizer_file(WORD)).count() == 0


def test_neighbours_fill_windows_before_strangers():
    terms = [np.array([1, 2, 3], np.uint16)] * 3 + [np.array([7, 8, 9], np.uint16)] * 3
    counts = [np.ones(3, np.uint8)] * 6
    length = np.array([50, 25, 25, 49, 25, 26])
    idf = np.ones(packing.TERMS)
    got = packing.fill(length, packing.Index(terms, counts, length.astype(float), idf, 30.0), window=100)
    assert sorted(map(sorted, got)) == [[0, 1, 2], [3, 4, 5]]


def plain_allotment(ends, sections, rule):
    out, rest = [[0, 0] for _ in sections], 0
    begin = 0
    for end in ends:
        shared = [min(end, b) - max(begin, a) for a, b in sections]
        if rule == "most":
            k = max(range(len(sections)), key=lambda s: (shared[s], -s), default=None)
            fit = k is not None and shared[k] * 2 >= end - begin and shared[k] > 0
        else:
            point = begin if rule == "start" else end - 1
            k = next((s for s, (a, b) in enumerate(sections) if a <= point < b), None)
            fit = k is not None
        if fit:
            out[k][0] += 1
            out[k][1] += shared[k] < end - begin
        else:
            rest += 1
        begin = end
    return out, rest


@pytest.mark.parametrize("rule", attribution.RULES)
def test_allotment_against_plain_python(rule):
    rng = random.Random(5)
    for _ in range(300):
        ends = np.cumsum([rng.randrange(1, 6) for _ in range(rng.randrange(0, 25))])
        cuts = sorted(rng.sample(range(0, 90), 2 * rng.randrange(0, 6)))
        sections = list(zip(cuts[::2], cuts[1::2], strict=True))
        n, crossing, rest = attribution.allot(
            ends, np.array(cuts[::2], dtype=np.int64), np.array(cuts[1::2], dtype=np.int64), rule
        )
        want, left = plain_allotment(ends.tolist(), sections, rule)
        assert ([list(x) for x in zip(n.tolist(), crossing.tolist(), strict=True)], rest) == (want, left)


def test_counts_add_up_to_the_tokens(spark):
    import base64

    import public_tokenizers
    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "One. Two\nthree", "no stop at all", "é. Ünï 🙂\n🙂 x", "a\n\n\nb", prose(3, 20_000), ". ", "\n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[2])]
    docs = documents(spark, rows, clashing=True)
    out = attribution.token_counts(docs, attribution.prose_sections(F.col("text")), path)
    assert out.count() == len(rows) and set(docs.columns) <= set(out.columns)
    for r in out.collect():
        assert sum(t["n_tokens"] for t in r["tokens"]) == len(coder.encode_ordinary(r["text"] or "")), r["text"]
        assert [t["section"] for t in r["tokens"]] == [s for s in ("lead", "body", "tail") if s in {t["section"] for t in r["tokens"]}]
    spans = spark.createDataFrame(
        [(2, "b", 5, 8), (2, "a", 0, 5), (2, "overlap", 3, 6), (4, None, 0, 3), (4, "z", None, 2)],
        "doc_id bigint, section string, start bigint, end bigint",
    )
    joined = attribution.with_sections(docs, spans, "own")
    got = rows_by_id(attribution.token_counts(joined.filter("doc_id is not null"), F.col("own"), path))
    assert [t["section"] for t in got[2]["tokens"]] == ["a", "overlap", "b", None]  # overlap: the sixth character
    assert {t["section"] for t in got[3]["tokens"]} == {None}
    assert attribution.token_count_query(documents(spark, []), path).count() == 0
    with pytest.raises(ValueError):
        attribution.token_counts(docs, F.col("own"), path, rule="half")


def test_documents_without_tokens_have_a_row_of_zero(spark):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    out = attribution.token_count_query(documents(spark, [(1, None), (2, ""), (3, "some words")]), path).collect()
    empty = sorted(tuple(r) for r in out if r["doc_id"] < 3)
    assert empty == [(1, None, 0, 0), (2, None, 0, 0)]
    assert sum(r["n_tokens"] for r in out if r["doc_id"] == 3) > 0


def test_workers_of_the_pipeline_stay_small():
    """They need no pandas, and look at little text at once; smaller pieces give the same ids."""
    stages = "decontam, jaccard, language, packing"
    code = f"import sys; from factloom.llm import {stages}; sys.exit('pandas' in sys.modules)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
    texts = pa.array([prose(k, 400) + f" Word{k}, it's {k * 7}." for k in range(300)])
    found = [p.data.nbytes for p in pieces(texts)]
    assert len(found) > 1 and max(found) <= 1 << 18
    by_pieces, at_once = (encode.ChunkEncoder(tokenizer_file(WORD)) for _ in range(2))
    some = np.concatenate([by_pieces(p)[0] for p in pieces(texts, 1 << 14)])
    whole = np.concatenate([at_once(p)[0] for p in pieces(texts, 1 << 24)])
    assert some.tolist() == whole.tolist()
    assert (np.diff(by_pieces.hashes.astype(object)) > 0).all()


def test_distinct_values_stand_in_order_of_their_first_place():
    values = np.array([7, 1 << 63, 7, 0, 1 << 63, 5], dtype=np.uint64)
    unique, first, back = distinct(values)
    assert unique.tolist() == [7, 1 << 63, 0, 5] and first.tolist() == [0, 1, 3, 5]
    assert unique[back].tolist() == values.tolist()
    assert [len(x) for x in distinct(values[:0])] == [0, 0, 0]


def test_rows_of_a_piece_keep_their_own_terms():
    """The scan's bags of words are those of each text alone; ids of chunks are not cut apart one by one."""
    texts = ["b a a", None, "", " ", "z z z y " * 100, "Don't (stop) a-b c.d", "ß İx " + "q" * 600, "a"]
    rows = [pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])]
    alone = [pa.record_batch([pa.array([i], pa.int64()), pa.array([t], pa.string())], names=["doc_id", "text"]) for i, t in enumerate(texts)]
    run = packing._encode(tokenizer_file(WORD))
    got = [r for b in run(iter(rows)) for r in b.to_pylist()]
    assert got == [r for b in run(iter(alone)) for r in b.to_pylist()]
    for r, text in zip(got, texts, strict=True):
        count = np.frombuffer(r["count"], dtype=np.uint8)
        assert len(count) == len(np.unique(np.frombuffer(r["term"], dtype=np.uint16)))
        assert (count.max(initial=0) == 255) == bool(text and text.startswith("z")) and (r["lead"] < 0) == (not (text or "").strip())
    ids, start, size = encode.encoder(tokenizer_file(WORD))._encoded(["word", "a.b", "other", "ß"])
    parts = [ids[a : a + n].tolist() for a, n in zip(start, size, strict=True)]
    plain = encode.encoder(tokenizer_file(WORD)).tokenizer
    assert parts == [plain.encode(c, add_special_tokens=False).ids for c in ("word", "a.b", "other", "ß")]
