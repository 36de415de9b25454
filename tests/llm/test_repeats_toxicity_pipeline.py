"""Repeated strings, toxicity, and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import random
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import documents, prose, rows_by_id
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import jaccard, language, repeats, toxicity
from factloom.llm.words import Piece


def plain_removal(rows):
    """(n_bytes, n_removed, n_spans, sha256) of each row, in plain Python."""
    order = sorted({2**63 if i is None else i for i, _ in rows})
    first: dict[bytes, int] = {}
    for i in order:
        for k, text in rows:
            if (2**63 if k is None else k) == i:
                raw = (text or "").encode()
                for a in range(len(raw) - 49):
                    first.setdefault(raw[a : a + 50], i)
    out = []
    for k, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for a in range(len(raw) - 49):
            if first[raw[a : a + 50]] < (2**63 if k is None else k):
                gone[a] += 1
                gone[a + 50] -= 1
        cover = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
        out.append((str(k), len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeated_rows():
    rng = random.Random(9)
    passages = [prose(k, 25) for k in range(4)] + ["é" * 40, "ab" * 60, "z" * 200]
    rows = []
    for i in range(60):
        parts = [prose(100 + i, rng.randrange(1, 30))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(30, 120)], prose(rng.randrange(10**6), rng.randrange(4))]
        rows.append((i * 3, " ".join(parts)))
    rows += [(1, rows[4][1]), (500, rows[4][1]), (501, rows[4][1]), (6, rows[2][1]), (502, None), (503, ""), (504, "x" * 49)]
    rows += [(505, "x" * 49), (506, "y" * 50), (507, "y" * 50), (None, rows[7][1]), (None, "only here " * 9), (508, "only here " * 9)]
    rows += [(509, "z" * 30_000), (510, prose(3, 20_000)), (511, "tail " + prose(3, 20_000)[777:]), (9, prose(12345, 30))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_repeats_against_brute_force(spark, small):
    # small: many runs, files, and a filter that lets almost everything through
    sizes = repeats.Sizes(slice_bits=64, run_segments=40, block=256, memory_blocks=2) if small else None
    rows = repeated_rows()
    docs = documents(spark, rows, clashing=True)
    out = repeats.repeats_query(docs, sizes).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    assert got == plain_removal(rows)
    for r in repeats.removed_repeats(docs, sizes).collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] == r["n_bytes"] - len(r["kept"])


def test_segments_are_the_strings_of_their_smallest_hash(spark):
    """Every string lies in one segment; no segment reaches on, and no row carries the hash of its anchor."""
    rng = random.Random(4)
    raw = bytes(rng.randrange(97, 123) for _ in range(5_000))
    piece = Piece(0, np.frombuffer(raw, np.uint8), np.array([0, 2_000, 2_030, len(raw)]))
    value, row, at, least = repeats.anchors(piece)
    first, last = repeats.reach(value, at, least)
    covered = sorted(s for a, b in zip(first.tolist(), last.tolist(), strict=True) for s in range(a, b + 1))
    assert covered == [*range(1_951), *range(2_030, len(raw) - 49)]
    assert ((first <= at) & (at <= last + 30)).all()
    assert "anchor" not in repeats._SEGMENT.names


def test_only_documents_of_several_texts_keep_a_hash(spark):
    long = prose(5, 40)
    rows = [(1, long), (2, long + " more"), (2, "short"), (3, long), (3, long), (None, "a" * 60), (None, "b" * 60), (4, None)]
    docs = documents(spark, rows).select(
        F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("hash")
    )
    keyed = repeats._keyed(docs).collect()
    assert sorted((r["doc"], r["key"] == r["hash"]) for r in keyed) == sorted(
        (-1 if k is None else k, k in (None, 2)) for k, _ in rows
    )
    assert {r["key"] for r in keyed if r["doc"] in (1, 3, 4)} == {0}
    out = repeats.repeats_query(documents(spark, rows)).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    assert got == plain_removal(rows)


def test_repeats_of_an_empty_table(spark):
    assert repeats.repeats_query(documents(spark, [])).count() == 0


def test_suffix_order_against_sorting():
    sizes = repeats.Sizes(block=64, memory_blocks=3)
    rng = np.random.default_rng(3)
    size = rng.integers(0, 40, 60)
    data = rng.integers(97, 100, int(size.sum())).astype(np.uint8)
    ends = np.cumsum(size)
    starts = ends - size
    with tempfile.TemporaryDirectory() as folder:
        order = repeats.suffix_order(data, starts, ends, folder, sizes)
        words = np.concatenate(list(order.read()))
        order.close()
    seq, off = (words & np.uint64((1 << 40) - 1)).astype(int), ((words >> np.uint64(40)) & np.uint64(0xFFFF)).astype(int)
    got = [data[starts[s] + o : ends[s]].tobytes() for s, o in zip(seq, off, strict=True)]
    assert got == sorted(got) and len(got) == len(data) + 60 and len(set(zip(seq, off, strict=True))) == len(got)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = {"scum": 3.0, "moron": 2.0, "disgusting": 4.0, "worthlessness": 5.0, "wortlos": 1.0, "über": 1.5}
    rng = random.Random(1)
    automaton = toxicity.Automaton(terms, limit=50)
    words = list(terms)
    for term, _ in itertools.product(terms, range(250)):
        own = list(term)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(own) + 1)
            own[at : at + rng.randrange(2)] = rng.choice(["", *"aeimnorstuwü"])
        words.append("".join(own))
    for word in words:
        fits = [(edits(word, t), -w, t) for t, w in terms.items() if edits(word, t) <= automaton.allowed(t)]
        want = (min(fits)[2], min(fits)[0]) if fits else None
        assert automaton.find(word) == want, word


def toxic_rows():
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        text = prose(i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["grubling", "snarfwit", "blorgface", "mudwump"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_two_edits_in_nine_letters_and_marks_between_letters():
    matcher = toxicity.Matcher({"blorgface": 3.0, "snarfwits": 3.0, "mudwump": 3.0, "grub": 3.0})
    hit = ["blrgfce", "xblorgfacey", "snarfwits", "bl0rgf4ce", "bl0rgface", "m*dwump", "mudw@mp", "mud-wump", "sn--rfwits", "blorg7ace now"]
    miss = ["m*dw*mp", "gr*b", "mud wump", 'mud"wump', "b10rgf4ce", "mud, wump", "blorg 7ace", "12 !! 3a4", "a-b-c-d-e"]
    for word in hit + miss:
        out = toxicity.features(pa.array([f"some words {word} and more", None]), matcher)
        assert (out[0, 0] > 0) == (word in hit), word
        assert not out[1].any()
    once = toxicity.features(pa.array(["mudwump-like mudwump"]), matcher)[0, 0]
    assert once == np.log1p(2)


def test_toxicity_learns_misspellings_and_quotation(spark):
    rows, labels = toxic_rows()
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 0, None), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(documents(spark, rows), marks)
    assert {"grubling", "snarfwit", "blorgface", "mudwump"} <= set(model.terms)
    base = prose(999, 60)
    asked = [
        (1, base), (2, f"{base} grubling snarfwit {base}"), (3, f"{base} GRUBLNG snarffwit mudwumpp blorgfacce grubbling {base}"),
        (4, f'{base} "the words grubling snarfwit" {base}'), (5, None), (6, ""), (7, prose(5, 30_000)), (2, f"{base} grubling snarfwit {base}"),
    ]
    docs = documents(spark, asked, clashing=True)
    out = toxicity.score(docs, model)
    assert set(docs.columns) - {"score", "predicted"} <= set(out.columns) and out.count() == len(asked)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in out.collect()}
    assert [got[i][1] for i in (1, 2, 3, 5, 6, 7)] == [0, 1, 1, 0, 0, 0]
    assert got[4][0] < got[2][0] and got[5][0] == got[6][0] and all(0 <= s <= 1 for s, _ in got.values())


def test_held_out_accuracy_and_no_leak(spark):
    rows, labels = toxic_rows()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = rows_by_id(toxicity.toxicity_query(docs, marks))
    held = [i for i, r in got.items() if r["held_out"]]
    assert held and all(got[i]["predicted"] == (i % 5 == 0) for i in held)
    lied = marks.withColumn("toxic", F.when(language.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert got == rows_by_id(toxicity.toxicity_query(docs, lied))


def test_toxicity_of_nothing(spark):
    empty = documents(spark, [])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.fit(documents(spark, [(1, "a")]), none) is None
    assert [r["score"] for r in toxicity.score(documents(spark, [(1, "a"), (None, None)]), None).collect()] == [0.0, 0.0]
    assert toxicity.toxicity_query(empty, none).count() == 0


def test_pipeline_stages_against_their_rules(spark, tmp_path):
    item = prose(4001, 30, "item ben mar kor tal")
    shared = "This line stands in many of the documents"
    rows = [(i, f"{prose(i, 80)}\n{shared}\n{prose(700 + i, 20)}", "a", f"s{i % 3}") for i in range(60)]
    rows += [(60, rows[0][1], "a", "s"), (61, rows[1][1] + " end", "a", "s"), (62, f"{prose(62, 30)} {item}", "a", "s")]
    rows += [(63, None, None, None), (64, "123 456", "a", "s"), (None, prose(64, 50), "a", "s")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    everything = {i for i, *_ in rows}
    assert ids["language_id"] == everything - {63, 64}
    assert ids["line_dedup"] == ids["language_id"]
    texts = rows_by_id(spark.read.parquet(f"{tmp_path}/line_dedup"))
    assert [i for i, r in texts.items() if shared in r["text"].split("\n")] == [0]
    similar = jaccard.similar_sets(spark.read.parquet(f"{tmp_path}/line_dedup")).collect()
    assert ids["near_dedup"] == {r["doc_id"] for r in similar if r["doc_id"] is None or r["doc_id"] == r["component_id"]}
    assert ids["decontamination"] == ids["near_dedup"] - {62} and 62 in ids["near_dedup"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ids["decontamination"]
    assert [r["doc_id"] for r in packed if r["doc_tokens"] != r["length"]] == []


def test_repeats_look_at_small_pieces_of_a_batch():
    """What a piece takes is a multiple of its bytes, so a batch of many texts is many pieces."""
    import pyarrow as pa

    texts = [f"{k:04d} " + "abcdefgh " * 113 for k in range(1000)]
    columns = [pa.array(range(1000), pa.int64()), pa.array(range(1000), pa.int64()), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc", "key", "text"])
    found = list(repeats._chunk_rows(iter([batch])))
    assert len(found) >= 4 and sum(b.num_rows for b in found) >= 1000
    assert int(repeats.BATCH_ROWS) <= 500
