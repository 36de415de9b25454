"""The Merkle manifest, exact top-k search, and cross-tokenizer alignment."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import CLASHING, documents, prose, rows_by_id

from factloom.llm import aligned, merkle, topk
from factloom.llm.queries import tokenizer_file

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    shown = [None if x is None else str(x) for x in row]
    return h(*["-" if x is None else f"{len(x.encode())}:{x}" for x in shown])


def reduced(nodes):
    """The top of some nodes, and each one's siblings level by level."""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            a = at // 16 * 16
            proofs[k].append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + 16])))
            where[k] = at // 16
        nodes = [h(*nodes[a : a + 16]) for a in range(0, len(nodes), 16)]
    return nodes[0], proofs


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof hash, folded root, verified) of (id, text, lang, source, n)."""
    by_source = defaultdict(list)
    for i, text, lang, source, n in rows:
        by_source[source].append((i, lang, n, text))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in order:
        own = sorted(
            by_source[s],
            key=lambda r: (r[0] is not None, r[0] or 0, leaf((r[0], s, *r[1:]))),
        )
        by_source[s] = own
        inner[s] = reduced([leaf((r[0], s, *r[1:])) for r in own])
    root, outer = reduced([inner[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        subroot, proofs = inner[s]
        for (i, lang, n, text), proof in zip(by_source[s], proofs, strict=True):
            proof = proof + outer[k]
            own = leaf((i, s, lang, n, text))
            tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
            claimed = leaf((i, s, lang, n, text.translate(SMALL))) if tampered and text is not None else own
            for a, b in proof:
                claimed = h(a, claimed, b)
            digest = h("".join(a + b for a, b in proof))
            out.append((i, own, subroot, root, digest, claimed, claimed == root))
    return sorted(out, key=repr)


def manifest_rows(spark, rows, clashing=False):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    if clashing:
        more = "leaf string, root string, bin string, block string, rank string, n string"
        rows, kinds = [(*r, *"abcdef") for r in rows], f"{kinds}, {more}"
    out = merkle.manifest_query(spark.createDataFrame(rows, kinds))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_manifest_against_plain_python(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, f"Text {k} " + prose(k, rng.randint(0, 5)), "en", "hot", k) for k in range(700)]
    rows += [(1000 + k, None if k % 3 else "ÄB", None, None, None) for k in range(17)]
    rows += [(2000 + k, "", "de", f"s{k % 40}", 0) for k in range(90)] + [(None, "A", "en", "hot", 1)] * 2
    # repeated rows, one id with several texts, a source that is an empty string
    rows += [rows[5], (5, "other", "en", "hot", 1), (1, "Z", "xx", "", 1)]
    rng.shuffle(rows)
    want = plain_manifest(rows)
    assert manifest_rows(spark, rows, clashing=True) == want
    assert any(not r[6] for r in want) and any(r[6] for r in want)
    monkeypatch.setattr(merkle, "SENT_COUNTS", 0)
    assert manifest_rows(spark, rows) == want


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(k, f"Text {k}", "en", "s", 1) for k in range(n)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_proofs_and_empty_table(spark):
    docs = documents(spark, [(k, f"T{k}", "en", f"s{k % 3}") for k in range(60)])
    for r in merkle.manifest(docs).collect():
        own = r["leaf"]
        for p in r["proof"]:
            own = h(p["before"], own, p["after"])
        assert own == r["root"] == r["folded_root"] and r["verified"]
    assert merkle.manifest_query(docs.limit(0)).collect() == []


VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain_top(rows, k=20, every=20):
    usable = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [max(-topk.MOST, min(topk.MOST, math.floor(64 * float(np.float32(x))))) for x in v]))
    out = []
    for i, v in usable:
        if i % every:
            continue
        found = [(-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in usable if j != i]
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(256, 4096, 256), (4, 16, 2)])
def test_top_k_against_plain_python(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "BLOCK", sizes[0])
    monkeypatch.setattr(topk, "RANGE", sizes[1])
    monkeypatch.setattr(topk, "PAGE", sizes[2])
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(k, (centres[k % 6] + 0.2 * rng.normal(size=12)).astype(np.float32).tolist(), k % 3) for k in range(400)]
    rows += [(1000 + k, rows[0][1], 1) for k in range(150)]  # a large group of equal vectors
    rows += [(2000, None, 1), (2020, [], 1), (2040, [0.0] * 12, 1), (2041, [1.0] * 3, 1), (2060, [3e38] * 12, 1)]
    rows += [(2080, [float("nan")] * 12, 1), (2100, [None, *[1.0] * 11], 1), (None, [1.0] * 12, 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{VECTORS}, score string, rank int")
    got = sorted(tuple(r) for r in topk.top_k_query(frame).collect())
    assert got == plain_top(rows)


def test_top_k_sends_queries_by_shelf_and_never_broadcasts_them(spark, monkeypatch):
    """Files of queries that go to many ranges are small, as equal rows are written once; their rows are not."""
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "RANGE", 8)
    plans, stored = [], topk.stored

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(topk, "stored", kept)
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist(), 1) for k in range(600)]
    frame = spark.createDataFrame(rows, VECTORS)
    assert sorted(tuple(r) for r in topk.top_k_query(frame).collect()) == plain_top(rows)
    sent = [part.split("FileScan", 1)[1].split("\n")[0] for p in plans for part in p.split("BroadcastExchange")[1:]]
    assert sent and all("page_high" in scan and "q_vectors" not in scan for scan in sent)
    # with pages that are too large to be sent, and cells that share a partition
    monkeypatch.setattr(topk, "SENT_BYTES", 0)
    monkeypatch.setattr(topk, "PAGE", 32)
    monkeypatch.setattr(topk, "PARTITIONS", 2)
    monkeypatch.setattr(topk, "TOGETHER", 3)
    del plans[:]
    assert sorted(tuple(r) for r in topk.top_k_query(frame).collect()) == plain_top(rows)
    assert not any("BroadcastExchange" in p for p in plans)


def test_top_k_skips_blocks_and_stays_exact():
    rng = np.random.default_rng(6)
    centres = 40 * rng.normal(size=(16, 32))
    rows = np.concatenate([(c + rng.normal(size=(topk.BLOCK, 32))) for c in centres]).round().astype(np.int64)
    high = rows.reshape(16, topk.BLOCK, 32).max(axis=1)
    low = rows.reshape(16, topk.BLOCK, 32).min(axis=1)
    ids = np.arange(len(rows))
    index = {"rows": rows, "high": high, "low": low, "ids": ids, "seats": ids}
    asks = rows[::100]
    best, scored = topk.search_range(asks, ids[::100], np.full(len(asks), topk._NONE), 5, index)
    assert scored < len(asks) * 4  # of 16 blocks each
    scores = asks @ rows.T
    scores[np.arange(len(asks)), ids[::100]] = topk._NONE
    want = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert (best.id == want).all()


def test_top_k_few_rows_ties_repeats_and_empty_tables(spark):
    rows = [(k, [1.0, 0.5], 1) for k in range(30)]
    got = sorted(tuple(r) for r in topk.top_k_query(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == plain_top(rows) and [r[2] for r in got if r[0] == 0] == list(range(1, 21))
    two = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], VECTORS)
    assert [tuple(r) for r in topk.top_k_query(two).collect()] == [(0, 1, 1, 64 * 128)]
    # a repeated id: each row may be found, and asks for itself
    three = spark.createDataFrame([(0, [1.0], 1), (0, [1.0], 1), (1, [2.0], 1), (1, [2.0], 1)], VECTORS)
    assert sorted(tuple(r) for r in topk.top_k_query(three).collect()) == [(0, k, 1, 8192) for k in (1, 1, 2, 2)]
    assert topk.top_k_query(two.limit(0)).collect() == []


A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file(A))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_file(B))
    both = aligned.Vocabularies(tokenizer_file(A), tokenizer_file(B))
    texts = {}
    for i, text, *_ in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            whole = (" " + text).encode()
            if whole == b"".join(both.a_bytes[t] for t in x) == b"".join(both.b_bytes[t] for t in y):
                p, q = np.cumsum([len(both.a_bytes[t]) for t in x]), np.cumsum([len(both.b_bytes[t]) for t in y])
                start = 0
                for cut in sorted(set(p.tolist()) & set(q.tolist())):
                    groups.append(
                        ([t for t, e in zip(x, p, strict=True) if start < e <= cut],
                         [t for t, e in zip(y, q, strict=True) if start < e <= cut])
                    )
                    start = cut
        texts[i] = groups
    links = {i: Counter((s, t) for x, y in g for s in x for t in y) for i, g in texts.items()}
    count = Counter(pair for own in links.values() for pair in own)
    most = Counter()
    for (s, _), n in count.items():
        most[s] = max(most[s], n)
    out = {}
    for i, groups in texts.items():
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[i] = (
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links[i].values()),
            sum(n for pair, n in links[i].items() if count[pair] == most[pair[0]]),
            sum(n * count[pair] for pair, n in links[i].items()),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        )
    return out, count


ODD = [
    "", None, " ", "  two  spaces ", "Hello, World! it's don't we'll", "é É ß İstanbul", "a▁b ▁", "x  y　z",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "1234 5a6b ½ ²", "日本語のテキスト。 次の文", "🙂🙂 ok🙂 👩‍👩‍👧", "tab\tnew\nline\r\nend\x0b\x0c",
    "\n\nlead\n\n\ntail\n", "\x00\x1c\x85", "ﬁ Ǆ ʼn", "..." * 50, "a" * 3000, "!? ?! ;;; \n .", "عربي نص हिन्दी", "word.\nNext \n x",
    " \n", "é combined é", "﻿bom", "ab​cd   line", "def f(x):\n    return x  # ok\n\tpass",
]


@pytest.mark.parametrize("docs_a_bucket", [4096, 7])
def test_alignment_against_plain_python(spark, monkeypatch, docs_a_bucket):
    monkeypatch.setattr(aligned, "BUCKET_DOCS", docs_a_bucket)
    monkeypatch.setattr(aligned, "KEPT_CHUNKS", 50)
    rows = [(k, t) for k, t in enumerate(ODD)]
    rows += [(100 + k, f"{prose(k, 40)}\n{prose(k % 4, 20)} The end, {k}.") for k in range(30)]
    rows += [(200 + k, "The same words in every copy of this unusual paragraph.") for k in range(20)]
    rows += [(300, prose(9, 500)), (301, "\n".join(prose(k, 12) for k in range(60)))]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, kind string, bucket string")
    out, pairs = aligned.alignment(docs, tokenizer_file(A), tokenizer_file(B))
    want, count = plain_alignment(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert got == want
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in pairs.collect()} == count


def test_alignment_of_repeats_slices_and_empty_tables(spark, monkeypatch):
    text = prose(3, 30) + " ünd Wörter"
    frame = documents(spark, [(1, text), (1, text), (None, text), (2, None)], clashing=True)
    assert "token string" in CLASHING
    whole = [tuple(r) for r in aligned.alignment_query(frame, tokenizer_file(A), tokenizer_file(B)).collect()]
    assert len(whole) == 4 and len({r[1:] for r in whole if r[0] != 2}) == 1
    monkeypatch.setattr(aligned, "SLICE", 5)
    al = aligned.Aligner(tokenizer_file(A), tokenizer_file(B))
    import pyarrow as pa

    from factloom.llm.words import pieces

    bucket = aligned._Bucket(al)
    for piece in pieces(pa.array([" " + text, " " + prose(4, 50)])):
        bucket.add(piece, [1, 2])
    assert bucket.rows[0]["sha"] == rows_by_id(frame.sparkSession.createDataFrame(
        [r for r in whole if r[0] == 1][:1],
        "doc_id bigint, a bigint, b bigint, g bigint, l bigint, best bigint, sums bigint, sha string"))[1]["sha"]
    empty = documents(spark, [])
    assert aligned.alignment_query(empty, tokenizer_file(A), tokenizer_file(B)).collect() == []


def test_irregular_groups_of_few_and_many_tokens(monkeypatch):
    """Pairs of a group and how often each occurs, listed or by arrays; known chunks are looked up once."""
    al = aligned.Aligner(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    for a, b in (((5, 3), (7,)), ((3, 3, 9), (7, 2, 7)), (tuple(range(30)), (4, 4, 1, 0))):
        want = Counter(x << 32 | y for x in a for y in b)
        keys, weights = al.pairs[al._type(a, b)]
        assert keys.tolist() == sorted(want) and weights.tolist() == [want[k] for k in sorted(want)]
        assert al._type(a, b) == al._type(a, b)
    seen = []
    monkeypatch.setattr(al, "learn", lambda new, learn=al.learn: (seen.extend(new), learn(new)))
    chunks = [b" one", b" two", b" one", b" three"]
    first = al.code(chunks).tolist()
    assert al.code([b" two", b" four", b" three", b" four"]).tolist() == [first[1], 3, first[3], 3]
    assert seen == [b" one", b" two", b" three", b" four"]
