"""Language ID, secret scans and line dedup."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re

import pytest
from llm_helpers import documents, prose, rows_by_id
from pyspark.sql import functions as F

from factloom.llm import language, lines, secrets

NORTH = "skja tun hrod vik gard norr fjell bek ulf stav"
SOUTH = "ola mari zeno lupa quie rado celi nova pata sera"


@pytest.fixture(scope="module")
def two_languages(spark):
    rows = [(i, prose(i, 60, NORTH), "north") for i in range(40)]
    rows += [(100 + i, prose(i, 60, SOUTH), "south") for i in range(40)]
    return documents(spark, rows)


def test_nearest_language_and_rejection(spark, two_languages):
    model = language.fit(two_languages)
    asked = documents(
        spark,
        [
            (1, prose(901, 40, NORTH)), (2, prose(902, 40, SOUTH)), (3, prose(901, 4, NORTH)),
            (4, None), (5, ""), (6, "12 34 !!"), (7, "你好世界 " * 80), (8, prose(903, 30_000, SOUTH)),
            (None, prose(904, 40, NORTH)), (2, prose(902, 40, SOUTH)),
        ],
        clashing=True,
    )
    out = language.identify(asked, model)
    assert set(asked.columns) - {"lang_pred", "score", "rejected"} <= set(out.columns)
    got = out.collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 8, None)] == ["north", "south", "north", "south", "north"]
    assert not any(by[i]["rejected"] for i in (1, 2, 3, 8, None))
    for i in (4, 5, 6):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[7]["rejected"] and by[7]["lang_pred"] in ("north", "south")
    assert all(0 <= r["score"] <= 1 for r in got)


def test_foreign_text_in_a_known_script_is_rejected(spark):
    north = "the and ing her that was with ent ion for his ter"
    south = "che della non per con una sono gli alla piu come ato"
    rows = [(i, prose(i, 40 + i * 3, north), "north") for i in range(100)]
    rows += [(200 + i, prose(i, 40 + i * 3, south), "south") for i in range(100)]
    rows += [(400 + i, "zq " * (5 + i), "north") for i in range(3)]  # junk among the training rows
    model = language.fit(documents(spark, rows))
    rng = random.Random(3)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n)) for n in (100, 541, 3375) for _ in range(5)]
    own = [prose(900 + i, n, which) for i, n in enumerate((6, 20, 100, 900)) for which in (north, south)]
    unseen = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto"
    asked = [(i, t) for i, t in enumerate([*noise, unseen, unseen * 6])] + [(100 + i, t) for i, t in enumerate(own)]
    got = rows_by_id(language.identify(documents(spark, asked), model))
    assert all(r["rejected"] == (i < 100) for i, r in got.items())


def test_language_learns_from_nothing(spark):
    empty = documents(spark, [])
    assert language.fit(empty) is None
    assert language.fit(documents(spark, [(1, "abc", None), (2, None, "x")])) is None
    got = language.identify(documents(spark, [(1, "abc")]), None).collect()
    assert [(r["lang_pred"], r["rejected"]) for r in got] == [("und", True)]
    assert language.identify(empty, None).count() == 0


def test_language_query_never_looks_at_labels_of_what_it_predicts(spark, two_languages):
    plain = rows_by_id(language.language_query(two_languages))
    lied = two_languages.withColumn(
        "lang", F.when(language.held_out(F.col("doc_id")), F.lit("south")).otherwise(F.col("lang"))
    )
    assert plain == rows_by_id(language.language_query(lied))
    assert all(r["lang_pred"] == ("north" if i < 100 else "south") for i, r in plain.items())


def item(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x81, size]) if size < 256 else b"\x82" + size.to_bytes(2, "big")
    return bytes([tag]) + head + body


def number(n: int) -> bytes:
    return item(0x02, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA_ID = item(0x30, item(0x06, bytes.fromhex("2a864886f70d010101")), item(0x05))
EC_ID = item(0x30, item(0x06, bytes.fromhex("2a8648ce3d0201")), item(0x06, bytes.fromhex("2a8648ce3d030107")))
BIG = [(1 << 200) + k * 12345 for k in range(9)]
RSA = item(0x30, number(0), *[number(n) for n in BIG[:8]])
EC = item(0x30, number(1), item(0x04, bytes(range(1, 33))), item(0xA1, item(0x03, b"\0\4" + bytes(64))))


def der_key() -> bytes:
    return item(0x30, number(0), RSA_ID, item(0x04, RSA))


def signed_token() -> str:
    def part(x: dict) -> str:
        return base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()

    return f"{part({'alg': 'HS256', 'typ': 'T'})}.{part({'sub': 'someone'})}.c2lnbmF0dXJl"


def test_confirmed_and_base_spans():
    key = base64.b64encode(der_key()).decode()
    text = f'é Password: "abc123xy" AKIA{"A" * 16} {"0af1" * 8} {key} and {signed_token()} end'
    got = secrets.spans_of(text)
    assert [(k, b) for k, _, _, b, _ in got] == [
        ("assign", True), ("access", True), ("hex", True), ("key", False), ("token", False)
    ]
    assert {k: f for k, _, _, _, f in got}["key"] == "der"
    assert text[got[0][1] : got[0][2]].startswith("Password")
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", key)) + "\n-----END PRIVATE KEY-----"
    assert "pem" in [k for k, *_ in secrets.spans_of(pem)]
    cut = base64.b64encode(der_key()[:-3]).decode()
    assert not secrets.spans_of(cut)  # lengths no longer add up
    assert not secrets.spans_of(prose(1, 300))


def ssh(*fields: bytes, keys: int = 1, private: bytes = bytes(40)) -> bytes:
    text = lambda b: len(b).to_bytes(4, "big") + b
    public = b"".join(text(b"public") for _ in range(keys))
    return b"openssh-key-v1\0" + b"".join(text(f) for f in fields) + keys.to_bytes(4, "big") + public + text(private)


def test_private_keys_only():
    ed = item(0x30, number(0), item(0x30, item(0x06, bytes.fromhex("2b6570"))), item(0x04, item(0x04, bytes(32))))
    sealed = item(0x30, item(0x30, item(0x06, bytes.fromhex("2a864886f70d01050d")), item(0x30, number(1))), item(0x04, bytes(64)))
    keys = {
        "rsa": RSA, "ec": EC, "dsa": item(0x30, number(0), *[number(n) for n in BIG[:5]]), "pkcs8": der_key(),
        "encrypted": sealed, "pkcs8 ": item(0x30, number(0), EC_ID, item(0x04, EC)), "pkcs8  ": ed,
    }
    for form, key in keys.items():
        assert secrets.private_key(key) == form.strip() and secrets.key_form(key) == "der"
        assert [k for k, *_ in secrets.spans_of(f"x {base64.b64encode(key).decode()} y")] == ["key"]
        assert ("hex", "der") in [(k, f) for k, _, _, _, f in secrets.spans_of(key.hex())]
        assert secrets.private_key(key[:-1]) is None and secrets.private_key(key + b"\0") is None
    public = item(0x30, RSA_ID, item(0x03, b"\0", item(0x30, number(BIG[0]), number(65537))))
    body = item(0x30, number(7), RSA_ID, item(0x30), item(0x30), public)
    others = {
        "PUBLIC KEY": public, "RSA PUBLIC KEY": item(0x30, number(BIG[0]), number(65537)),
        "CERTIFICATE": item(0x30, body, RSA_ID, item(0x03, b"\0" + bytes(32))),
        "DIGEST": item(0x30, item(0x30, item(0x06, bytes.fromhex("608648016503040201")), item(0x05)), item(0x04, bytes(32))),
        "PRIVATE KEY": item(0x30, number(0), RSA_ID, item(0x04, bytes(range(200)))),
        "SIGNATURE": item(0x30, number(BIG[0]), number(BIG[1])),
    }
    for label, data in others.items():
        text = base64.b64encode(data).decode()
        block = f"-----BEGIN {label}-----\n" + "\n".join(re.findall(".{1,64}", text)) + f"\n-----END {label}-----"
        assert not secrets.spans_of(text) and not secrets.spans_of(block), label


def test_encrypted_blocks_and_openssh_keys():
    text = base64.b64encode(bytes(range(64))).decode()
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{head}{text}\n-----END RSA PRIVATE KEY-----"
    assert [(k, f) for k, _, _, _, f in secrets.spans_of(block)] == [("pem", "encrypted")]
    for old, new in (("4,ENCRYPTED", "4,CLEAR"), ("AABBCCDDEEFF", "XY"), ("RSA PRIVATE", "RSA PUBLIC"), (text, text[:40])):
        assert not secrets.spans_of(block.replace(old, new)), new
    good = ssh(b"none", b"none", b"")
    assert secrets.key_form(good) == "openssh" and secrets.key_form(ssh(b"a", b"b", b"c", keys=2)) == "openssh"
    for bad in (good[:-1], good + b"x", ssh(b"none", b"none"), ssh(b"n", b"n", b"", keys=0), ssh(b"n", b"n", b"", private=b"")):
        assert secrets.key_form(bad) is None
    assert not secrets.spans_of("-----BEGIN X-----" + "Aa-:b" * 20_000)


def test_secret_rows_against_plain_patterns(spark):
    texts = [
        None, "", "token=abcde", "TOKEN = abcdef", "api_key:'zzzzzz' apikey=1234567", "AKIA" + "Z" * 15,
        "AKIAAKIA" + "9" * 20, "x" + "a1" * 12 + "g" + "b" * 23, "paſsword=abcdef", "secret" * 5 + "=" + "q" * 9,
        "passwd=" * 3000 + "abcdef", prose(3, 20_000) + " token: 0123456789abcdef01234567",
    ]
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])], clashing=True)
    out = secrets.find_secrets(docs)
    assert out.count() == len(texts) + 2 and set(docs.columns) <= set(out.columns)
    got = rows_by_id(secrets.secret_scan_query(docs).filter("doc_id is not null"))
    for i, text in enumerate(texts):
        text = text or ""
        found = [("assign", m) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        order = ("assign", "access", "hex")
        found.sort(key=lambda f: (f[1].start(), order.index(f[0])))
        listed = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text[:80]
        assert got[i]["n_assign"] == sum(k == "assign" for k, _ in found)
    assert secrets.secret_scan_query(documents(spark, [])).count() == 0


def plain_lines(rows, min_chars=10, min_docs=2):
    """What is left of each text, in plain Python."""
    blanks = " \t\n\x0b\f\r"
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held: dict[str, set] = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(line.strip(blanks).translate(upper), set()).add(2**63 if i is None else i)
    out = []
    for i, text in rows:
        i = 2**63 if i is None else i
        own = (text or "").split("\n")
        kept = [
            x
            for x in own
            if len(k := x.strip(blanks).translate(upper)) < min_chars or len(held[k]) < min_docs or min(held[k]) == i
        ]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_against_plain_python(spark, min_docs):
    shared = "A line that many documents share"
    rows = [(i, f"own {i} {prose(i, 5)}\n  {shared.upper() if i % 2 else shared}\t\nshort\n{shared}") for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, shared), (54, f"{shared}\n{shared}"), (None, f"{shared}\nx")]
    rows += [(7, rows[7][1]), (None, f"only here without id\n{shared}"), (55, "ä" * 9), (56, "ä" * 9)]
    rows += [(57, "Ä" * 12), (58, "ä" * 12), (59, "\n".join(f"line number {k % 700}" for k in range(20_000)))]
    rows += [(60, "line number 5\nline number 6"), (61, "line number 6\r\nend")]
    docs = documents(spark, rows, clashing=True)
    out = lines.drop_repeated_lines(docs, min_docs=min_docs)
    assert set(docs.columns) <= set(out.columns)
    got = sorted(
        (2**63 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect()
    )
    assert got == plain_lines(rows, min_docs=min_docs)
    assert lines.drop_repeated_lines(documents(spark, [])).count() == 0


def test_line_plan_has_no_python(spark):
    df = lines.drop_repeated_lines(documents(spark, [(1, "a"), (2, "b")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.find("Scan")]
    assert "Python" not in after and "Arrow" not in after and "Pandas" not in after
