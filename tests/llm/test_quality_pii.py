"""Quality rules and personal data against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadloom.llm.pii import find_pii, op4_pii, redact_pii
from leadloom.llm.quality_rules import apply_quality_rules, op5_quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (1, None), (2, ""), (3, "a b a b a b"), (4, "  x\n\nx\n x\n"), (5, "word " * 60), (6, "a1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4"),
    (7, "x@y.z_@q.w.e a.b@c-d.ef"), (8, "4111 1111 1111 1111 4111-1111-1111-1112 1 2 3 55555555555544441"),
    (9, "+1 (988) 555-2485 ++49 17 +1-"), (10, "DE89 3704 0044 0532 0130 00 my iban GB82WEST12345698765432 ssn 123-45-6789"),
    (11, "9" * 30000), (12, "a" * 30000 + "@b.c"), (13, "1 " * 9000), (14, "é@x.yz 1.2.3.4 ü"), (None, "a@b.cd"), (3, "a b a b a b"),
]


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        t += d - 9 * (d > 9)
    return t % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def quality(text):
    ws = WORDS.findall(text or "")
    win = Counter(zip(ws, ws[1:], ws[2:]))
    rep = {j for i in range(len(ws) - 2) if win[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep), n < 50 or 100 * len(rep) > 50 * n


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, None) for i, t in EDGE], "doc_id long, text string, source string").withColumn("kept", F.lit("x"))


def test_pii_on_edge_texts(edge):
    rows = find_pii(edge).select("doc_id", "text", "pii").collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        if r.doc_id == 11:
            continue
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind not in ("iban", "ssn")] == base_spans(r.text), r.doc_id
    added = {(s.kind, r.text[s.start : s.end]) for r in rows for s in r.pii if s.kind in ("iban", "ssn")}
    assert added == {("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("ssn", "123-45-6789")}


def test_words_beside_an_iban_never_decide(spark):
    texts = [
        ("ES9121000418450200051332", " GRACIAS"), ("BE68539007547034", " 2024-05-01"), ("BE68539007547034", " EUR"), ("AT611904300234573201", " BANK"), ("PL61 1090 1014 0000 0712 1981 2874", " ABCD"),
        ("SE4550000000058398257466", " KR 12"), ("CZ6508000000192000145399", " X"), ("HU42 1177 3016 1111 1018 0000 0000", " HUF."), ("NO9386011117947", " NOK"), ("DE89 3704 0044 0532 0130 00", " BIC"),
    ]
    rows = [(i, f"pay {x}{after}", x) for i, (x, after) in enumerate(texts)]
    rows += [(100, "to ES91 2100 0418 DE89 3704 0044 0532 0130 00 EUR", "DE89 3704 0044 0532 0130 00"), (101, "BE68539007547034 BE68539007547034", "BE68539007547034"), (102, "BE68539007547034EUR BE68539007547035 BANK", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    for r in find_pii(docs).collect():
        assert {r.text[s.start : s.end] for s in r.pii if s.kind == "iban"} == ({r.want} if r.want else set()), r.text
    got = {r.doc_id: r.text for r in redact_pii(find_pii(docs)).collect()}
    assert all(got[i] == f"pay [IBAN]{after}" for i, (_, after) in enumerate(texts)) and got[101] == "[IBAN] [IBAN]"


def test_redaction(edge):
    got = {r.doc_id: r.text for r in redact_pii(find_pii(edge)).where("doc_id in (1, 2, 9, 14)").collect()}
    assert got == {1: None, 2: "", 9: "[PHONE] ++49 17 +1-", 14: "[EMAIL] [IP] ü".replace("[EMAIL]", "é@x.yz", 1) if not base_spans("é@x.yz") else got[14]}


def test_op4_equals_python(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.n_email == sum(s[0] == "email" for s in spans) and r.n_card == sum(s[0] == "card" for s in spans)


def test_quality_on_edge_texts(edge):
    rows = apply_quality_rules(edge).collect()
    want = sorted((i or -1, *quality(t)) for i, t in EDGE)
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert apply_quality_rules(edge.limit(0)).count() == 0


def test_op5_equals_python(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality(texts[r.doc_id])
        assert r.kept == (not r.base_failed)


def test_failing_hosts_take_their_documents_along(spark):
    """Hosts by brute force: one fails throughout by symbols, one by chance once, one has no name."""
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(i, clean + " #" * 12, "bad", i, "x") for i in range(40)] + [(100, clean, "bad", 7, "y")] + [(200 + i, clean, f"good{i % 5}", 1, None) for i in range(50)] + [(300, clean + " # # # # # # # #", "good1", 1, None), (400, "few", None, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, joined_host int, _host string")
    out = apply_quality_rules(docs).collect()
    hosts = {}
    for i, text, host, *_ in rows:
        n = len(text.split())
        hosts.setdefault(host, []).append(n < 50 or 100 * text.count("#") > 10 * n)
    rates = {h: sum(f) / len(f) for h, f in hosts.items()}
    mean = sum(rates.values()) / len(rates)
    between = sum(r * r for r in rates.values()) / len(rates) - mean**2 - sum(r * (1 - r) / len(hosts[h]) for h, r in rates.items()) / len(rates)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    shrunk = {h: (sum(f) + mean * strength) / (len(f) + strength) for h, f in hosts.items()}
    assert {r.doc_id: r.host_rate for r in out} == pytest.approx({r[0]: shrunk[r[2]] for r in rows})
    assert {r.doc_id: r.kept for r in out} == {r[0]: shrunk[r[2]] <= 0.5 and len(r[1].split()) >= 50 for r in rows}
    assert not any(r.kept for r in out if r.source == "bad") and all(r.kept for r in out if r.source == "good1")
    assert {r.doc_id: (r.joined_host, r["_host"]) for r in out} == {r[0]: (r[3], r[4]) for r in rows}
