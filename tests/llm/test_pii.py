import random

import brute
import pytest
from tidelog.llm import pii
from tidelog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string"


def base(text):
    return [s for s in pii.find(text, ANCHORS) if s[2] in pii.BASE]


ANCHORS = pii.automaton()


def test_report_against_patterns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_pii"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute.personal_data(docs[r.doc_id])
        counts = [sum(s[2] == k for s in spans) for k in pii.BASE]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{s}:{e}" for s, e, k in spans))
        assert [x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE] == [f"{k}:{s}:{e}" for s, e, k in spans]
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 50


def test_random_texts_against_patterns():
    rng = random.Random(3)
    parts = ["@", "+", ".", "-", " ", "(", ")", "1", "23", "4111 1111 1111 1111", "10.0.0.1", "300.1.2.3.4", "a", "b.c",
             "é", "x@y.z", "%_", "\n", "0", "+1 (2", "999", "a@b@c.d"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert base(text) == brute.personal_data(text), text


@pytest.mark.parametrize("text, kind, value", [
    ("see https://a.example/x?y=1, then", "url", "https://a.example/x?y=1"),
    ("www.example.org.", "url", "www.example.org"),
    ("IBAN: DE89 3704 0044 0532 0130 00 is mine", "account", "DE89 3704 0044 0532 0130 00"),
    ("account no. 12345678", "account", "12345678"),
])
def test_added_spans(text, kind, value):
    assert [text[s:e] for s, e, k in pii.find(text, ANCHORS) if k == kind] == [value]


def test_no_account_without_a_number():
    assert not [s for s in pii.find("an account of events, accountable since 1999", ANCHORS)]


def test_mask():
    text = "a x@y.de b"
    assert pii.mask(text, pii.find(text, ANCHORS)) == "a <email> b"


def test_odd_rows(spark):
    rows = [(1, None, "n"), (2, "", "n"), (None, "x@y.de", "n"), (3, "z " * 50_000 + "x@y.de", "n"), (3, "x@y.de", "n"), (3, "x@y.de", "n")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = sorted((str(r.doc_id), r.n_email) for r in pii.personal_data_report(frame).collect())
    assert got == [("1", 0), ("2", 0), ("3", 1), ("3", 1), ("3", 1), ("None", 1)]
    assert pii.personal_data_report(spark.createDataFrame([], SCHEMA)).collect() == []
