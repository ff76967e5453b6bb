import hashlib
import random

from tidelog.llm import fingerprints as f
from tidelog.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string"


def plain(tokens):
    """Chosen (hash, position) pairs from token hashes, window by window."""
    if not tokens:
        return []
    if len(tokens) < f.K:
        return None
    grams = [sum(t * pow(f.BASE, f.K - 1 - j, f.PRIME) for j, t in enumerate(tokens[i:i + f.K])) % f.PRIME
             for i in range(len(tokens) - f.K + 1)]
    width = min(f.WINDOW, len(grams))
    chosen = []
    for i in range(len(grams) - width + 1):
        least = min(grams[i:i + width])
        pair = (least, max(j for j in range(i, i + width) if grams[j] == least))
        if not chosen or chosen[-1] != pair:
            chosen.append(pair)
    return chosen


def test_winnowing_against_plain_version(spark):
    texts = ["", "one two", "a b c d", "x " * 100, " ".join(str(i * 7919 % 23) for i in range(300)),
             "日本語のテキスト" * 30, "Word, word! " * 40 + "end"]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    tokens = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(f.TOKEN), F.lit(0)), f._token_hash)
    rows = f.fingerprints(frame).withColumn("tokens", tokens).collect()
    for r in rows:
        got = [(x >> 32, f.POSITIONS - 1 - x % f.POSITIONS) for x in r.fingerprint]
        expected = plain(r.tokens)
        assert len(got) == 1 if expected is None else got == expected


def likeness(a, b):
    a, b = ({p.split("@")[0] for p in x.split(",") if p} for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_report_against_plain_version(spark):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in QUERIES["op4_fingerprints"](spark, SF).collect()}
    assert len(rows) == len(docs)
    by_text = {}
    for i, (d, text) in enumerate(docs):
        after, following = docs[(i + 1) % len(docs)]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        r = rows[d]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert r.near_next == likeness(r.fingerprint, rows[after].fingerprint)
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint)
        if edited == text:
            assert r.edited_fingerprint == r.fingerprint
    assert sum(r.near_edited for r in rows.values()) / len(rows) > 0.25
    assert sorted(r.near_next for r in rows.values())[len(rows) // 2] < 0.05


def test_shared_passage_shares_a_hash(spark):
    passage = " ".join(f"w{i}" for i in range(f.K + f.WINDOW - 1))
    frame = spark.createDataFrame([(1, f"a b c {passage} d e"), (2, "z " * 30 + passage)], SCHEMA)
    a, b = (set(r.h) for r in f.fingerprints(frame).select(f.hashes(F.col("fingerprint")).alias("h")).collect())
    assert a & b


def report(spark, rows, schema=SCHEMA):
    return f.fingerprint_report(spark.createDataFrame(rows, schema))


def test_odd_rows(spark):
    long = "word " * 60_000
    rows = [(None, "null id", 1), (7, None, 1), (7, "", 1), (3, "same text", 1), (3, "same text", 1), (2, long, 1)]
    out = report(spark, rows, "doc_id bigint, text string, cell int").collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in out) == sorted(
        [("None", 7), ("7", 0), ("7", 0), ("3", 9), ("3", 9), ("2", 300_000)])
    assert {r.fingerprint for r in out if r.n_chars == 0} == {""}
    same = [r for r in out if r.doc_id == 3]
    assert {r.near_next for r in same} == {1.0, 0.0}  # one is followed by the other, that by the long one
    assert report(spark, []).collect() == []


def test_single_document_follows_itself(spark):
    (r,) = report(spark, [(5, "alpha beta gamma delta")]).collect()
    assert r.near_next == 1.0
    text = "alpha beta gamma delta"
    assert r.edited_sha256 == hashlib.sha256((text[:11] + text[:11]).encode()).hexdigest()


def test_no_python_on_the_main_path(spark):
    plan = QUERIES["op4_fingerprints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    assert plan.count("Exchange hashpartitioning") == 1


def test_ids_beyond_doubles(spark):
    rng = random.Random(5)
    ids = [2**62 + 37 * i for i in range(150)] + [rng.randrange(-2**63, 2**63) for _ in range(150)] + [2**63 - 1 - i for i in range(9)]
    ids = sorted(set(ids), reverse=True)
    frame = spark.createDataFrame([(i, f"text of {i}") for i in ids], SCHEMA)
    for cells in (3, 40):
        got = {r.doc_id: r.next_text for r in f.with_next(frame, cells).collect()}
        assert got == {d: f"text of {ids[(n + 1) % len(ids)]}" for n, d in enumerate(ids)}
