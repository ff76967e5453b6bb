import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidelog.llm import langid
from tidelog.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id bigint, text string, lang string"


def test_held_out_accuracy(spark):
    out = QUERIES["op5_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert len(rows) > 1000
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)
    assert out.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).isEmpty()


def every_cut(word):
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        yield [word[a:b] for a, b in zip(at[:-1], at[1:])]


def test_forward_pass_sums_all_segmentations():
    vocabulary = langid.Vocabulary([b"ab", b"abc", b"bc", b"ca", b" a"])
    rng = np.random.default_rng(1)
    table = np.vstack([rng.random((vocabulary.size, 2)) / 300, np.zeros((1, 2))])
    words = [b"abcab", b" abca", b"zz", b"a"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = langid.scores(data, ends - [len(w) for w in words], ends, vocabulary, table)

    def number(piece):
        raw = np.frombuffer(piece, np.uint8)
        return int(vocabulary.find(langid.hashes(raw, np.array([0]), np.array([len(raw)]), lower=False))[0])

    for word, row in zip(words, got):
        for language in range(2):
            total = sum(math.prod(table[number(p), language] for p in cut) for cut in every_cut(word))
            assert row[language] == pytest.approx(math.log(total))


def test_learning_raises_the_likelihood():
    vocabulary = langid.Vocabulary([b"the", b" the", b"ing", b"th", b"he"])
    words, counts = [b" the", b"thing", b" he"], np.array([50.0, 20, 5])
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    learned = langid.fit(words, counts, vocabulary)
    flat = np.full(vocabulary.size, 1 / vocabulary.size)
    value = [counts @ langid.scores(data, ends - [len(w) for w in words], ends, vocabulary, np.append(p, 0)[:, None])[:, 0]
             for p in (flat, learned)]
    assert value[1] > value[0] and learned.sum() == pytest.approx(1)


def test_words_are_cut_and_scored_whole():
    data = np.frombuffer(("a b" + "x" * 60 + " cd").encode(), np.uint8)
    starts, ends, edges = langid.units(data, np.array([0, 3, len(data)]))
    assert b"".join(data[s:e].tobytes() for s, e in zip(starts, ends)) == data.tobytes()
    assert (ends - starts).max() == langid.UNIT and edges.tolist() == [0, 2, len(starts)]


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(40)] + [(i, "el gato y la perra " * 3, "es") for i in range(40, 80)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 34 !", "es"), (None, "the dog", "en"), (103, "la perra", None),
           (103, "la perra", None), (104, "the dog and " * 20_000, "en")]
    frame = spark.createDataFrame(rows + odd, SCHEMA).withColumn("lang_pred", F.lit("old"))
    out = langid.identify(frame, langid.learn(frame, langid.public_vocabulary()))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"]
    got = {(r.doc_id, r.lang_pred, r.lang_score > 0.5) for r in out.collect() if r.doc_id is None or r.doc_id >= 100}
    assert got == {(100, "und", False), (101, "und", False), (102, "und", False), (None, "en", True), (103, "es", True),
                   (104, "en", True)}
    report = langid.language_report(frame).collect()
    assert len(report) == len(rows + odd) and not [r for r in report if r.doc_id is None and r.held_out]


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "words", None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in langid.language_report(frame).collect()] == [("und", 0.0)]
    assert langid.language_report(frame.limit(0)).collect() == []


def test_prediction_does_not_look_at_labels(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(frame, langid.public_vocabulary())
    a = langid.identify(frame, model).select("doc_id", "lang_pred", "lang_score").collect()
    b = langid.identify(frame.withColumn("lang", F.lit("xx")), model).select("doc_id", "lang_pred", "lang_score").collect()
    assert sorted(a) == sorted(b)
    assert pa.array([r.lang_pred for r in a]).null_count == 0


def test_languages_of_long_documents_are_learned(spark):
    short = [(i, "the cat and the dog went to the house with a friend", "en") for i in range(1, 30)]
    long = [(i, "der Hund und die Katze gingen zum Haus mit einem Freund " * 400, "de") for i in range(30, 60)]
    assert all(len(text) > langid.SAMPLE_CHARS for _, text, _ in long)
    docs = spark.createDataFrame(short + long, SCHEMA)
    model = langid.learn(docs, langid.public_vocabulary())
    assert model.languages == ["de", "en"]
    counts = {r["lang"]: r["count"] for r in docs.where(langid.bucket() != 0).groupBy("lang").count().collect()}
    assert np.exp(model.priors) == pytest.approx([counts["de"] / sum(counts.values()), counts["en"] / sum(counts.values())])
    (row,) = langid.identify(spark.createDataFrame([(99, "die Katze und der Hund", None)], SCHEMA), model).collect()
    assert row.lang_pred == "de"
