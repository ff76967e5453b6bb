import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tidelog.llm import substring_dedup as s
from tidelog.llm.queries import QUERIES
from tidelog.llm.words import hashes, mix

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string"


def sentences(text):
    """(first byte, words) of each sentence, word by word."""
    raw, out, new, at = (text or "").encode(), [], True, 0
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw):
        if new or b"\n" in raw[at:m.start()]:
            out.append([])
        out[-1].append((m.start(), m[0].lower()))
        at = m.end()
        new = m[0][-1:] in (b".", b"!", b"?") or m[0].endswith("。".encode())
    return [(part[0][0], [w for _, w in part]) for whole in out for part in parts_of(whole)]


def rank(word):
    data = np.frombuffer(word, np.uint8)
    return int(mix(hashes(data, np.array([0]), np.array([len(data)])))[0])


def parts_of(words):
    """A long sentence, cut before least words, and by length where there are none."""
    if len(words) <= s.LONGEST:
        return [words]
    ranks, cuts = [rank(w) for _, w in words], [0]
    for i in range(s.NEAR, len(words)):
        if all(ranks[i] < r for r in ranks[i - s.NEAR:i]) and all(ranks[i] <= r for r in ranks[i + 1:i + 1 + s.NEAR]):
            cuts.append(i)
    return [words[j:min(j + s.LONGEST, b)] for a, b in zip(cuts, [*cuts[1:], len(words)]) for j in range(a, b, s.LONGEST)]


def enough(parts):
    return len(parts) >= s.RUN and sum(len(w) for _, w in parts) >= s.MIN_WORDS


def plain_spans(text):
    """(sentence, one past the last, words) of each span."""
    raw, parts = (text or "").encode(), sentences(text)
    out = set()
    for i in range(len(parts)):
        out |= {(i, j) for j in [next((j for j in range(i, len(parts) + 1) if enough(parts[i:j])), None)] if j}
    for j in range(1, len(parts) + 1):
        if j == len(parts) or b"\n" in raw[parts[j - 1][0]:parts[j][0]]:
            out |= {(i, j) for i in [next((i for i in range(j, -1, -1) if enough(parts[i:j])), None)] if i is not None}
    return [(i, j, tuple(w for _, ws in parts[i:j] for w in ws)) for i, j in sorted(out)]


def plain(docs):
    """{doc_id: (first docs, sentences, removed, text)} of (doc_id, text) pairs with distinct ids."""
    first, out = {}, {}
    for d, text in sorted(docs):
        gone, firsts, seen = set(), set(), set()
        for i, j, words in plain_spans(text):
            owner = first.setdefault(words, d)
            if owner != d or words in seen:
                gone.update(range(i, j))
                firsts.add(owner)
            seen.add(words)
        if gone:
            raw = text.encode()
            edges = [0, *(b for b, _ in sentences(text)[1:]), len(raw)]
            kept = b"".join(raw[edges[k]:edges[k + 1]] for k in range(len(edges) - 1) if k not in gone)
            out[d] = (sorted(firsts), len(edges) - 1, len(gone), kept.decode())
    return out


def got(frame):
    return {r.doc_id: (r.first_docs, r.n_sentences, r.n_removed, r.text) for r in frame.collect()}


def test_against_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = plain(docs)
    assert got(QUERIES["op3_substring_dedup"](spark, SF)) == expected
    assert len(expected) > 100


def made(seed, n=80):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 30))) + rng.choice([".", "!", "?", "。", ""])
            for _ in range(300)]
    passages = [" ".join(rng.choice(pool) for _ in range(6)) for _ in range(4)]
    docs = []
    for d in range(n):
        parts = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        for p in rng.sample(passages, rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randint(0, len(parts)), p)
        docs.append((d, rng.choice(["\n", " ", "  \t"]).join(parts)))
    return docs


def test_passages_within_texts(spark):
    docs = made(4)
    expected = plain(docs)
    assert expected and got(s.remove_repeats(spark.createDataFrame(docs, SCHEMA))) == expected


def test_removed_stretches_are_code_points(spark):
    passage = ("é" * 5 + " ein Satz mit sehr vielen Wörtern. Noch ein Satz mit vielen Wörtern. Ein dritter Satz mit Wörtern, "
               "der nun folgt.")
    docs = [(1, passage), (2, "Größe davor. " + passage + " Danach ist es aus.")]
    (row,) = s.repeat_report(spark.createDataFrame(docs, SCHEMA)).collect()
    start, end = map(int, row.removed.split(":"))
    assert docs[1][1][start:end].strip() == passage and row.text == "Größe davor. Danach ist es aus."


def test_every_passage_over_fifty_words_has_five_sentences():
    for n in (51, 60, 77):
        for stops in (0, 3, 9):
            words = [f"w{i}" + ("." if stops and i % (n // stops) == 0 else "") for i in range(n)]
            assert len(s.Sentences(pa.array([" ".join(words)])).first) >= 5


@pytest.mark.parametrize("stops", [0, 2, 5])
def test_passages_at_any_word(spark, stops):
    """A passage after some words of one sentence in one text, after others in another, with more words behind it."""
    rng = random.Random(stops)

    def words(n, low, high):
        return [f"w{rng.randrange(low, high)}" for _ in range(n)]

    docs, planted, n = [], {}, 200
    for i in range(n):
        passage = [w + ("." if stops and j % (60 // stops) == 7 else "") for j, w in enumerate(words(60, 0, 5_000))]
        for copy in range(2):
            before, after = words(rng.randint(0, 30), 5_000, 9_000), words(rng.randint(0, 30), 5_000, 9_000)
            docs.append((2 * i + copy, " ".join([*before, *passage, *after])))
            planted[2 * i + copy] = (len(before), len(after))
    docs += [(2 * n + i, " ".join(w + rng.choice(["", "", ".", "\n"]) for w in words(rng.randint(20, 120), 0, 9_000))) for i in range(n)]
    texts, found = dict(docs), {r.doc_id: r for r in s.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert set(found) <= {2 * i + 1 for i in range(n)} and len(found) >= 0.99 * n  # first copies and clean texts stay
    gone = [len(texts[d].split()) - len(r.text.split()) for d, r in found.items()]
    assert sum(gone) >= 0.75 * 60 * n and min(gone) >= 20
    assert sum(g > 60 for g in gone) == 0


def test_a_hot_passage_is_dealt_over_tasks(spark):
    passage = " ".join(f"w{i}" + ("." if i % 9 == 8 else "") for i in range(60))
    docs = [(i, f"{passage}\nown words of document {i}") for i in range(400)] + [(400 + d, t) for d, t in made(8)]
    frame = spark.createDataFrame(docs, SCHEMA)
    expected = plain(docs)
    assert len(expected) > 400 and got(s.remove_repeats(frame)) == expected
    spans = s._spans(frame.select(s.F.col("doc_id").alias("id"), s.F.col("text").alias("t")), again=False)
    common = spans.groupBy(s.F.col("h").alias("k")).agg(s.F.min("id").alias("first"), s.F.count("*").alias("n")).where("n > 1")
    hot = s._hot(common)
    assert 0 < hot.count() <= 4 * 8 and hot.agg(s.F.min("parts")).first()[0] >= 2
    shares, salted = s._salted(common, hot)
    most = shares(spans).groupBy("h", "salt").count().agg(s.F.max("count")).first()[0]
    assert most < 200 and salted.count() <= common.count() + 8 * 8


def test_equal_words_are_cut_by_length():
    t = s.Sentences(pa.array(["x " * 40, "x y " * 40]))
    assert t.first[:4].tolist() == [0, 12, 24, 36] and max(np.diff(np.append(t.first, 120))) <= s.LONGEST


def test_odd_rows(spark):
    text = ("one two three four five six. seven eight nine ten eleven twelve thirteen. fourteen fifteen sixteen seventeen. "
            "eighteen nineteen twenty thirty. forty.")
    rows = [(1, None, 0), (2, "", 0), (3, text, 0), (3, text, 0), (3, "other words", 0), (None, text, 0), (4, text, 0), (5, "x " * 40_000, 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, h int")
    out = sorted((str(r.doc_id), r.first_docs, r.n_removed, r.text) for r in s.remove_repeats(frame).collect())
    assert [(d, f) for d, f, *_ in out] == [("4", [3]), ("5", [5]), ("None", [3])]
    assert out[0][3] == "" and out[2][3] == "" and set(out[1][3].split()) == {"x"}
    assert s.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
