import random
import re

import pytest
from pyspark.sql import functions as F
from tidelog.llm import license_scan as ls
from tidelog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string"
RULES = (ls.TEMPLATES, ls.PHRASES)


def pattern(markup):
    """A template as a regular expression over words that each end with a blank."""
    def wording(text):
        return "".join(re.escape(w) + " " for w in ls.words_of(text))

    out = ""
    for part in ls._MARKS.split(markup):
        if part in ("[[", "]]"):
            out += {"[[": "(?:", "]]": ")?"}[part]
        elif part.startswith("<<"):
            rule = part[2:-2].partition(":")[2]
            bounds = re.fullmatch(r"(\d+)-(\d+)", rule)
            out += rf"(?:\S+ ){{{bounds[1]},{bounds[2]}}}" if bounds else "(?:" + "|".join(map(wording, rule.split("|"))) + ")"
        else:
            out += wording(part)
    return re.compile(out)


PATTERNS = [(label, pattern(markup)) for label, markup in ls.TEMPLATES]


def longest(regex, text, at):
    """End of the longest match from a place: the pattern is tried on ever shorter texts."""
    ends = [m.start() + 1 for m in re.finditer(" ", text[at:])]
    if not regex.match(text, at):
        return None
    return next(at + e for e in reversed(ends) if regex.fullmatch(text, at, at + e))


def plain(text):
    """The report's columns by regular expressions."""
    words = ls.words_of(text or "")
    joined, starts = " ".join(words) + " ", [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    index = {s: i for i, s in enumerate(starts)}
    base = sorted((i, i + len(p.split()), label) for label, p in ls.PHRASES for i in range(len(words))
                  if words[i:i + len(p.split())] == p.split())
    spans, ended = [], {}
    for i, at in enumerate(starts[:-1]):
        ends = {}
        for label, regex in PATTERNS:
            if words and (end := longest(regex, joined, at)):
                ends[label] = max(ends.get(label, 0), index[end])
        for label, end in ends.items():
            if i >= ended.get(label, 0):
                ended[label] = end
                spans.append((i, end, label))
    inside = {j for a, b, _ in base + spans for j in range(a, b)}
    labels = [",".join(sorted({x[2] for x in some})) for some in (base, base + spans)]
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, *labels,
            len(inside) / len(words) if words else 0.0, ",".join(f"{x}:{a}:{b}" for a, b, x in sorted(spans, key=lambda s: s[0])))


def same(row, expected):
    got = tuple(row)[1:]
    assert got[:6] == expected[:6] and got[6] == pytest.approx(expected[6], abs=1e-12)
    assert sorted(got[7].split(",")) == sorted(expected[7].split(","))


def report(spark, rows):
    return ls.license_report(spark.createDataFrame(rows, SCHEMA))


def test_report_against_regular_expressions(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_license_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    hints = re.compile(r"(?i)licen|spdx|cc|gnu|permission|redistribution|unencumbered")
    for r in rows:
        text = texts[r.doc_id]
        if hints.search(text) and len(text) < 20_000:
            same(r, plain(text))
        elif not hints.search(text):
            assert (r.n_words, r.n_base, r.labels, r.score) == (len(ls.words_of(text)), 0, "", 0.0)
    found = {label for r in rows for label in r.labels.split(",")}
    assert {"gpl", "gpl-3.0", "apache", "apache-2.0", "cc-by", "cc-by-nc-4.0", "mit"} <= found


def instances(markup, rng):
    """A text that a template accepts."""
    out, skip, depth = [], None, 0
    for part in ls._MARKS.split(markup):
        if part == "[[":
            depth += 1
            if skip is None and rng.random() < 0.5:
                skip = depth
        elif part == "]]":
            if skip == depth:
                skip = None
            depth -= 1
        elif skip is None:
            if part.startswith("<<"):
                rule = part[2:-2].partition(":")[2]
                bounds = re.fullmatch(r"(\d+)-(\d+)", rule)
                part = " ".join(rng.choice(["Jane", "Doe", "the", "Software", "2020"]) for _ in range(rng.randint(*map(int, bounds.groups())))
                                ) if bounds else rng.choice(rule.split("|"))
            out += ls.words_of(part)
    return out


def test_every_template_accepts_its_instances_and_no_altered_wording(spark):
    rng = random.Random(4)
    rows, expected = [], []
    for label, markup in ls.TEMPLATES:
        for turn in range(4):
            words = instances(markup, rng)
            if turn == 3:  # one mandatory word is altered: the regular expression decides
                words[rng.randrange(len(words))] = "altered"
            text = "Some words before; " + "".join(w.upper() + rng.choice([" ", "\n", ", ", " (", "-"]) for w in words) + " and after"
            rows.append((len(rows), text))
            expected.append(label if turn < 3 else None)
    for r in report(spark, rows).collect():
        same(r, plain(rows[r.doc_id][1]))
        assert expected[r.doc_id] is None or expected[r.doc_id] in r.labels.split(",")


def test_random_words(spark):
    rng = random.Random(5)
    pool = [w for _, t in ls.TEMPLATES[-24:] + ls.TEMPLATES[8:13] for w in ls.words_of(re.sub(r"<<\w+:|\|", " ", t))] + ["x", "Ünder"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    for r in report(spark, rows).collect():
        same(r, plain(rows[r.doc_id][1]))


def test_odd_rows(spark):
    long = "filler words " * 40_000 + "MIT License. " + "mit " * 20_000
    rows = [(None, "MIT License"), (1, None), (1, ""), (2, "..."), (3, "mit"), (3, "mit"), (4, long), (5, "ſ MIT\x00licenſe MIT LICENSE"),
            (6, "mit"), (7, "license")]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1).select("*", F.lit(1).alias("k"), F.lit(2).alias("t"), F.lit("a").alias("labels"))
    out = ls.license_report(frame).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.n_words): r for r in out}
    assert by[None, 2].labels == "mit" and by[None, 2].score == 1.0
    assert by[1, 0].labels == "" and by[1, 0].score == 0.0 and by[1, 0].first_word is None
    assert (by[4, 100_002].n_base, by[4, 100_002].first_word) == (1, 80_000)
    assert (by[5, 5].n_base, by[5, 5].first_word) == (1, 3)
    assert by[6, 1].n_base == by[7, 1].n_base == 0  # no phrase reaches from one text into the next
    assert report(spark, []).collect() == []


@pytest.mark.parametrize("markup", ["[[only optional]]", "<<any:0-3>>", "[[open", "shut]]", ""])
def test_bad_templates(markup):
    with pytest.raises(ValueError):
        ls.Automaton([("x", markup)])


def test_words_of_equal_hash_are_compared(monkeypatch):
    """With a hash that is the same for all words, only bytes tell them apart."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(ls, "hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    automaton = ls.Automaton([], [("x", "same")])
    words = ls.Words(automaton, pa.array(["same other SAME", "else"]))
    assert list(ls._places(automaton, words)) == [(0, "x", 0, 1), (0, "x", 2, 3)]
