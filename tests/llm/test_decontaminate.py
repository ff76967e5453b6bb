import random

import duckdb
import pyarrow as pa
from tidelog.llm import decontaminate as d
from tidelog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def found(frame):
    return {(r.doc_id, r.item_id) for r in frame.collect()}


def test_whole_items_are_found_and_nothing_else(spark):
    con = duckdb.connect()
    whole = con.sql(f"SELECT doc_id, item_id FROM '{SF}/documents.parquet' x, '{SF}/benchmark.parquet' b "
                    "WHERE contains(x.text, b.text)").fetchall()
    part = con.sql(f"SELECT doc_id, item_id FROM '{SF}/documents.parquet' x, '{SF}/benchmark.parquet' b "
                   "WHERE contains(x.text, b.text[20:60])").fetchall()
    got = found(QUERIES["op10_decontaminate"](spark, SF))
    assert set(whole) <= got <= set(part) and whole


QUESTION = ("At the market Alice buys 12 apples and 7 kg of pears. Later Alice gives Bob 5 apples because Bob asked for them. "
            "How many apples does she have left now?")


def frames(spark, texts, items=(QUESTION,)):
    return spark.createDataFrame(list(enumerate(texts)), DOCS), spark.createDataFrame(list(enumerate(items)), ITEMS)


def test_other_numbers_names_and_units(spark):
    other = QUESTION.replace("Alice", "Zoé").replace("Bob", "Karl").replace("12", "40").replace("kg", "lb").replace("7", "eight")
    rows = {r.doc_id: r for r in d.leaks(*frames(spark, [f"Some text before. {other} And after.", QUESTION, "nothing here"])).collect()}
    assert set(rows) == {0, 1}
    assert rows[1].exact and not rows[0].exact and rows[0].n_consistent == rows[0].n_slots > 3


def test_slots_must_be_consistent(spark):
    broken = "At the market Ann buys 1 apples and 7 kg of pears. Later Eve gives Tom 5 apples because Max asked for them. How many"
    assert found(d.leaks(*frames(spark, [broken]))) == set()


def plain_tokens(text):
    """(kind or word) of each token, by the rules in the module's text."""
    out, opens, number = [], True, False
    for line in text.split("\n"):
        opens = True
        for word in line.split():
            core = word
            for _ in range(3):
                core = core[:-1] if len(core) > 1 and core[-1] in ".,;:!?()[]{}\"'*#&$%<>" else core
                core = core[1:] if len(core) > 1 and core[0] in ".,;:!?()[]{}\"'*#&$%<>" else core
            if len(core) == 1 and core in ".,;:!?()[]{}\"'*#&$%<>":
                opens = word[-1] in ".!?:"
                continue
            low = core.lower() if core.isascii() else "".join(c.lower() if c.isascii() else c for c in core)
            is_number = core[0].isdigit() or core[0] in "+-" and core[1:2].isdigit() or low in d.NUMBERS
            name = core[0].isupper() and core[1:2].islower()
            kind = "N" if is_number else "U" if number and low in d.UNITS else "P" if name and not opens else low
            out.append(kind)
            number, opens = is_number, word[-1] in ".!?:"
    return out


def test_tokens_against_plain_rules():
    rng = random.Random(9)
    parts = ["Alice", "the", "12", "kg", "Été", "été", "-3", "five", "miles", "x.", "End!", "(Bob)", "'", "A", "ÉTÉ", "3.5%,", "km"]
    for _ in range(500):
        text = " ".join(rng.choice(parts) + rng.choice(["", "", "\n"]) for _ in range(rng.randint(1, 15)))
        t, expected = d.Templates(pa.array([text])), plain_tokens(text)
        assert [{0: "", 1: "N", 2: "P", 3: "U"}[k] for k in t.slot] == [k if k in "NPU" and k else "" for k in expected], text


def test_short_items(spark):
    items = ["what is the capital then", "Name the largest planet", "What is DNA?", "Paris", "5 6", "?!", ""]
    texts = ["so what is the capital then", "Quiz: name the largest planet. What is DNA? Name the largest planet!", "what is DNS",
             "(Paris) 5 5 6", "5 7 6, name the planet", "comparison"]
    rows = d.leaks(*frames(spark, texts, items)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(0, 0), (1, 1), (1, 2), (3, 3), (3, 4)}
    assert len(rows) == 5 and all(r.exact and r.n_matched == r.n_windows == 1 for r in rows)


def test_a_short_item_gives_one_window_a_document(spark):
    docs, items = frames(spark, ["the cat and the dog " * 500, "the end"], ["the"])
    assert d.document_windows(docs, d.item_windows(items)).count() == 2


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, QUESTION, 0), (3, QUESTION, 0), (3, QUESTION, 0), (3, "clean words", 0),
            (4, "word " * 60_000 + QUESTION, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, QUESTION, "n"), (8, None, "n"), (None, QUESTION, "n")], "item_id bigint, text string, doc_id string")
    assert found(d.leaks(docs, items)) == {(x, i) for x in (None, 3, 4) for i in (7, None)}
    assert len(d.leaks(docs, items).collect()) == 6
    kept = d.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, str(r.text)) for r in kept.collect()) == [(1, "None"), (2, ""), (3, "clean words")]
    none = spark.createDataFrame([], ITEMS)
    assert d.leaks(docs, none).collect() == [] and d.without_leaks(docs, none).count() == len(rows)
    assert d.leaks(docs.limit(0), items).collect() == []


def test_each_occurrence_is_judged_alone(spark):
    other = QUESTION.replace("Alice", "Eve").replace("Bob", "Tom").replace("12", "40").replace("7", "9")
    third = other.replace("Eve", "Zoe").replace("Tom", "Max").replace("40", "31").replace("5", "6")
    rows = {r.doc_id: r for r in d.leaks(*frames(spark, [f"{other} {third}", f"{other} Words between. {QUESTION}",
                                                         f"Numbered: {third}\n{other}\n{QUESTION}", "clean"])).collect()}
    assert set(rows) == {0, 1, 2}
    assert not rows[0].exact and rows[1].exact and rows[2].exact


def test_edited_copies_are_one_occurrence(spark):
    edited = QUESTION.replace("buys", "quickly buys").replace("because", "only because").replace("Alice", "Eve")
    assert found(d.leaks(*frames(spark, [f"{edited} {edited.replace('Eve', 'Zoe')}"]))) == {(0, 0)}


STORY = "Tom has 5 apples. Tom buys 3 more apples. Tom gives 2 of them away. Tom then counts what is left."


def test_names_that_begin_sentences(spark):
    other = STORY.replace("Tom", "Kate").replace("5", "9")
    mixed = STORY
    for name in ("Kate", "Ann", "Max", "Eve"):
        mixed = mixed.replace("Tom", name, 1)
    rows = {r.doc_id: r for r in d.leaks(*frames(spark, [f"Solve this. {other}", mixed, STORY], [STORY])).collect()}
    assert set(rows) == {0, 2} and not rows[0].exact and rows[2].exact


def test_names_of_two_words(spark):
    both = QUESTION.replace("Alice", "Mary Ann").replace("Bob", "John Smith")
    broken = QUESTION.replace("Alice", "Mary Ann", 1).replace("Bob", "John Smith", 1).replace("12", "5")
    assert found(d.leaks(*frames(spark, [both, "Text. " + both, broken]))) >= {(0, 0), (1, 0)}
    t = d.Templates(pa.array(["Later Mary Ann met Bob, Eve. Tom", None, "Ann"])).wide()
    assert t.slot.tolist() == [2, 0, 2, 2, 2, 2] and t.edges.tolist() == [0, 5, 5, 6]


def test_items_of_numbers_are_found_verbatim(spark):
    items = ["3 5 7 9 11 13, what is next", "Ann Bob 3 kg 4", "1 2 3 4 5 6 7 8 9 10 11 12"]
    texts = [f"Quiz: {items[0]}?", "So Ann Bob 3 kg 4 is it", f"0 {items[2]} 13", "3 5 7 9 11 15, what is next",
             "1 2 3 4 5 6 7 8 9 10 and 3 4 5 6 7 8 9 10 11 12"]
    assert found(d.leaks(*frames(spark, texts, items))) == {(0, 0), (1, 1), (2, 2)}


def test_scripts_without_spaces(spark):
    items = ["日本の首都はどこですか", "ประเทศไทยมีกี่จังหวัด"]
    texts = [f"問題:{items[0]}。答えは東京です。", f"ถาม {items[1]} ตอบ", "日本の首都は東京です"]
    assert found(d.leaks(*frames(spark, texts, items))) >= {(0, 0), (1, 1)}
