import random

import numpy as np
import pytest

from brute import Groups, jaccard_groups
from tidelog.llm import components
from tidelog.llm import jaccard_join as j
from tidelog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string"


def groups(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = jaccard_groups(docs)
    assert groups(QUERIES["op2_jaccard_join"](spark, SF)) == expected
    assert any(c != d for d, (_, c) in expected.items())


def edited(rng, words, share):
    return [rng.choice("xyzuvw") + w if rng.random() < share else w for w in words]


def test_chains_and_copies(spark):
    """Edits of edits around the threshold, a passage that all share, and copies."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 9, 20, 60, 150, 400]))]
        for _ in range(rng.choice([1, 4, 12])):
            base = edited(rng, base, rng.choice([0.0, 0.005, 0.02, 0.05]))
            texts.append(" ".join(base + (passage if len(base) > 50 else [])))
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    assert groups(j.group_documents(spark.createDataFrame(docs, SCHEMA))) == jaccard_groups(docs)


def test_links_are_all_pairs_of_different_sets(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    texts = [" ".join(edited(rng, base, 0.01)) for _ in range(12)] + ["a b c d e f g", "a b c d e f g h"]
    join = j.JaccardJoin(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    sets = {r.set_id: frozenset(j.shingle_sets(j.pa.array([texts[r.doc_id]]))[0].tolist()) for r in join.sets.collect()}
    expected = {(min(a, b), max(a, b)) for a in sets for b in sets
                if a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {(r.x, r.y) for r in join.links().collect()} == expected


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE  two"), (None, "one two"), (5, "other words here now yes"),
            (6, "other words here now yes"), (None, None)]
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id))
                 for r in j.group_documents(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == sorted([("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "4"), ("5", 1, "4"), ("None", 1, "4"),
                          ("5", 1, "5"), ("6", 1, "5"), ("None", 0, "None")])


def test_empty_table(spark):
    assert j.group_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_columns_may_have_any_name(spark):
    rows = [(1, "a b c d e f", 7, 8), (2, "a b c d e f", 7, 9)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, set_id int, x int")
    assert {r.component_id for r in j.group_documents(frame).collect()} == {1}


@pytest.mark.parametrize("n", [3, 4, 5, 7, 8, 30, 31, 64, 200])
def test_linked_sets_share_a_key(n):
    rng = np.random.default_rng(n)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        most = (len(a) + len(a) * 4 // 3) // 7
        gone = rng.integers(0, most + 1)
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, rng.integers(0, most + 1), dtype=np.uint64)]))
        if j.linked(a, b):
            assert len(np.intersect1d(j.keys_of(a), j.keys_of(b)))


def near_copies(n, base=120):
    rng = random.Random(8)
    words = [f"w{rng.randrange(500)}" for _ in range(base)]
    out = []
    for i in range(n):
        at = rng.randrange(base)
        out.append((i, " ".join([*words[:at], f"own{i}", *words[at + 1:]])))
    return out


def test_large_groups_of_near_copies_grow_in_proportion(spark):
    """Rows that are compared: before, each member of a bucket went to every block of it."""
    rows = {}
    for n in (1500, 3000, 6000):
        join = j.JaccardJoin(spark.createDataFrame(near_copies(n), SCHEMA))
        assert not join.buckets.where(f"size > {j.CELL}").isEmpty()
        labels = join._turns()
        left = join._rows(labels)
        rows[n] = j.cells(join._rows(None, large=True), 0).count() + j.cells(left, None).count()
        if n == 1500:
            assert {r.component_id for r in join.documents().select("component_id").collect()} == {0}
    assert rows[3000] < 2.5 * rows[1500] and rows[6000] < 2.5 * rows[3000]


def test_large_buckets_against_brute_force(spark, monkeypatch):
    """Blocks of a few members, groups that share a passage but do not link, and chains."""
    monkeypatch.setattr(j, "CELL", 4)
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(40)]
    docs = []
    for g in range(3):
        own = [f"g{g}w{i}" for i in range(45)]
        base = shared + own
        for _ in range(25):
            base = edited(rng, base, 0.01)
            docs.append(" ".join(base))
    docs = list(enumerate(docs))
    assert groups(j.group_documents(spark.createDataFrame(docs, SCHEMA))) == jaccard_groups(docs)


def test_many_rows_without_a_doc_id(spark):
    docs = near_copies(300)
    frame = spark.createDataFrame([(None if i % 3 else i, t) for i, t in docs], SCHEMA)
    out = j.group_documents(frame).collect()
    assert len(out) == 300 and {r.component_id for r in out} == {0}


def test_buckets_come_once_and_looks_are_few(spark, monkeypatch):
    """Tables written, since each costs a few stages: before, buckets came once per part of the keys, large ones were dealt
    into blocks in turns of their own, and each confirmed its components in another round."""
    tables = []
    write = components.stored
    for module in (j, components):
        monkeypatch.setattr(module, "stored", lambda df, folder, name: tables.append(name) or write(df, folder, name))
    join = j.JaccardJoin(spark.createDataFrame(near_copies(1500), SCHEMA))
    assert join.buckets.count() == join.buckets.select("bucket").distinct().count()
    assert {r.y for r in join.groups().collect()} == {min(r.set_id for r in join.sets.collect())}
    assert len(tables) <= 12


def test_components_of_paths_hubs_and_repeats(spark, tmp_path):
    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(40)] + [(500, 100 + i) for i in range(300)] + [(300 + 200 * i, 1000 + i) for i in range(20)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    edges = [e[::rng.choice([1, -1])] for e in edges + edges[::3]]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    expected = sorted((n, groups.find(n)) for n in {n for e in edges for n in e} if groups.find(n) != n)
    found = components.components(spark.createDataFrame(edges, "x bigint, y bigint"), str(tmp_path), "mixed")
    assert sorted((r.x, r.y) for r in found.collect()) == expected
    components.components(found, str(tmp_path), "done")
    assert [p.name for p in tmp_path.glob("done-*")] == ["done-0"]
