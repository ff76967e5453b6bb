import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from brute import sha
from tidelog.llm import bpe, pretokens
from tidelog.llm.common import text_bytes
from tidelog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def ranks():
    return bpe.public_ranks()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_sha(ids):
    return sha(np.array(ids, "<u4").tobytes())


def test_report_against_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), ids_sha(ids), sha(docs[r.doc_id]))


def cut(texts):
    data, offsets = text_bytes(pa.array(texts))
    starts = pretokens.starts_of(data, offsets)
    ends, edges, raw = np.append(starts[1:], len(data)), np.searchsorted(starts, offsets), data.tobytes()
    return [[raw[starts[i]:ends[i]].decode() for i in range(a, b)] for a, b in zip(edges[:-1], edges[1:])]


def test_cutting_against_the_pattern():
    rng = random.Random(1)
    parts = ["'s", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "a", "bc", "é", "日本", "1", "²", "Ⅷ", "!", "_", "́",
             "\xa0", "\x85", "\x1c", "'d", "'v", "'ve", "l", "😀", "$", "　", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    find = regex.compile(public_tokenizers.PATTERN).findall
    assert cut(texts) == [find(t) for t in texts]


def test_merging_together_and_alone(ranks, library):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéöß日 ing") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    words += ["a" * 33, "ab" * 4000, "😀" * 9, "x"]
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]])
    ids, counts = bpe.Merger(ranks).encode(data, starts, ends, bpe._names(data, starts, ends),
                                               bpe.hashes(data, starts, ends, table=bpe.OTHER_BYTE))
    at = np.cumsum(counts) - counts
    for i, w in enumerate(raw):
        expected = bpe.merge(w, ranks)
        assert ids[at[i]:at[i] + counts[i]].tolist() == expected
        assert expected == library._encode_single_piece(w)


@pytest.mark.parametrize("numbers", [[], [0], [127, 128, 0, 16384, 2**28], list(range(300))])
def test_packing(numbers):
    assert bpe.unpack(bpe.pack(np.array(numbers, np.uint32))).tolist() == numbers


def test_odd_rows(spark, library):
    long = "wörter und mehr " * 30_000
    texts = [None, "", "<|endoftext|>", long, "a" * 20_000, "same", "same", " \n\n  x"]
    rows = [(None if t == "" else i, t, i, b"x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, block int, ids binary")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_report(frame).collect())
    ids = [library.encode_ordinary(t or "") for t in texts]
    assert got == sorted((str(r[0]), len(x), ids_sha(x), sha(r[1] or "")) for r, x in zip(rows, ids))
    assert bpe.token_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_block_without_its_dictionary_is_an_error():
    with pytest.raises(ValueError, match="changed between"):
        bpe._table([], 3, np.dtype("<u2"))


def test_equal_rows_in_several_partitions(spark, ranks, library):
    text = "the same words, the same block"
    spread = spark.range(0, 8, 1, 8).selectExpr("cast(1 as bigint) doc_id", f"'{text}' text")  # one row to a task
    out = bpe.encode_documents(spread, ranks).collect()
    assert [(r.doc_id, bytes(r.ids)) for r in out] == [(1, np.array(library.encode_ordinary(text), "<u4").tobytes())] * 8


def test_words_that_share_a_hash(ranks, library, monkeypatch):
    words = [" one", " two", "three", " one", "quite a long one", "zzq"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = np.append(0, ends[:-1])
    monkeypatch.setattr(bpe, "_names", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2))
    names, others, first, place = bpe.distinct(data, starts, ends)
    assert len(first) == 5 and [words[i] for i in first[place]] == words
    flat, counts = bpe.Merger(ranks).encode(data, starts[first], ends[first], names, others)
    cuts = np.split(flat, np.cumsum(counts)[:-1])
    assert [cuts[i].tolist() for i in place] == [library.encode_ordinary(w) if w in (" one", " two", "three", "zzq")
                                                 else bpe.merge(w.encode(), ranks) for w in words]
