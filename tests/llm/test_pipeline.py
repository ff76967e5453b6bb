import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import tiktoken
from brute import jaccard_groups
from test_line_dedup import plain
from tidelog.llm import bpe, langid

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(spark, docs, items):
    """{doc_id: ids} by plain versions of the stages; the language model is the pipeline's."""
    known = pipeline.keep_identified(spark, docs, SF).collect()
    texts = plain([(r.doc_id, r.text) for r in known])
    groups = jaccard_groups(texts)
    texts = [(d, t) for d, t in texts if groups[d][1] == d]
    texts = [(d, t) for d, t in texts if not any(i in t for i in items)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.public_ranks(), special_tokens={})
    return {d: library.encode_ordinary(t) for d, t in texts}


def test_stages_follow_the_contract():
    assert [name for name, _ in pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join",
                                                     "benchmark decontamination", "byte-level BPE"]


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = brute(spark, docs, items)
    got = {r.doc_id: r.ids for r in pipeline.run(spark, SF).collect()}
    assert got == expected and len(got) < docs.count()


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_language_stage_keeps_what_can_be_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = pipeline.keep_identified(spark, docs, SF)
    assert kept.count() >= 0.995 * docs.count()
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "123 456", "en", "s", 7), (3, "", None, None, None)], SCHEMA)
    assert pipeline.keep_identified(spark, docs.unionByName(odd), SF).join(odd.select("doc_id", "text"), ["doc_id", "text"]).isEmpty()


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_odd_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    row = docs.first()
    odd = spark.createDataFrame([(None, row.text, None, None, None), (row.doc_id, row.text, "en", "s", 1), (row.doc_id, None, "en", "s", 1),
                                 (10**12, "word " * 50_000, "en", "s", 1)], SCHEMA)
    docs = docs.unionByName(odd)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = {r.doc_id: np.array(r.ids) for r in docs.collect()}
    assert 10**12 in ids and None not in ids and langid.UNKNOWN == "und"
