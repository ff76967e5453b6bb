"""From raw documents to token ids: every stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, jaccard_join, langid, line_dedup
from tidelog.llm.common import shared_folder, stored

MIN_SCORE = 0.5  # a language less likely than all others together is a rejection


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language stays in doubt, go."""
    known = langid.identify(docs, langid.learn(docs, langid.public_vocabulary()))
    return known.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= MIN_SCORE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    out = line_dedup.drop_common_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the smallest doc_id stays."""
    return jaccard_join.one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark questions go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, and the ids as an array."""
    ranks = bpe.public_ranks()
    return bpe.with_id_arrays(bpe.encode_documents(docs, ranks))


STAGES = [("language ID", keep_identified), ("line dedup", drop_repeated_lines),
          ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks),
          ("byte-level BPE", encode)]

# Models, merges and connected components are beyond SQL: tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{i}")
    return docs
