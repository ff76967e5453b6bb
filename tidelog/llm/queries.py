"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.bpe import token_report
from tidelog.llm.decontaminate import leak_report
from tidelog.llm.fingerprints import fingerprint_report
from tidelog.llm.html_extract import main_text_report
from tidelog.llm.jaccard_join import group_documents
from tidelog.llm.langid import language_report
from tidelog.llm.license_scan import license_report
from tidelog.llm.line_dedup import line_report
from tidelog.llm.merkle import manifest_report
from tidelog.llm.pii import personal_data_report
from tidelog.llm.substring_dedup import repeat_report
from tidelog.llm.warc import archive_report
from tidelog.llm.whitening import whitening_report


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(_read(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(_read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(_read(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(_read(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(_read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(_read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(_read(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text_report(_read(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_report(_read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(_read(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_jaccard_join, op3_substring_dedup, op4_fingerprints, op5_langid, op6_line_dedup, op7_bpe, op8_pii,
                          op9_html_extract, op10_decontaminate, op11_merkle, op12_whitening, op13_license_scan)
}
