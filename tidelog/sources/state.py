"""Saved collection state: the JSON map from path to bytes already read."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import OFFSETS


def offsets_from_json(stored: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects ``{path: bytes}`` to rows; a corrupt object counts as empty."""
    parsed = F.from_json(F.col(column), T.MapType(T.StringType(), T.LongType()))
    return stored.select(F.explode(parsed).alias("path", "byte_offset")).where(
        F.col("byte_offset").isNotNull())


def read_offsets_json(spark: SparkSession, path: str) -> DataFrame:
    """The offset files under ``path``, one JSON object each; a missing folder is an empty map."""
    found = (spark.read.format("binaryFile").option("ignoreMissingFiles", True)
             .option("recursiveFileLookup", True))
    try:
        raw = found.load(path)
    except AnalysisException as error:  # only an absent path counts as "no state yet"
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], OFFSETS)
    return offsets_from_json(raw.select(F.decode("content", "UTF-8").alias("value")))


def read_last_run(spark: SparkSession, path: str) -> datetime | None:
    """When the last cycle began; None before the first one."""
    try:
        row = spark.read.schema("at timestamp").parquet(path).agg(F.unix_micros(F.max("at")).alias("at")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row["at"] is None else datetime.fromtimestamp(row["at"] / 1_000_000, timezone.utc)


def write_last_run(spark: SparkSession, path: str, at: datetime) -> None:
    """Save when a cycle began, once everything it collected is stored."""
    micros = int(at.timestamp() * 1_000_000)
    spark.range(1).select(F.timestamp_micros(F.lit(micros)).alias("at")).coalesce(1).write.mode("overwrite").parquet(path)


def write_offsets(offsets: DataFrame, path: str) -> None:
    """Offsets as a table: each run replaces the saved map."""
    offsets.select("path", "byte_offset").write.mode("overwrite").parquet(path)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OFFSETS).parquet(path)
