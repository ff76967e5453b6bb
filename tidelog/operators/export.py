"""Size-bounded output: part numbers and output bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PART_BYTES


def split_parts(lines: DataFrame, max_bytes: int = PART_BYTES) -> DataFrame:
    """Part number of every line: a line belongs to the part in which it starts."""
    return lines.withColumn("part", F.floor(F.col("start_byte") / max_bytes).cast("bigint"))


def part_summary(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bytes and number of parts per output."""
    return parts.groupBy(*keys).agg(
        F.sum(F.col("n_bytes") + 1).cast("bigint").alias("total_bytes"),
        F.countDistinct("part").alias("parts"))


def nonempty_outputs(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outputs that hold any bytes, line ends included; an output without a line does not exist."""
    return (lines.groupBy(*keys).agg(F.sum(F.col("n_bytes") + 1).cast("bigint").alias("n_bytes"))
            .where(F.col("n_bytes") > 0))
