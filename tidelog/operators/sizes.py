"""Size checks for join sides."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_ROWS = 50_000


def keep_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Turn a table of at most ``max_rows`` rows into a local one; leave a larger one alone.

    The optimizer knows the exact size of a local table, so it broadcasts it instead of
    shuffling the large side of a join, and what produced the table runs once. At
    most ``max_rows + 1`` rows ever reach the driver. Larger tables join by shuffle, where
    skewed partitions are split at run time. Meant for narrow tables of names and numbers.
    """
    rows = df.limit(max_rows + 1).toArrow()
    return df if rows.num_rows > max_rows else df.sparkSession.createDataFrame(rows, df.schema)
