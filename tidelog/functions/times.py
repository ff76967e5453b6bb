"""Timestamps as numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column, kind: str) -> Column:
    """Microseconds since 1970 for a ``timestamp`` or ``timestamp_ntz`` column.

    A timestamp without zone is counted as it reads. Going through the session's zone would
    not be monotone where clocks change.
    """
    if kind == "timestamp":
        return F.unix_micros(ts)
    day_seconds = F.hour(ts) * 3_600 + F.minute(ts) * 60
    return (F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000
            + day_seconds.cast("bigint") * 1_000_000
            + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint"))
