"""De-duplication of node lines by the byte intervals of a file that were read before.

State is a few intervals per file, not a row per line: bytes read one after the other grow into one interval. A line goes
on if some byte of it was not covered before. Files longer than a segment are looked after in segments, so that one hot
file is not one task. When nothing of a file has come for ``keep`` of collection time, a timer clears its state: files
that are gone leave nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FILE = ["uid", "container", "file_fp"]
SEGMENT_BYTES = 1 << 30
SEGMENT = "_segment"
STATE = "starts array<bigint>, ends array<bigint>, expires bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fewest intervals ``[start, end)`` that cover the same bytes, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[first], reach[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(reach) - 1]])]


def covered(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of ``[low, high)`` lie in one of some united intervals."""
    if not len(starts):
        return np.zeros(len(low), bool)
    at = np.searchsorted(starts, low, side="right") - 1
    return (at >= 0) & (ends[np.maximum(at, 0)] >= high)


class ReadRanges(StatefulProcessor):
    """Rows of a file (segment) whose bytes were not read before.

    The timer stands at the newest ``collected_at``; it fires when the watermark, which is behind, has passed that.
    """

    def __init__(self, columns: list[str], zone: str):
        self.columns, self.zone = columns, zone

    def _millis(self, at: pd.Timestamp) -> int:
        """Times come in the session's zone, without saying so."""
        return at.tz_localize(self.zone, ambiguous=False, nonexistent="shift_forward").value // 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("intervals", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        starts, ends = (np.array(known[i] if known else [], np.int64) for i in (0, 1))
        expires = known[2] if known else 0
        newest = expires
        for some in rows:
            some = some.drop_duplicates(["start_byte", "n_bytes"])
            low = some["start_byte"].to_numpy(np.int64)
            high = low + some["n_bytes"].to_numpy(np.int64) + 1
            fresh = ~covered(starts, ends, low, high)
            starts, ends = united(np.concatenate([starts, low[fresh]]), np.concatenate([ends, high[fresh]]))
            newest = max(newest, self._millis(some["collected_at"].max()))
            if fresh.any():
                yield some.loc[fresh, self.columns]
        if newest > expires:
            if expires:
                self.handle.deleteTimer(expires)
            self.handle.registerTimer(newest)
        self.state.update((starts.tolist(), ends.tolist(), newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def drop_read_ranges(tail: DataFrame, keep: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One copy of every node line of a stream, however often and in whatever ranges its bytes were read.

    ``keep`` is time of collection, not of the log: how long a file is remembered after its last new line. State rows
    are files, and segments of files that are longer than one. Sets the session's state store, which must keep timers.
    """
    conf = tail.sparkSession.conf
    conf.set(PROVIDER, ROCKSDB)
    cut = tail.withColumn(SEGMENT, F.floor(F.col("start_byte") / segment_bytes)).withWatermark("collected_at", keep)
    return cut.groupBy(*FILE, SEGMENT).transformWithStateInPandas(
        ReadRanges(tail.columns, conf.get("spark.sql.session.timeZone")), tail.schema, outputMode="append", timeMode="eventTime")
