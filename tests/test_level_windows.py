"""Level counts kept by batches against the counts of all lines at once."""

from datetime import datetime, timedelta

import pytest
from tidelog.sources import folders
from tidelog.streaming import level_windows
from tidelog.streaming.level_windows import LevelWindows, counted_windows, daily

SCHEMA = "ns string, pod string, ts timestamp, line string"
START = datetime(2024, 3, 1)
WORDS = ["ERROR a", "warn b", "info c", "debug d", "plain"]


def lines(spark, hours, n=40, pods=3):
    rows = [("ns", f"p{i % pods}", START + timedelta(hours=h, seconds=37 * i), WORDS[(h + i) % 5]) for h in hours for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def found(frame):
    return sorted(map(tuple, frame.collect()))


def expected(parts, store):
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    windows = counted_windows(every, store.keys).select(*store.schema.fieldNames())
    return found(windows), found(daily(windows, store.keys))


def test_late_and_repeated_batches(spark, tmp_path):
    store = LevelWindows(spark, str(tmp_path), tolerance="1 day")
    parts = [lines(spark, range(0, 30)), lines(spark, range(24, 80)),
             lines(spark, [2, 3, 90]),  # two hours of a closed day
             lines(spark, [50, 5])]
    for i, part in enumerate(parts):
        assert store.add(part, i) and not store.add(part, i)
        assert (found(store.windows()), found(store.days())) == expected(parts[:i + 1], store)
    state = store.state()
    assert state["batch"] == 3 and state["late_lines"] == 120  # the day of hour 50 was open still
    assert state["closed_until"] == datetime(2024, 3, 3)
    before = found(store.windows())
    store.merge_late()
    assert found(store.windows()) == before and found(store.days()) == expected(parts, store)[1]
    assert store._part(store._newest(), "late").isEmpty() and store.state() == state
    store.merge_late()  # nothing waits
    removed = store.vacuum(keep=1)
    assert removed and found(store.windows()) == before
    assert found(store.windows("2024-03-02", "2024-03-03")) == [r for r in before if datetime(2024, 3, 2) <= r[0] < datetime(2024, 3, 4)]
    assert {r[0].isoformat() for r in found(store.days("2024-03-01", "2024-03-01"))} == {"2024-03-01"}


def test_a_late_day_that_was_never_seen(spark, tmp_path):
    store = LevelWindows(spark, str(tmp_path), tolerance="1 hour")
    parts = [lines(spark, [100]), lines(spark, [1, 30])]
    for i, part in enumerate(parts):
        store.add(part, i)
    store.merge_late()
    assert (found(store.windows()), found(store.days())) == expected(parts, store)
    assert store.state()["late_lines"] == 80


@pytest.mark.parametrize("stop", [1, 3, 4, 6, 8])
def test_a_writer_stopped_at_any_step(spark, tmp_path, monkeypatch, stop):
    """A write that fails leaves the version before it, and the same batch again gives the whole result."""
    store = LevelWindows(spark, str(tmp_path), tolerance="1 hour")
    parts = [lines(spark, range(0, 30), 5), lines(spark, [1, 60], 5)]
    store.add(parts[0], 0)
    before, left = found(store.windows()), [stop]
    writer = type(parts[0].write)

    def failing(self, *args, _parquet=writer.parquet, **kwargs):
        left[0] -= 1
        if not left[0]:
            raise OSError("stopped")
        return _parquet(self, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(writer, "parquet", failing)
        try:
            store.add(parts[1], 1)
        except OSError:
            assert found(store.windows()) == before
    store.add(parts[1], 1)
    assert (found(store.windows()), found(store.days())) == expected(parts, store)


def test_what_is_read_does_not_grow_with_batches(spark, tmp_path):
    few, many = (LevelWindows(spark, str(tmp_path / n), tolerance="1 day") for n in ("few", "many"))
    few.add(lines(spark, range(0, 96), 6), 0)
    for i in range(8):
        many.add(lines(spark, range(12 * i, 12 * i + 12), 6), i)
    assert found(few.windows()) == found(many.windows())
    assert len(many.windows().inputFiles()) <= len(few.windows().inputFiles()) + 1
    assert len(many.days("2024-03-01", "2024-03-01").inputFiles()) < len(many.days().inputFiles())


def test_nothing_and_lines_without_a_time(spark, tmp_path):
    store = LevelWindows(spark, str(tmp_path))
    assert found(store.windows()) == [] and found(store.days()) == [] and store.state()["batch"] == -1
    store.merge_late()
    assert store.vacuum() == []
    assert store.add(spark.createDataFrame([("ns", "p", None, "ERROR")], SCHEMA), 0)
    assert store.add(lines(spark, [3], 5).limit(0), 1)
    assert found(store.windows()) == [] and store.state()["watermark"] is None
    assert store.add(spark.createDataFrame([(None, "p", START, "ERROR")], SCHEMA), 2)
    assert found(store.windows()) == [(START, None, "p", 1, 0, 0, 0)]
    assert folders.list_folders(spark, f"{tmp_path}/versions") == [f"v{i:012d}" for i in range(3)]
    assert level_windows.MARKER in folders.list_folders(spark, f"{tmp_path}/versions/v{2:012d}")
