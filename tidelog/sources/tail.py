"""``log_tail``: a streaming source over growing, rotating log files, by byte range.

Spark's file source never looks at a file again once it has read it, so growth needs a source
of its own. Progress is the listing itself: path to size, file identity and a hash of the bytes just before
the size. A batch reads, for every file, the bytes added between two listings, cut into ranges read in parallel.

* A line belongs to the range that holds its line end. An unfinished last line therefore waits,
  ranges can be cut anywhere, and reading a range again gives the same lines.
* A file goes on where it was left only if the bytes before that position are still the ones that
  were read; tasks check that. Otherwise it is another file, however it begins, and is read from its start.
* A file that shows up under a new name may continue one of its folder: the one
  with the same device and inode, else one whose last bytes read stand at the same position.
* A rotated file that was compressed is checked in the same way after decoding, and positions count decoded
  bytes. It is read once, by one task.
* Files that are gone leave the offset with the next listing.
* Lines end with a line feed, a carriage return, or both, as in the batch reader.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import os
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = ("ns string, pod string, uid string, container string, path string, file_fp string, "
          "range_start bigint, start_byte bigint, n_bytes bigint, line string, collected_at timestamp")
ARROW = pa.schema([
    ("ns", pa.string()), ("pod", pa.string()), ("uid", pa.string()), ("container", pa.string()),
    ("path", pa.string()), ("file_fp", pa.string()), ("range_start", pa.int64()),
    ("start_byte", pa.int64()), ("n_bytes", pa.int64()),
    ("line", pa.string()), ("collected_at", pa.timestamp("us", tz="UTC"))])
CHECK_BYTES = 4096  # bytes before a position by which its file is known again
LISTERS = 16
BLOCK_BYTES = 8 * 1024 * 1024
BACK_BYTES = 64 * 1024
RANGE_BYTES = 128 * 1024 * 1024
LF, CR = 10, 13


class ByteRange(InputPartition):
    """Bytes ``[start, end)`` of one file; of a compressed one, decoded bytes up to its end.

    ``earlier`` are the positions at which the file may go on: (position, hash of the bytes before it, whether
    the file counted as closed then). If none holds, the first range also takes what stands before it.
    ``closed`` marks the end of a file that cannot grow. ``size`` and ``mark`` are those of the listing.
    """

    def __init__(self, path: str, fingerprint: str, start: int, end: int, first: bool, closed: bool,
                 earlier: list[tuple[int, str, bool]], size: int, mark: str, collected_at: int):
        self.path, self.fingerprint = path, fingerprint
        self.start, self.end, self.first, self.closed = start, end, first, closed
        self.earlier, self.size, self.mark = earlier, size, mark
        self.collected_at = collected_at


class LogTailSource(DataSource):
    """Options: ``path``; ``namespaces`` (comma list); ``rangeBytes``; ``failOnDataLoss``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> "LogTailReader":
        return LogTailReader(self.options)


def _open(path: str):
    return gzip.open(path, "rb") if _compressed(path) else open(path, "rb")


def _mark(f, position: int) -> str:
    """Hash of the bytes just before a position of an open file; of none if the file is shorter."""
    low = max(0, position - CHECK_BYTES)
    f.seek(low)
    block = f.read(position - low)
    return hashlib.md5(block, usedforsecurity=False).hexdigest() if len(block) == position - low else ""


def _version(stat: os.stat_result) -> tuple:
    return stat.st_ino, stat.st_size, stat.st_mtime_ns


def _compressed(path: str) -> bool:
    return path.endswith(".gz")


def _rotated(name: str) -> bool:
    return ".log." in name


def seen_file(path: str) -> tuple[os.stat_result, str] | None:
    """Status and mark of a file from one opening; None if it cannot be read as what its name says."""
    try:
        with open(path, "rb") as f:
            stat = os.fstat(f.fileno())
            if _compressed(path):
                gzip.GzipFile(fileobj=f).read(1)
            return stat, _mark(f, stat.st_size)
    except (FileNotFoundError, EOFError, gzip.BadGzipFile):
        return None


def log_entries(container: str) -> Iterator[tuple[str, os.stat_result]]:
    """Log files of a container's folder; a compressed copy counts once the plain file is gone."""
    found = {e.name: e for e in _entries(container) if e.is_file() and not e.name.endswith(".tmp")}
    for name in sorted(found):
        plain = name.removesuffix(".gz")
        if (plain.endswith(".log") or _rotated(plain)) and (plain == name or plain not in found):
            try:
                yield found[name].path, found[name].stat()
            except FileNotFoundError:
                continue


def _parts(path: str) -> tuple[str, str, str, str]:
    directory = os.path.dirname(path)
    fields = (os.path.basename(os.path.dirname(directory)).split("_") + ["", ""])[:3]
    return fields[0], fields[1], fields[2], os.path.basename(directory)


class LogTailReader(DataSourceStreamReader):
    """Offsets: ``at`` (seconds, names the run) and ``files``, path to [size, identity, mark, first seen]."""

    def __init__(self, options):
        self.root = options["path"]
        wanted = options.get("namespaces")
        self.namespaces = None if wanted is None else {n.strip() for n in wanted.split(",")}
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.fail_on_data_loss = str(options.get("failOnDataLoss", "true")).lower() == "true"
        self.seen: dict[str, tuple[os.stat_result, str]] = {}
        self.last = self.initialOffset()
        self.named = 0  # the latest name given to a run

    # -- driver: listings only ------------------------------------------------------------

    def initialOffset(self) -> dict:
        return {"at": 0, "files": "{}"}

    def latestOffset(self) -> dict:
        with ThreadPoolExecutor(LISTERS) as pool:
            seen = {path: found for path, found in pool.map(self._look, self._listing()) if found is not None}
        self.seen = seen
        # Whole seconds that never repeat: a batch is named after its listing.
        at = max(int(time.time()), self.last["at"] + 1, self.named + 1)
        born = {entry[1]: (entry[0], entry[3]) for entry in json.loads(self.last["files"]).values()}
        files = {}
        for path, (stat, mark) in seen.items():
            identity = f"{stat.st_dev}:{stat.st_ino}"
            size, first = born.get(identity, (0, at))
            files[path] = [stat.st_size, identity, mark, first if stat.st_size >= size else at]
        listing = json.dumps(files, sort_keys=True)
        if listing != self.last["files"]:
            self.last = {"at": at, "files": listing}
        return self.last

    def _look(self, listed: tuple[str, os.stat_result]) -> tuple[str, tuple[os.stat_result, str] | None]:
        """Size and mark from one open file, so that a rotation in between cannot mix two
        files. Unchanged files are not opened; nothing is returned for unreadable ones."""
        path, stat = listed
        known = self.seen.get(path)
        if known and _version(known[0]) == _version(stat):
            return path, known
        return path, seen_file(path)

    def _listing(self) -> Iterator[tuple[str, os.stat_result]]:
        """Log files two levels below the root."""
        for pod_dir in _subdirectories(self.root):
            fields = os.path.basename(pod_dir).split("_")
            if len(fields) < 2 or (self.namespaces is not None and fields[0] not in self.namespaces):
                continue
            for container in _subdirectories(pod_dir):
                yield from log_entries(container)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        # The name of a run never falls behind that of the batch before it, whatever the clock did since.
        at = max(end["at"], start["at"] + 1)
        self.named = max(self.named, at)
        folders: dict[str, list] = {}
        for path, entry in before.items():
            if not _compressed(path):
                folders.setdefault(os.path.dirname(path), []).append((path, entry))
        ranges = []
        for path, entry in now.items():
            if before.get(path, [])[:3] != entry[:3]:
                ranges += file_ranges(path, entry, before.get(path), folders.get(os.path.dirname(path), []), at,
                                      self.range_bytes)
        return ranges

    def commit(self, end: dict) -> None:
        pass

    # -- executors ------------------------------------------------------------------------

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        path = self._locate(partition)
        if path is None:
            if self.fail_on_data_loss:
                raise FileNotFoundError(f"{partition.path} is gone or was replaced before it was read")
            return
        with _open(path) as f:
            held = [(position, ended) for position, mark, ended in sorted(partition.earlier) if _mark(f, position) == mark]
        position, ended = max(held, default=(0, False))
        start = position if partition.first else max(partition.start, position)
        end = math.inf if _compressed(partition.path) else partition.end
        same = [*_parts(partition.path), partition.path, partition.fingerprint]
        for starts, sizes, lines in _owned_lines(path, start, end, partition.closed and not ended):
            n = len(starts)
            columns = [pa.array([v] * n, pa.string()) for v in same]
            columns += [pa.array([partition.start] * n, pa.int64()), pa.array(starts), pa.array(sizes), lines,
                        pa.array([partition.collected_at * 1_000_000] * n, ARROW.field("collected_at").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW)

    @staticmethod
    def _locate(partition: ByteRange) -> str | None:
        """The file listed for this range, which may have been renamed or compressed in the meantime."""
        others = sorted(e.path for e in _entries(os.path.dirname(partition.path)) if e.is_file())
        for path in [partition.path, *[p for p in others if p != partition.path]]:
            try:
                # A listed compressed file is known by its bytes as they are, a plain one by its text.
                as_is = _compressed(partition.path) or not _compressed(path)
                with (open(path, "rb") if as_is else _open(path)) as f:
                    if _mark(f, partition.size) == partition.mark:
                        return path
            except (FileNotFoundError, EOFError, gzip.BadGzipFile):
                continue
        return None


def _whole(entry: list) -> bool:
    return len(entry) < 5 or entry[4]


def file_ranges(path: str, entry: list, old: list | None, folder: list, at: int, range_bytes: int) -> list[ByteRange]:
    """Ranges of a file from where one of the ``earlier`` entries of its folder may have left it.

    An entry is [position, identity, mark, first seen], and False after that if the position is not the file's end.
    """
    size, identity, mark, born = entry[:4]
    packed, rotated = _compressed(path), _rotated(os.path.basename(path))
    # The same inode, or any file of the folder: inodes are used again, and copies have new ones.
    known = [(p, e) for p, e in folder if e[1] == identity] or folder
    if old and not packed and old[1] == identity:
        known = [(path, old)]
    earlier = [(e[0], e[2], _rotated(os.path.basename(p)) and _whole(e)) for p, e in known
               if packed or e[0] < size or (e[0] == size and e[2] == mark)]
    low = min((position for position, _, _ in earlier), default=0)
    fingerprint = hashlib.md5(f"{identity}:{born}".encode(), usedforsecurity=False).hexdigest()
    closed = rotated and _whole(entry)  # its last line counts without a line end, but only once
    if packed:
        cuts = [0, size]
    elif size == low:
        if not closed:
            return []
        cuts = [low, size]
    else:
        cuts = [*range(low, size, range_bytes), size]
    return [ByteRange(path, fingerprint, a, b, i == 0, closed and b == size, earlier, size, mark, at)
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _entries(directory: str) -> list[os.DirEntry]:
    """Entries of a directory, which may be removed while the tree is listed."""
    try:
        with os.scandir(directory) as entries:
            return list(entries)
    except FileNotFoundError:
        return []


def _subdirectories(directory: str) -> list[str]:
    return sorted(e.path for e in _entries(directory) if e.is_dir() and not e.name.startswith("."))


def _line_start(f, position: int) -> int:
    """Start of the line that covers or begins at ``position``."""
    while position > 0:
        low = max(0, position - BACK_BYTES)
        f.seek(low)
        block = f.read(position - low)
        found = block.rfind(b"\n")
        if found >= 0:
            return low + found + 1
        position = low
    return 0


def _owned_lines(path: str, start: int, end: float, closed: bool) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Positions, sizes and texts of lines whose line feed lies in ``[start, end)``, block by block.

    With ``closed`` the unfinished last line counts too. A compressed file is decoded from its
    beginning, since it has no other place to start.
    """
    with _open(path) as f:
        at = 0 if _compressed(path) else _line_start(f, start)
        f.seek(at)
        rest, position = [], at
        while position < end:
            block = f.read(min(BLOCK_BYTES, end - position) if end < math.inf else BLOCK_BYTES)
            if not block:
                break
            position += len(block)
            cut = block.rfind(b"\n") + 1
            if not cut:
                rest.append(block)
                continue
            whole = b"".join([*rest, block[:cut]])
            skip = min(len(whole), max(0, whole.rfind(b"\n", 0, start - at) + 1 if start > at else 0))
            if skip < len(whole):
                yield _lines(whole[skip:], at + skip)
            at += len(whole)
            rest = [block[cut:]] if cut < len(block) else []
        last = b"".join(rest)
        if closed and last:
            yield _lines(last + b"\n", at)


def _lines(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lines of some bytes that end with a line feed. A carriage return ends a line as well; before
    a line feed it is no part of the text, but counts in the line's bytes."""
    raw = np.frombuffer(data, np.uint8)
    feed = raw == LF
    back = np.flatnonzero(raw == CR)
    before_feed = feed[np.minimum(back + 1, len(raw) - 1)]
    alone = back[~before_feed]
    ends = np.sort(np.concatenate([np.flatnonzero(feed), alone]))
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    keep = np.ones(len(raw), bool)
    keep[ends] = keep[back] = False
    lengths = sizes - np.isin(ends - 1, back[before_feed])
    offsets = np.zeros(len(ends) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    texts = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])])
    try:
        return starts + at, sizes, texts.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return starts + at, sizes, pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
