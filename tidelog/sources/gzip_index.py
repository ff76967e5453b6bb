"""Compressed log files read by several tasks each.

A gzip file can only be decoded from its start, unless one knows a place where a block of it begins, how far the decoded
text is there, and the 32 KB of text before. A first pass (a task per file) finds such places about every ``spacing``
decoded bytes and keeps them as rows of an index; every later read decodes the pieces between them in parallel.

Blocks begin at any bit. Candidates are bits at which the header of a dynamic block could stand; one is taken if decoding
from there, with the text before it as window, gives the very bytes that the pass itself decoded, for one position of the
text alone. Members of a file are found on the way. A file without such places (stored or very repetitive), or one cut
off, has fewer pieces, down to one; its lines are the same.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .archives import open_storage
from .folders import read_table

WINDOW = 32 * 1024
SPACING = 32 * 1024 * 1024
FIRST_READ, READ = 16 * 1024, 256 * 1024
NEAR_END = 96 * 1024  # compressed bytes in which a place is looked for
TRIAL = 16 * 1024  # decoded bytes by which a place is checked at least
CARRY = 4 * 1024 * 1024
SLACK = 1024  # text that the last seven bits of a piece may give
RAW, GZIP = -15, 31
MAGIC = b"\x1f\x8b"
FILE = ["path", "size_bytes", "mtime"]
INDEX = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("mtime", T.TimestampType()),
    T.StructField("piece", T.IntegerType()), T.StructField("bit", T.LongType()), T.StructField("raw", T.BooleanType()),
    T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("lines_before", T.LongType()),
    T.StructField("window", T.BinaryType()), T.StructField("following", T.LongType())])
LINES = "path string, piece_start bigint, line_no bigint, start_byte bigint, n_bytes bigint, line string"

# Fixed values of the format: the order of the code lengths in the header of a dynamic block.
_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
_HEADER = 17 + 19 * 3  # bits of a header that are looked at


class Piece(NamedTuple):
    """Where decoding can begin: at a bit within a member (``raw``), or where a member begins.

    ``start`` is the place in the decoded text, ``window`` the text before it (of a member's start, one byte),
    ``following`` where the member after the piece's own begins, in bytes of the file; -1 if there is none.
    """

    bit: int
    raw: bool
    start: int
    lines_before: int
    window: bytes
    following: int = -1


def block_starts(data: bytes) -> np.ndarray:
    """Bits of some bytes at which a dynamic block that is not the last one may begin. Few others pass."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    n = len(bits) - _HEADER
    if n <= 0:
        return np.zeros(0, np.int64)

    def number(at, width: int) -> np.ndarray:
        return sum(bits[at + i].astype(np.int64) << i for i in range(width))

    at = np.flatnonzero((bits[:n] == 0) & (bits[1:n + 1] == 0) & (bits[2:n + 2] == 1))
    at = at[(number(at + 3, 5) <= 29) & (number(at + 8, 5) <= 29)]
    lengths = number(at + 13, 4) + 4
    full = np.zeros(len(at), np.int64)  # the code of the code lengths has to be complete
    for i in range(len(_ORDER)):
        length = np.where(i < lengths, number(at + 17 + 3 * i, 3), 0)
        full += np.where(length > 0, 128 >> length, 0)
    return at[full == 128]


def _from_bit(data: bytes, bit: int) -> bytes:
    """The bytes whose first bit is the given one."""
    raw = np.frombuffer(data, np.uint8, offset=bit >> 3)
    shift = bit & 7
    if not shift:
        return raw.tobytes()
    return ((raw[:-1] >> shift) | (raw[1:] << (8 - shift))).astype(np.uint8).tobytes()


class Pass:
    """One decoding of a file from its start."""

    def __init__(self, spacing: int = SPACING):
        self.spacing, self.pieces = spacing, [Piece(0, False, 0, 0, b"")]
        self.at, self.lines, self.text, self.member = 0, 0, b"", 0  # decoded so far; the end of it; start of the member

    def run(self, f) -> "Pass":
        place, known = 0, 0
        while (place := member_at(f, place)) is not None:
            for i in range(known, len(self.pieces)):
                if self.pieces[i].bit < place * 8:
                    self.pieces[i] = self.pieces[i]._replace(following=place)
            known, self.member = len(self.pieces), self.at
            if self._due():
                self.pieces.append(Piece(place * 8, False, self.at, self.lines, self.text[-1:]))
            f.seek(place)
            engine = zlib.decompressobj(GZIP)
            for data in _read(f):
                self._decoded(engine.decompress(data))
                if engine.eof:
                    place += len(data) - len(engine.unused_data)
                    break
                if self._due():
                    self._look(data, place * 8)
                place += len(data)
            else:
                break  # cut off
        return self

    def _due(self) -> bool:
        return self.at - self.pieces[-1].start >= self.spacing

    def _decoded(self, out: bytes) -> None:
        self.at += len(out)
        self.lines += out.count(b"\n")
        self.text = (self.text + out)[-(CARRY + WINDOW):]

    def _look(self, data: bytes, bit: int) -> None:
        """Find a place in the bytes decoded last; ``bit`` is where they begin."""
        skipped = max(0, len(data) - NEAR_END)
        data = data[skipped:]
        for at in block_starts(data).tolist():
            shifted = _from_bit(data, at)
            try:
                size = len(zlib.decompressobj(RAW, zdict=bytes(WINDOW)).decompress(shifted))
            except zlib.error:
                continue
            if not TRIAL <= size <= CARRY:
                continue
            # The bits after the last whole byte may have given some text more: try all places that leaves. Text
            # that repeats itself may fit at several; such a place is not taken.
            lowest = self.at - size - (SLACK if at & 7 else 0)
            fits = [start for start in range(lowest, self.at - size + 1) if self._fits(shifted, start, size)]
            if len(fits) == 1:
                (start,) = fits
                low, first = self._window(start)
                self.pieces.append(Piece(bit + (skipped * 8) + at, True, start, self.lines - self.text[low:].count(b"\n"),
                                         self.text[first:low]))
                return

    def _window(self, start: int) -> tuple[int, int]:
        """Where a place, and the window before it, begin in the text at hand."""
        low = len(self.text) - (self.at - start)
        return low, low - min(WINDOW, start - self.member)

    def _fits(self, shifted: bytes, start: int, size: int) -> bool:
        low, first = self._window(start)
        if start <= self.member or first < 0:
            return False
        try:
            for most in (1024, size):  # most places fail at once
                if zlib.decompressobj(RAW, zdict=self.text[first:low]).decompress(shifted, most) != self.text[low:low + most]:
                    return False
        except zlib.error:
            return False
        return True


def member_at(f, place: int) -> int | None:
    """Start of the member at or after a place, behind padding; None if there is none. A file begins with one."""
    while True:
        f.seek(place)
        head = f.read(4096)
        start = len(head) - len(head.lstrip(b"\0")) if place else 0
        if start < len(head) or not head:
            break
        place += len(head)
    if head and MAGIC.startswith(head[start:start + 2]):
        return place + start
    if place or not head:
        return None
    raise zlib.error("not a gzip file")


def _read(f) -> Iterator[bytes]:
    size = FIRST_READ  # members may be small
    while data := f.read(size):
        yield data
        size = min(READ, size * 4)


def decoded(f, bit: int, raw: bool, window: bytes, following: int) -> Iterator[bytes]:
    """Text of a file from the start of a piece to the file's end."""
    place = bit >> 3
    if raw:
        f.seek(place)
        engine, rest = zlib.decompressobj(RAW, zdict=window), b""
        for data in itertools.chain(_read(f), [b"\0"]):
            data = rest + data
            rest = data[-1:] if bit & 7 else b""
            yield engine.decompress(_from_bit(data, bit & 7))
            if engine.eof:
                break
        if following < 0:
            return
        place = following
    while (place := member_at(f, place)) is not None:
        f.seek(place)
        engine = zlib.decompressobj(GZIP)
        for data in _read(f):
            yield engine.decompress(data)
            if engine.eof:
                place += len(data) - len(engine.unused_data)
                break
            place += len(data)
        else:
            return


# ---- on Spark ----------------------------------------------------------------------------

def index_gzip(files: DataFrame, spacing: int = SPACING) -> DataFrame:
    """The pieces of compressed files, given as ``path, size_bytes, mtime`` (``list_files``). A task decodes a file at a time."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, path in enumerate(batch.column("path").to_pylist()):
                files, name = open_storage(path)
                with files.open_input_file(name) as f:
                    done = Pass(spacing).run(f)
                n = len(done.pieces)
                bits, raw, starts, lines, windows, following = zip(*done.pieces)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array([low] * n)) for c in FILE), pa.array(range(n), pa.int32()), pa.array(bits, pa.int64()),
                     pa.array(raw), pa.array(starts, pa.int64()), pa.array([*starts[1:], done.at], pa.int64()),
                     pa.array(lines, pa.int64()), pa.array(windows, pa.binary()), pa.array(following, pa.int64())], INDEX.fieldNames())

    return files.select(*FILE).repartition("path").mapInArrow(scan, INDEX)


def update_index(spark: SparkSession, files: DataFrame, folder: str, spacing: int = SPACING) -> DataFrame:
    """Index the files that the stored index does not have, or has with another size or time; the pieces of all of them.

    Pieces of files that are gone or were replaced are left out of what is returned.
    """
    known = read_table(spark, folder, INDEX)
    new = files.join(known.select(*FILE).distinct(), FILE, "left_anti")
    if not new.isEmpty():
        index_gzip(new, spacing).write.mode("append").parquet(folder)
    return read_table(spark, folder, INDEX).join(files.select(*FILE), FILE, "left_semi")


def read_pieces(index: DataFrame) -> DataFrame:
    """All lines of indexed files; a line ends with a line feed, or with the file.

    Positions count decoded bytes. A line belongs to the piece in which it starts, so numbers and positions are known
    without a shuffle of lines. Invalid UTF-8 is replaced.
    """
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                yield from _lines_of(piece)

    # A piece is few bytes here and much work: they are dealt anew, whatever tasks the index was read by.
    dealt = index.drop("size_bytes", "mtime").repartition("path", "piece")
    return dealt.mapInArrow(lines, LINES)


def _lines_of(piece: dict) -> Iterator[pa.RecordBatch]:
    files, name = open_storage(piece["path"])
    at, end = piece["start_byte"], piece["end_byte"]
    skip = at > 0 and not piece["window"].endswith(b"\n")  # the line before goes on here
    number, rest = piece["lines_before"] + 1, []

    def rows(whole: bytes) -> pa.RecordBatch:
        raw = np.frombuffer(whole, np.uint8)
        feeds = np.flatnonzero(raw == 10)
        starts = np.append(0, feeds[:-1] + 1)
        first = 1 if skip else 0
        last = max(first, int(np.searchsorted(starts + at, end)))
        starts, feeds = starts[first:last], feeds[first:last]
        texts = [whole[a:b] for a, b in zip(starts.tolist(), feeds.tolist())]
        try:
            text = pa.array(texts, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([piece["path"]] * n, pa.string()), pa.array([piece["start_byte"]] * n, pa.int64()),
             pa.array(np.arange(n) + number + first), pa.array(starts + at), pa.array(feeds - starts), text],
            ["path", "piece_start", "line_no", "start_byte", "n_bytes", "line"])

    with files.open_input_file(name) as f:
        for block in decoded(f, piece["bit"], piece["raw"], piece["window"], piece["following"]):
            cut = block.rfind(b"\n") + 1
            if not cut:
                rest.append(block)
                continue
            whole = b"".join([*rest, block[:cut]])
            yield rows(whole)
            number, skip, at, rest = number + whole.count(b"\n"), False, at + len(whole), [block[cut:]]
            if at >= end:
                return
    last = b"".join(rest)
    if last and not skip and at < end:
        yield rows(last + b"\n")
