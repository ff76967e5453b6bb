"""A deterministic, sharded WARC writer, and its reader.

Records are sorted by key. Shards are ranges of keys of about equal size; their bounds come from sums of bytes over
fixed cells of the key range, finer where a cell is too large, so they depend on the records alone. Within a shard,
files roll when their compressed size reaches a limit. Every record is a gzip member of its own without a time stamp.
Headers, record ids and digests are made anew from the content. The same records give the same files, byte for byte.

Of records with equal payloads of MIN_SHARED bytes or more, those with the least key are responses, the others revisits
that refer to it. Payloads travel once, to their shard; which records are revisits is worked out on digests alone, and
those verdicts meet the payloads in the writer.

Commit: a task writes under temporary names that no other attempt uses, and returns manifest rows. The manifest of the
attempts that succeeded is stored, then the files it names get their final names, then the final manifest is written;
readers go by that alone. All steps but the last can be repeated or abandoned without a trace in the result.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import partitions, pieces, shared_folder, tidy

MIN_SHARED = 100
FILE_BYTES = 64 << 20  # compressed
SHARD_BYTES = 8 << 20  # of payload, at least
MOST_SHARDS = 1 << 14  # beyond it shards get larger
CELLS = 1024
DATE = "2000-01-01T00:00:00Z"
LOWEST = -(1 << 63)
LAST = (1 << 63) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def cell_of(key: Column, cuts: list[int], low: int = 0, high: int | None = None) -> Column:
    """Index of the first cut that is not below the key, by a tree of comparisons."""
    high = len(cuts) - 1 if high is None else high
    if high <= low:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key <= F.lit(cuts[mid]), cell_of(key, cuts, low, mid)).otherwise(cell_of(key, cuts, mid + 1, high))


def byte_cuts(sizes: DataFrame, target: int) -> list[int]:
    """Upper bounds of key ranges that hold about `target` bytes each, from (key, size); at most CELLS sums a range
    reach the driver. The last bound is the largest key. A single key is never cut."""
    row = sizes.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("size").alias("size")).first()
    if row["low"] is None:
        return [0]
    done, open_ranges = [], [(row["low"], row["high"])]
    while open_ranges:
        tops = [b for _, b in open_ranges]
        low = F.element_at(F.array(*[F.lit(a) for a, _ in open_ranges]), F.col("r") + 1)
        steps = [-(-(b - a + 1) // CELLS) for a, b in open_ranges]
        step = F.element_at(F.array(*[F.lit(min(s, LAST)) for s in steps]), F.col("r") + 1)
        inside = sizes.withColumn("r", cell_of(F.col("key"), tops)).withColumn("low", low)
        # Distances may not fit a long: halves do, and a cell's number is the same.
        far = F.floor((F.col("key").cast("decimal(38,0)") - F.col("low").cast("decimal(38,0)")) / step)
        sums = (inside.where("key >= low").groupBy("r", far.cast("bigint").alias("c"))
                .agg(F.sum("size").alias("size")).collect())
        refine = []
        for r, c, size in sorted(tuple(x) for x in sums):
            a = open_ranges[r][0] + c * steps[r]
            b = min(a + steps[r] - 1, open_ranges[r][1])
            (refine if size > target and b > a else done).append((a, b, size))
        open_ranges = [(a, b) for a, b, _ in refine]
    cuts, held = [], 0
    for a, b, size in sorted(done):
        if held and held + size > target:
            cuts.append(a - 1)
            held = 0
        held += size
    return [*cuts, row["high"]]


def _uri(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{key}:{digest}'.encode()).digest()[:16])}>"


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{name}: {value}\r\n" for name, value in headers if value is not None]
    head = f"WARC/1.1\r\n{''.join(lines)}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(key: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    """One response, or the revisit of `original`'s; a revisit's block has the HTTP headers only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    revisit = original is not None
    block = http if revisit else http + payload
    return _record([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(key, digest)),
        ("WARC-Date", DATE), ("WARC-Target-URI", url and _uri(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", _record_id(original, digest) if revisit else None),
        ("X-Row-Key", None if key is None else str(key)), ("X-Refers-To-Key", str(original) if revisit else None)], block)


class _File:
    """One archive file under a temporary name."""

    def __init__(self, store: fs.FileSystem, root: str, shard: int, number: int):
        self.name = f"part-{shard:06d}-{number:04d}.warc.gz"
        self.temporary = f"tmp/{self.name}.{uuid.uuid4().hex}"
        self.shard, self.records, self.size, self.digest = shard, 0, 0, hashlib.sha256()
        self.out = store.open_output_stream(f"{root}/{self.temporary}", compression=None)
        info = f"software: tidelog\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        self.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, self.name)), ("WARC-Date", DATE),
                            ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"),
                            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(info).hexdigest()}")], info))

    def write(self, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.name, self.temporary, self.records, self.size, self.digest.hexdigest()


MANIFEST = "shard int, name string, temporary string, records bigint, size bigint, sha256 string"


def write_pages(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) to archives in `folder`; returns the manifest.

    A null html has an empty payload; a null url has no target; a null page_id sorts first, is never referred to, and
    is a revisit where another record has its payload. Rows with equal page_id and payload are responses alike, or
    revisits alike. An empty table gives an empty manifest; other columns are not read.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", F.coalesce("page_id", F.lit(LOWEST)).alias("key"), "url", payload.alias("payload"))
    sizes = rows.select("key", F.octet_length("payload").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    cuts = byte_cuts(sizes, max(shard_bytes, total // MOST_SHARDS))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "shard": cell_of(F.col("key"), cuts)})
    small = rows.where(F.octet_length("payload") >= MIN_SHARED).select("page_id", "key", "shard", "digest")
    shared = small.groupBy(F.col("digest").alias("d")).agg(
        F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 AND original IS NOT NULL")
    verdicts = small.join(shared, F.col("digest") == F.col("d")).where("page_id IS NULL OR page_id > original").select(
        "shard", "key", "digest", "original").distinct()
    every = rows.unionByName(verdicts, allowMissingColumns=True)
    every = every.repartition(max(partitions(spark), len(cuts)), "shard").sortWithinPartitions(
        "shard", "key", "digest", F.col("payload").isNotNull(), "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/tmp", recursive=True)
        file, number, verdict, done = None, 0, None, []
        for batch in pieces(batches, "payload"):
            for shard, key, digest, original, page_id, url, payload in zip(*(batch.column(c).to_pylist() for c in (
                    "shard", "key", "digest", "original", "page_id", "url", "payload"))):
                if payload is None:
                    verdict = (key, digest, original)
                    continue
                if file and (file.shard != shard or file.size >= file_bytes):
                    number = number + 1 if file.shard == shard else 0
                    done.append(file.close())
                    file = None
                file = file or _File(store, root, shard, number)
                again = verdict[2] if verdict and verdict[:2] == (key, digest) else None
                file.write(page_record(page_id, url, payload, digest, again))
        if file:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(
                ("shard", "name", "temporary", "records", "size", "sha256"), row)) for row in done], _ARROW)

    written = every.select("shard", "key", "digest", "original", "page_id", "url", "payload").mapInArrow(tidy(write), MANIFEST)
    written.write.mode("overwrite").parquet(f"{folder}/pending")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist()):
                if store.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                    store.move(f"{root}/{temporary}", f"{root}/{name}")
            yield batch

    pending = spark.read.schema(MANIFEST).parquet(f"{folder}/pending")
    pending.mapInArrow(tidy(commit), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


_ARROW = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()),
                    ("size", pa.int64()), ("sha256", pa.string())])


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a decompressed stream; digests are checked."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"a block does not have its digest: {headers['warc-record-id']}")
        yield headers, block


def read_pages(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the manifest names: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    A revisit's payload is null, its digest and size are those of the whole payload. Without `payloads` none are returned.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        rows, size = [], 0
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in records(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        rows.append(_row(headers, block, payloads))
                        size += len(block)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _PAGES)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _PAGES)

    names = read_manifest(spark, folder).select("name").repartition(partitions(spark))
    return names.mapInArrow(tidy(read), "page_id bigint, url string, record_type string, refers_to bigint, "
                                  "payload_digest string, payload_bytes bigint, payload binary")


_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    response = headers["warc-type"] == "response"
    if response and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"a payload does not have its digest: {headers['warc-record-id']}")
    key, other = headers.get("x-row-key"), headers.get("x-refers-to-key")
    return {"page_id": key and int(key), "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"],
            "refers_to": other and int(other), "payload_digest": digest, "payload_bytes": length,
            "payload": payload if payloads and response else None}


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, and list what is read back from them."""
    folder = f"{shared_folder(pages.sparkSession)}/warc"
    write_pages(pages.select("page_id", "url", "html"), folder)
    return read_pages(pages.sparkSession, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
