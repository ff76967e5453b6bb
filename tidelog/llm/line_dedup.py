"""Line de-duplication that can be undone: exact reference tables behind sharded cuckoo filters.

A line's key is the line without ASCII white space at both ends, with A-Z in lower case. Keys of at least `min_chars`
code points found in at least `min_docs` documents are *common*: they lose all their lines, except in the largest
doc_id that holds them.

State, a folder of Parquet tables, one folder per version:

* `refs`: one row (k1, k2, doc_id) per key and document that holds it; k1 and k2 are a 128-bit hash of the key. This is
  the exact reference table: a key's count is its number of rows.
* `common`: the keys whose count has reached `min_docs`, with the count and the largest doc_id.
* `filters`: per shard of k1 a cuckoo filter of the common keys. Adding documents inserts the keys that cross the
  threshold upwards; deleting documents removes those that cross it downwards. A filter that is full is built anew,
  larger, from the exact table.

Applying the state to documents streams their line hashes past the filter of their shard, and only the few hits are
joined with the exact table, which removes false positives.

Null doc_ids count as one document, smaller than all others. Null and empty texts are one empty line, which is never a
key. Repeated rows with one doc_id are one document. An empty table gives an empty state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import partitions, shared_folder, text_hash, tidy
from tidelog.llm.cuckoo import CuckooFilter

SHARDS = 64
CELLS = 4  # parts of a shard's lines, at least
MIN_CHARS = 40
MIN_DOCS = 5
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

REFS = "k1 bigint, k2 bigint, doc_id bigint"
COMMON = "k1 bigint, k2 bigint, n_docs bigint, last_doc bigint, common_shard int"
FILTERS = "shard int, table binary"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _shard(k1: Column) -> Column:
    return F.pmod(k1, F.lit(SHARDS)).cast("int")


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_hash, line_no, k1, k2) of every line whose key is long enough."""
    lines = docs.select("doc_id", text_hash().alias("row_hash"),
                        F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    lines = lines.select("doc_id", "row_hash", "line_no", line_key(F.col("line")).alias("key"))
    return lines.where(F.length("key") >= min_chars).select(
        "doc_id", "row_hash", "line_no", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The exact reference rows of some documents: each key once per document that holds it."""
    return line_keys(docs, min_chars).select("k1", "k2", "doc_id").distinct()


def common_keys(refs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    counted = refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
    return counted.where(F.col("n_docs") >= min_docs).withColumn("common_shard", _shard(F.col("k1")))


def filters_of(common: DataFrame) -> DataFrame:
    """A cuckoo filter per shard, from the exact table."""
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(rows["k1"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [rows["common_shard"].iloc[0]], "table": [CuckooFilter.of(keys).dump()]})

    return common.select("common_shard", "k1").groupBy("common_shard").applyInPandas(build, FILTERS)


def changed_filters(filters: DataFrame, gone: DataFrame, come: DataFrame, common: DataFrame) -> DataFrame:
    """Filters after keys crossed the threshold; a filter that gets full is built anew from `common`."""
    crossed = (gone.select("k1", _shard(F.col("k1")).alias("s"), F.lit(False).alias("added"))
               .unionAll(come.select("k1", _shard(F.col("k1")).alias("s"), F.lit(True).alias("added"))))

    def change(key, old: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.load(old["table"].iloc[0]) if len(old) else CuckooFilter(2)
        hashes = moves["k1"].to_numpy(np.int64).view(np.uint64)
        for h, added in zip(hashes, moves["added"]):
            if not added and not held.remove(h) or added and not held.add(h):
                return pd.DataFrame({"shard": [key[0]], "table": [None]})
        return pd.DataFrame({"shard": [key[0]], "table": [held.dump()]})

    moved = (filters.groupBy("shard").cogroup(crossed.groupBy("s")).applyInPandas(change, FILTERS))
    full = moved.where("table IS NULL").select(F.col("shard").alias("common_shard"))
    return moved.where("table IS NOT NULL").unionAll(filters_of(common.join(full, "common_shard", "left_semi")))


class LineState:
    """The reference tables and filters at one path; every change writes a new version beside the old one."""

    def __init__(self, spark: SparkSession, path: str, version: int = 0, min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS):
        self.spark, self.path, self.version = spark, path, version
        self.min_chars, self.min_docs = min_chars, min_docs

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{self.version}/{name}")

    def refs(self) -> DataFrame:
        return self._read("refs", REFS)

    def common(self) -> DataFrame:
        return self._read("common", COMMON)

    def filters(self) -> DataFrame:
        return self._read("filters", FILTERS)

    @classmethod
    def create(cls, docs: DataFrame, path: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               keep_refs: bool = True) -> LineState:
        """State of a first batch of documents. Without `keep_refs` it can be applied, but not changed later."""
        state = cls(docs.sparkSession, path, 0, min_chars, min_docs)
        refs = references(docs, min_chars)
        if keep_refs:
            refs.write.mode("overwrite").parquet(f"{path}/v0/refs")
            refs = state.refs()
        common_keys(refs, min_docs).write.mode("overwrite").parquet(f"{path}/v0/common")
        filters_of(state.common()).write.mode("overwrite").parquet(f"{path}/v0/filters")
        return state

    def _next(self, refs: DataFrame) -> LineState:
        after = LineState(self.spark, self.path, self.version + 1, self.min_chars, self.min_docs)
        refs.write.mode("overwrite").parquet(f"{self.path}/v{after.version}/refs")
        common_keys(after.refs(), self.min_docs).write.mode("overwrite").parquet(f"{self.path}/v{after.version}/common")
        keys = ["k1", "k2"]
        gone = self.common().join(after.common().select(*keys), keys, "left_anti")
        come = after.common().join(self.common().select(*keys), keys, "left_anti")
        changed_filters(self.filters(), gone, come, after.common()).write.mode("overwrite").parquet(
            f"{self.path}/v{after.version}/filters")
        return after

    def add(self, docs: DataFrame) -> LineState:
        """Insert documents. Documents that are held already change nothing."""
        return self._next(self.refs().unionAll(references(docs, self.min_chars)).distinct())

    def delete(self, doc_ids: DataFrame) -> LineState:
        """Take out documents by doc_id; lines that were dropped for their sake come back."""
        gone = doc_ids.select(F.col("doc_id").alias("gone_id")).distinct()
        return self._next(self.refs().join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti"))

    def hits(self, docs: DataFrame) -> DataFrame:
        """The lines to drop: (doc_id, row_hash, line_no). Filters first, then the exact table."""
        lines = line_keys(docs, self.min_chars).withColumn("shard", _shard(F.col("k1")))
        # Each filter goes to every cell of its shard, ahead of the lines; a task holds one filter at a time. Cells
        # follow the document, so that a very common line is spread over them.
        cells = max(CELLS, partitions(self.spark) // SHARDS)
        lines = lines.withColumn("cell", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(cells)).cast("int"))
        spread = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
        tables = self.filters().select("shard", "table", spread.alias("cell"))
        rows = tables.unionByName(lines, allowMissingColumns=True)
        rows = rows.repartition(partitions(self.spark), "shard", "cell").sortWithinPartitions(
            "shard", "cell", F.col("table").isNull())
        probed = rows.select("shard", "cell", "table", "doc_id", "row_hash", "line_no", "k1", "k2").mapInArrow(
            tidy(_probe), "doc_id bigint, row_hash bigint, line_no int, k1 bigint, k2 bigint")
        exact = self.common().select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "last_doc")
        found = probed.join(exact, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
        return found.where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).select("doc_id", "row_hash", "line_no")

    def apply(self, docs: DataFrame) -> DataFrame:
        """Documents with `text` less its common lines, and two counts: `lines_before` and `lines_dropped`.

        All columns of `docs` are kept. A null text stays null when nothing was dropped from it.
        """
        drops = self.hits(docs).groupBy(F.col("doc_id").alias("tidelog__drop_doc"), F.col("row_hash").alias("tidelog__drop_row")).agg(
            F.collect_set("line_no").alias("tidelog__drop_lines"))
        docs = docs.withColumn("tidelog__drop_hash", text_hash())
        joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("tidelog__drop_doc"))
                           & (F.col("tidelog__drop_hash") == F.col("tidelog__drop_row")), "left")
        lines = lines_of(F.col("text"))
        # Kept numbers by a set operation and lines by number: time is linear in the lines, however many of them go.
        kept = F.get(F.transform(F.array(lines), lambda every: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(every) - 1), "tidelog__drop_lines"), lambda i: F.get(every, i))), 0)
        text = F.when(F.col("tidelog__drop_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
        counts = {"lines_before": F.size(lines).cast("bigint"),
                  "lines_dropped": F.when(F.col("tidelog__drop_lines").isNull(), 0).otherwise(F.size("tidelog__drop_lines")).cast("bigint")}
        return joined.withColumns(counts).withColumn("text", text).drop(
            "tidelog__drop_hash", "tidelog__drop_doc", "tidelog__drop_row", "tidelog__drop_lines")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass the lines that the filter before them may hold. Rows come sorted by shard and cell, filter first."""
    held, shard = None, None
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        tables = batch.column("table")
        keys = np.asarray(batch.column("k1").fill_null(0)).view(np.uint64)
        is_table = ~np.asarray(tables.is_null())
        keep = np.zeros(len(batch), bool)
        marks = np.flatnonzero(is_table)
        edges = np.unique([0, *marks, *(np.flatnonzero(np.diff(shards)) + 1), len(batch)])
        for start, end in zip(edges[:-1], edges[1:]):
            if is_table[start]:
                held, shard = CuckooFilter.load(tables[int(start)].as_py()), shards[start]
                start += 1
            if start < end and held is not None and shard == shards[start]:
                keep[start:end] = held.has(keys[start:end])
        yield batch.filter(pa.array(keep)).select(["doc_id", "row_hash", "line_no", "k1", "k2"])


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """De-duplicate the lines of one table against itself, with a state of its own in the shared folder."""
    state = LineState.create(docs, shared_folder(docs.sparkSession), min_chars, min_docs, keep_refs=False)
    return state.apply(docs)


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: lines before, lines dropped, and a digest of the kept text."""
    out = drop_common_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"),
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
