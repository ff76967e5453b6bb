"""Jaccard join on word shingles by parity sketches.

A document is the set of its distinct shingles. Two sets link when THRESHOLD percent of their union is shared; then
their symmetric difference has at most (a + b) / 7 elements (a, b: their sizes, at 75 percent).

*Sketch.* The 64-bit hash of a shingle names a segment of the sketch and is XORed into it, so equal shingles of two sets
cancel out: the number of segments in which two sketches differ is at most the symmetric difference.
*Pigeonhole.* Sizes fall into bands [lo, 2 lo); a set takes part in a band as partner if it has 0.75 lo elements or
more. A band's sketch has more segments than any linked pair of the band can differ in, so linked sets agree in some
segment, and segments are join keys. Empty segments say nothing and are no keys; a set with so many of them that the
argument fails adds the keys of its shortest sufficient prefix in hash order, which two such sets share.
*Join.* Keys travel packed, many to a row. Sets that meet in a key form a bucket. Equal sets are one set throughout.
*Verify.* A second sketch of single bits bounds the symmetric difference of two sets from below and removes most false
candidates; the rest are compared exactly.

Groups need less than all pairs. First as many pairs of a bucket are compared, the nearest, as tie its members together; one of
more than a block is dealt into blocks at random, twice, and only members of one block are compared, which costs in proportion
to the bucket: copies of one text are then one component, and their buckets are done. A bucket is looked at again if it had more
pairs, or more than a block, and still holds different components; then if these had too many pairs to compare them all
at once. In the last look all that are left are compared, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import partitions, pieces, shared_folder, stored, text_bytes, text_hash, tidy
from tidelog.llm.components import components
from tidelog.llm.words import hashes, mix, runs, spans, whole

SHINGLE = 5
SMALLEST = 3  # smaller sets link with equal ones only
CHUNK = 1 << 15  # members to a row
SKETCH_BITS = 1024  # of a sketch of single bits, at least
CELL = 1024  # members of a block of a large bucket
TURNS = 2  # times that a large bucket is dealt into blocks before its blocks are compared with each other
FEW = 4  # pairs to a member that the second look compares without choosing among them
PAIRS = 1 << 16  # pairs to an Arrow batch
FILTER_BITS = 1 << 22  # the size of a filter of doc_ids, whatever the table's is


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    starts, ends = spans(data, offsets)
    words = hashes(data, starts, ends)
    grams = runs(words, SHINGLE)
    edges = np.searchsorted(starts, offsets)
    out = []
    for low, high in zip(edges[:-1], edges[1:]):
        if high - low >= SHINGLE:
            out.append(np.unique(grams[low:high - SHINGLE + 1]))
        else:
            out.append(np.array([whole(words[low:high])] if high > low else [], np.uint64))
    return out


def set_id(shingles: np.ndarray) -> int:
    return int(whole(shingles).view(np.int64))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def farthest(a, b):
    """The largest symmetric difference of two linked sets of these sizes."""
    return (a + b) // 7


def bands(n: int) -> list[tuple[int, int]]:
    """(index, lo) of each band in which a set of n elements takes part."""
    out, j, lo = [], 0, 4
    while 3 * lo <= 4 * n:
        if n < 2 * lo:
            out.append((j, lo))
        j, lo = j + 1, 2 * lo
    return out


def segments(lo: int) -> int:
    most = farthest(2 * lo - 1, 2 * lo - 1)
    return most + most // 16 + 2


def keys_of(shingles: np.ndarray) -> np.ndarray:
    """The join keys of a set: at least one is shared by any two linked sets that differ."""
    n, out = len(shingles), []
    if n < SMALLEST:
        return np.zeros(0, np.uint64)
    for j, lo in bands(n):
        m = segments(lo)
        at = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with the hash, so segments are runs
        starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        # A linked set agrees in at least `spare` segments that are not empty. Both sets know a bound of their own, and
        # both hold; so each may leave out the last spare - 1 segments, and one that agrees is left.
        spare = len(starts) - farthest(n, min(4 * n // 3, 2 * lo - 1))
        parity = np.bitwise_xor.reduceat(shingles, starts)
        keys = mix(parity + (at[starts] * np.uint64(64) + np.uint64(j)) * np.uint64(0x9E3779B97F4A7C15))
        out.append(keys[at[starts] < np.uint64(m - max(0, spare - 1))])
        if spare < 1:
            prefix = shingles[:n - (3 * n + 3) // 4 + 1]
            out.append(mix(prefix ^ np.uint64(0x5851F42D4C957F2D + j)))
    return np.concatenate(out)


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles per bit; one bit or more to a shingle, a power of two in all.

    Short sets get many bits to a shingle: then few pairs pass that are just below the threshold.
    """
    bits = max(SKETCH_BITS, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def halved(words: np.ndarray) -> np.ndarray:
    """Sketches of half the length: both halves XORed."""
    half = words.shape[1] // 2
    return words[:, :half] ^ words[:, half:]


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, n_shingles, set_id, sketch) per row of `docs`; set_id is null for a text without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([bit_sketch(s) if len(s) >= SMALLEST else None for s in sets], pa.binary())],
                ["doc_id", "row_hash", "n_shingles", "set_id", "sketch"])

    rows = docs.select("doc_id", text_hash().alias("row_hash"), "text")
    return rows.mapInArrow(tidy(sketch), f"doc_id {kind}, row_hash bigint, n_shingles bigint, set_id bigint, sketch binary")


def buckets(docs: DataFrame) -> DataFrame:
    """(bucket, size, members): sets that share a key, as packed set ids. A bucket's name is its content, and each comes once."""
    n = partitions(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            sets = {set_id(s): s for s in shingle_sets(batch.column("t")) if len(s) >= SMALLEST}
            if not sets:
                continue
            ids = np.array(list(sets), np.int64)
            each = [keys_of(s) for s in sets.values()]
            keys = np.concatenate(each)
            owner = np.repeat(np.arange(len(ids)), [len(k) for k in each])
            part = (keys % np.uint64(n)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(n + 1))
            used = [i for i in range(n) if edges[i + 1] > edges[i]]
            names, packed, places = [], [], []
            for i in used:
                at = order[edges[i]:edges[i + 1]]
                own, place = np.unique(owner[at], return_inverse=True)
                names.append(ids[own].tobytes())
                places.append(place.astype(np.uint16).tobytes())
                packed.append(np.ascontiguousarray(keys[at].view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(names, pa.binary()), pa.array(places, pa.binary()),
                 pa.array(packed, pa.binary())], ["part", "names", "places", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by part; keys meet within a part."""
        part, held = None, []
        for batch in batches:
            for i, p in enumerate(batch.column("part").to_pylist()):
                if p != part and held:
                    yield from _met(held)
                    held = []
                part = p
                held.append([batch.column(c)[i].as_py() for c in ("names", "places", "packed")])
        if held:
            yield from _met(held)

    rows = docs.select(F.col("text").alias("t")).mapInArrow(tidy(emit), "part int, names binary, places binary, packed binary")
    met = rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(tidy(meet), "bucket bigint, size bigint, members binary")
    return met.distinct()  # parts may have buckets with the same members


def _met(rows: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    keys, ids = [], []
    for names, places, packed in rows:
        wide = np.zeros((len(packed) // 6, 8), np.uint8)
        wide[:, 2:] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
        keys.append(wide.view(np.uint64)[:, 0])
        ids.append(np.frombuffer(names, np.int64)[np.frombuffer(places, np.uint16)])
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[fresh], ids[fresh]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    names = mix(np.add.reduceat(mix(ids.view(np.uint64)), starts) + sizes.astype(np.uint64))
    shared = np.flatnonzero(sizes > 1)
    _, first = np.unique(names[shared], return_index=True)
    shared = shared[first]  # buckets with the same members say the same
    for low in range(0, len(shared), 4096):
        out_names, out_sizes, out = [], [], []
        for g in shared[low:low + 4096]:
            whole_bucket = ids[starts[g]:starts[g] + sizes[g]]
            for at in range(0, len(whole_bucket), CHUNK):
                out_names.append(int(names[g].view(np.int64)))
                out_sizes.append(len(whole_bucket))
                out.append(whole_bucket[at:at + CHUNK].tobytes())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out_names, pa.int64()), pa.array(out_sizes, pa.int64()),
                                              pa.array(out, pa.binary())], ["bucket", "size", "members"])


def members(table: DataFrame) -> DataFrame:
    """(bucket, size, x) with a row for each member."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                each = [np.frombuffer(m, np.int64) for m in part.column("members").to_pylist()]
                counts = [len(m) for m in each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), counts), pa.int64())
                     for c in ("bucket", "size")] + [pa.array(np.concatenate(each), pa.int64())], ["bucket", "size", "x"])

    return table.mapInArrow(tidy(expand), "bucket bigint, size bigint, x bigint")


def cells(rows: DataFrame, turn) -> DataFrame:
    """Members with the pair of blocks (i, j) of their bucket in which they are compared, so that no group is unbounded.

    With a `turn`, a number or a column of them, a member is in its own block alone, which is another one each turn;
    without, in all pairs of its block.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / CELL).cast("int"))
    if turn is None:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    else:
        block = F.pmod(F.xxhash64("x", F.lit(turn)), F.col("blocks")) + F.lit(turn) * F.col("blocks")
        rows = rows.withColumn("block", block.cast("int")).withColumn("other", F.col("block"))
    return rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       "block", "x", "component", "n", "sketch")


def near_pairs(rows: DataFrame, few: int | None = None, turns: int = 0) -> DataFrame:
    """(x, y, bucket): pairs of different components that share a cell and that the bit sketches do not rule out.

    `rows` are (bucket, size, x, component, n, sketch). With `few`, of a cell with more pairs than that to a member only as
    many are given, the nearest, as tie its components together, and a row names the bucket instead of a pair if that
    left any out. With `turns` large buckets are dealt that often into blocks, and blocks are not compared with each other.
    """
    if turns:
        last = F.when(F.col("size") > CELL, F.lit(turns - 1)).otherwise(F.lit(0))
        rows = cells(rows.withColumn("turn", F.explode(F.sequence(F.lit(0), last))), F.col("turn"))
    else:
        rows = cells(rows, None)
    n = partitions(rows.sparkSession)
    rows = rows.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cell, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in
                             ("bucket", "i", "j", "block", "x", "component", "n", "sketch"))):
                if row[:3] != cell:
                    yield cell, *_near(cell, held, few)
                    cell, held = row[:3], []
                held.append(row[3:])
        yield cell, *_near(cell, held, few)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, marks, size = [], [], [], 0
        for cell, x, y, all_of_them in found(batches):
            if len(x):
                xs.append(x)
                ys.append(y)
                size += len(x)
            if not all_of_them:
                marks.append(cell[0])
            if size >= PAIRS:
                yield _batch(xs, ys, marks)
                xs, ys, marks, size = [], [], [], 0
        if xs:
            yield _batch(xs, ys, marks)

    return rows.mapInArrow(tidy(compare), "x bigint, y bigint, bucket bigint").distinct()


def _batch(xs: list[np.ndarray], ys: list[np.ndarray], marks: list[int]) -> pa.RecordBatch:
    x, y = np.concatenate(xs), np.concatenate(ys)
    none = pa.nulls(len(marks), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([pa.array(np.minimum(x, y)), none]), pa.concat_arrays([pa.array(np.maximum(x, y)), none]),
         pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(marks, pa.int64())])], ["x", "y", "bucket"])


def _near(cell, held: list[tuple], few: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a cell, and whether they are all."""
    if len(held) < 2 or len(held) == 2 and not _pair(cell, *held):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, True
    if len(held) == 2:
        return np.array([held[0][1]]), np.array([held[1][1]]), True
    held.sort(key=lambda h: (len(h[4]), h[3], h[1]))  # the same in every bucket, and so are the pairs chosen
    block, x, component, n = (np.array([h[i] for h in held]) for i in range(4))
    first = second = np.arange(len(held))
    if cell[1] != cell[2]:
        first, second = np.flatnonzero(block == cell[1]), np.flatnonzero(block != cell[1])
    else:
        names, counts = np.unique(component, return_counts=True)
        if 2 * counts.max() > len(held):  # pairs within the largest component need no distance
            first = np.flatnonzero(component != names[counts.argmax()])
    apart = _distances([h[4] for h in held], n, first, second)
    apart[component[:, None] == component] = FAR
    near = np.triu(apart < FAR)
    count = np.count_nonzero(near)
    if few is None or count <= max(1, few * len(held)):
        a, b = np.nonzero(near)
    else:
        a, b = _spanning(apart, component)
    return x[a], x[b], len(a) == count


def _pair(cell, a: tuple, b: tuple) -> bool:
    """What _near finds of two members, by far the most frequent cell, without arrays."""
    if a[2] == b[2] or cell[1] != cell[2] and a[0] == b[0] or 4 * min(a[3], b[3]) < 3 * max(a[3], b[3]):
        return False
    x, y = sorted((a[4], b[4]), key=len)
    apart = int.from_bytes(x) ^ int.from_bytes(y[:len(x)])
    if len(x) < len(y):
        apart ^= int.from_bytes(y[len(x):])
    return apart.bit_count() <= farthest(a[3], b[3])


FAR = np.iinfo(np.int32).max


def _distances(sketches: list[bytes], n: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bits in which sketches of `first` and `second` differ, FAR where that or the sizes rule a link out, and elsewhere.

    Rows are sorted by the sketch's length, then by n. Linked sets are so close in size that their sketches have one length,
    or one twice the other's; the longer one is then halved.
    """
    out = np.full((len(n), len(n)), FAR, np.int32)
    length = np.array([len(s) for s in sketches])
    columns = {}
    for size in np.unique(length[second]).tolist():
        at = second[length[second] == size]
        columns[size] = at, unpacked([sketches[c] for c in at.tolist()])
    for size in np.unique(length[first]).tolist():
        rows = first[length[first] == size]
        own = unpacked([sketches[r] for r in rows.tolist()])
        for other in (size // 2, size, 2 * size):
            if other not in columns:
                continue
            at, words = columns[other]
            mine, theirs = halved(own) if other < size else own, halved(words) if other > size else words
            sizes = n[at]
            low, high = np.searchsorted(sizes, (3 * n[rows] + 3) // 4), np.searchsorted(sizes, 4 * n[rows] // 3, side="right")
            if first is second:
                low = np.maximum(low, np.searchsorted(at, rows, side="right"))
            for r, mask, lo, hi in zip(rows.tolist(), mine, low.tolist(), high.tolist()):
                if lo < hi:
                    apart = np.bitwise_count(theirs[lo:hi] ^ mask).sum(axis=1, dtype=np.int32)
                    out[r, at[lo:hi]] = np.where(apart <= farthest(sizes[lo:hi], n[r]), apart, FAR)
    return np.minimum(out, out.T)


def _spanning(apart: np.ndarray, component: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs that tie the components together as far as distances allow, the nearest of each component first."""
    _, label = np.unique(component, return_inverse=True)
    a, b = [], []
    apart = apart.copy()
    while True:
        best = apart.argmin(axis=1)
        least = apart[np.arange(len(apart)), best]
        order = np.lexsort((least, label))
        heads = order[np.unique(label[order], return_index=True)[1]]  # the nearest row of each component
        heads = heads[least[heads] < FAR]
        if not len(heads):
            return a, b
        parent = np.arange(label.max() + 1)
        for r in heads.tolist():
            i, j = label[r], label[best[r]]
            while parent[i] != i:
                i = parent[i]
            while parent[j] != j:
                j = parent[j]
            if i != j:
                parent[max(i, j)] = min(i, j)
                a.append(r)
                b.append(int(best[r]))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
        apart[label[:, None] == label] = FAR


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sets link, by exact comparison. `texts` is (set_id, text)."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_x"):
            for part in pieces([batch], "text_y"):
                a, b = shingle_sets(part.column("text_x")), shingle_sets(part.column("text_y"))
                yield part.select(["x", "y"]).filter(pa.array([linked(s, t) for s, t in zip(a, b)], pa.bool_()))

    of_x = texts.select(F.col("set_id").alias("x"), F.col("text").alias("text_x"))
    of_y = texts.select(F.col("set_id").alias("y"), F.col("text").alias("text_y"))
    return pairs.join(of_x, "x").join(of_y, "y").select("x", "y", "text_x", "text_y").mapInArrow(
        tidy(check), "x bigint, y bigint")


class JaccardJoin:
    """The join over one table of documents; its intermediate tables lie in the shared folder."""

    def __init__(self, docs: DataFrame):
        self.folder = shared_folder(docs.sparkSession)
        self.docs = docs.select("doc_id", "text")
        self.sets = stored(describe(self.docs), self.folder, "sets")
        self.buckets = stored(buckets(self.docs), self.folder, "buckets")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash"))
        owners = self.sets.where("set_id IS NOT NULL").groupBy("set_id").agg(
            first.alias("row"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        owners = owners.select("set_id", F.col("row.doc_id").alias("owner"), F.col("row.row_hash").alias("owner_row"), "n", "sketch")
        met = members(self.buckets).select(F.col("x").alias("m")).distinct()
        self.owners = stored(owners.join(met, F.col("set_id") == F.col("m")).drop("m"), self.folder, "owners")

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Only texts of the pairs are fetched. They are found by doc_id and their sets computed anew, since rows may
        share a doc_id or have none. `pairs` is a stored table."""
        ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
        wanted = self.owners.join(ids, F.col("set_id") == F.col("id")).select(
            "owner", "owner_row", F.col("set_id").alias("wanted"))
        wanted = stored(wanted, self.folder, f"{name}-wanted")
        found = _perhaps(self.docs, wanted).join(wanted, F.col("doc_id").eqNullSafe(F.col("owner")) & (text_hash() == F.col("owner_row")))
        texts = stored(_right_text(found), self.folder, f"{name}-texts")
        return verified(pairs, texts)

    def _labelled(self, table: DataFrame, labels: DataFrame | None) -> DataFrame:
        """(bucket, size, x, component) per member of the buckets of `table`."""
        every = members(table)
        if labels is None:
            return every.withColumn("component", F.col("x"))
        labels = labels.select(F.col("x").alias("node"), F.col("y").alias("root"))
        return every.join(labels, F.col("x") == F.col("node"), "left").select(
            "bucket", "size", "x", F.coalesce("root", "x").alias("component"))

    def _open(self, table: DataFrame, labels: DataFrame) -> DataFrame:
        """The buckets of `table` that hold more than one component."""
        ends = self._labelled(table, labels).groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"))
        return table.join(ends.where("a <> b").select("bucket"), "bucket", "left_semi").select(table.columns)

    def _members(self, table: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Members of the buckets of `table` with what near_pairs needs."""
        traits = self.owners.select(F.col("set_id").alias("x"), "n", "sketch")
        return self._labelled(table, labels).join(traits, "x").select("bucket", "size", "x", "component", "n", "sketch")

    def _rows(self, labels: DataFrame | None, large: bool = False) -> DataFrame:
        """Members of the buckets (or of the large ones) that hold more than one component, with what near_pairs needs."""
        table = self.buckets.where(F.col("size") > CELL) if large else self.buckets
        return self._members(table if labels is None else self._open(table, labels), labels)

    def links(self) -> DataFrame:
        """All pairs (x, y) of different sets that link, by set_id; `sets` tells which documents have a set."""
        pairs = stored(near_pairs(self._rows(None)).select("x", "y"), self.folder, "links-pairs")
        return self._verified(pairs, "links")

    def _look(self, rows: DataFrame, labels: DataFrame | None, name: str, few: int | None, turns: int = 0) -> tuple[DataFrame, DataFrame]:
        """Components with the links among the pairs of `rows`, and the buckets that had more pairs."""
        found = stored(near_pairs(rows, few, turns), self.folder, f"{name}-pairs")
        links = self._verified(found.where("bucket IS NULL").select("x", "y"), name)
        labels = components(links if labels is None else labels.unionAll(links), self.folder, name)
        return labels, found.where("bucket IS NOT NULL").select("bucket")

    def _turns(self) -> DataFrame:
        """Components as the first look shows them, in which large buckets are compared within their blocks alone."""
        return self._first()[0]

    def _first(self) -> tuple[DataFrame, DataFrame]:
        return self._look(self._members(self.buckets, None), None, "first", 0, TURNS)

    def groups(self) -> DataFrame:
        """(x, y): each set that is not the least of its component, and the least."""
        labels, more = self._first()
        again = self.buckets.where(F.col("size") <= CELL).join(more, "bucket", "left_semi").select(self.buckets.columns)
        again = again.unionAll(self.buckets.where(F.col("size") > CELL))
        for name, few in (("second", FEW), ("rest", None)):
            again = stored(self._open(again, labels), self.folder, f"{name}-buckets")
            if again.agg(F.count(F.lit(1))).first()[0] == 0:
                break
            labels, more = self._look(self._members(again, labels), labels, name, few)
            again = again.join(more, "bucket", "left_semi").select(self.buckets.columns)
        return labels

    def documents(self) -> DataFrame:
        """(doc_id, row_hash, n_shingles, component, component_id) per row. component_id is the least doc_id that links
        reach; component names the group also where doc_ids are shared, and is null for documents without shingles."""
        labels = self.groups().select(F.col("x").alias("node"), F.col("y").alias("root"))
        sets = self.sets.select("doc_id", "row_hash", "n_shingles", "set_id")
        of_set = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least"))
        of_set = of_set.join(labels, F.col("set_id") == F.col("node"), "left").select(
            F.col("set_id"), F.coalesce("root", "set_id").alias("component"), "least")
        of_root = of_set.groupBy(F.col("component").alias("top")).agg(F.min("least").alias("component_id"))
        of_set = of_set.join(of_root, F.col("component") == F.col("top")).select(
            F.col("set_id").alias("named"), "component", "component_id")
        return sets.join(of_set, F.col("set_id") == F.col("named"), "left").select(
            "doc_id", "row_hash", "n_shingles", "component",
            F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _cell(doc_id: str):
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS)).cast("int")


def _perhaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose doc_id may be an owner's, by a filter of fixed size, so that the others' texts don't travel."""
    cells = wanted.select(_cell("owner").alias("cell")).distinct().toArrow().column(0)  # at most FILTER_BITS numbers
    bits = np.zeros(FILTER_BITS, bool)
    bits[np.asarray(cells, dtype=np.int64)] = True
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[np.asarray(batch.column("cell"))])).select(["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _cell("doc_id").alias("cell")).mapInArrow(tidy(keep), f"doc_id {kind}, text string")


def _right_text(found: DataFrame) -> DataFrame:
    """The texts that have the wanted set. Equal rows, which one task gets after the join, give one text."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in pieces(batches, "text"):
            ids = [set_id(s) for s in shingle_sets(batch.column("text"))]
            good = [i == w and w not in seen and not seen.add(w) for i, w in zip(ids, batch.column("set_id").to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return found.select(F.col("wanted").alias("set_id"), "text").mapInArrow(tidy(keep), "set_id bigint, text string")


def group_documents(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles and component_id.

    Null and empty texts, and texts without words, have no shingles and link with nothing; a text of fewer than SHINGLE
    words is one shingle. Rows that share a doc_id are separate documents of that id. An empty table gives an empty
    result; other columns are not read. Null doc_ids are never the least unless all of a component are null.
    """
    return JaccardJoin(docs).documents().select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group: the one with the least doc_id, of several with that doc_id the one whose
    text has the least hash. Equal rows are one document and stay together; documents without shingles all stay."""
    rows = JaccardJoin(docs).documents()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    best = rows.where("component IS NOT NULL").groupBy(F.col("component").alias("c")).agg(F.min(rank).alias("best"))
    gone = rows.join(best, F.col("component") == F.col("c")).where(~rank.eqNullSafe(F.col("best"))).select(
        F.col("doc_id").alias("tidelog__gone_id"), F.col("row_hash").alias("tidelog__gone_row")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("tidelog__gone_id")) & (text_hash() == F.col("tidelog__gone_row")), "left_anti")
