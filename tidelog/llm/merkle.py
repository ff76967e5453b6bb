"""A Merkle manifest of a table: a tree of digests per group, a tree over the groups, a proof for every row.

Nodes have three children. Trees are stored as aligned blocks of eight levels (2187 leaves), each in van Emde Boas
order: a tree of k levels is its upper levels, then its subtrees of h levels one after the other, h being the largest
power of two below k, and both parts are laid out likewise. A node's place follows from its level and index alone
(`address`), and so do the places of its siblings, whatever the size of a cache line or page.

1. Rows are sorted by group and key once, by ranges; a row's index is its place in its range plus the sizes of the ranges
   before it. A hot group lies in many ranges.
2. A task builds the blocks whose leaves it has; block roots are the leaves of the next round, until each group has one
   block. The roots of the groups are then numbered and built in the same way, up to the root.
3. From the root downwards each block gets the path above it, once per block, and hands it on to its children. In the
   last step a row's siblings are looked up in its block; the path above follows. Rounds are few (2187 ** 3 leaves take
   three), no task holds more than a block at a time, and only digests move, never texts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm.common import shared_folder, stored, tidy

ARITY = 3
LEVELS = 8  # node levels of a block: its leaves are the lowest, its root is the highest
SPAN = ARITY ** (LEVELS - 1)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


# ---- layout ------------------------------------------------------------------------------

def slots(levels: int) -> int:
    """Nodes of a full tree."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(level: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of nodes in van Emde Boas order; leaves have level 0."""
    if levels == 1:
        return np.zeros_like(index)
    low = 1 << ((levels - 1).bit_length() - 1)  # levels of the lower subtrees
    if level >= low:
        return address(level - low, index, levels - low)
    below = ARITY ** (low - 1 - level)  # nodes of this level in one subtree
    return slots(levels - low) + index // below * slots(low) + address(level, index % below, low)


@functools.cache
def _addresses(levels: int) -> list[np.ndarray]:
    return [address(level, np.arange(ARITY ** (levels - 1 - level)), levels) for level in range(levels)]


def parent(children: Sequence[bytes]) -> bytes:
    """Digest of a run of digests, which are hashed as lower-case hexadecimal text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def height(n: int, last: bool) -> int:
    """Node levels of a block of n leaves. One that is alone in its tree ends where a single node remains."""
    levels = 1
    while n > 1 and last:
        n, levels = -(-n // ARITY), levels + 1
    return levels if last else LEVELS


class Block:
    """An aligned subtree. Leaves are at level 0; missing nodes at its right edge are empty slots."""

    def __init__(self, nodes: bytes, n: int, levels: int):
        self.nodes, self.n, self.levels, self.places = nodes, n, levels, _addresses(levels)

    @classmethod
    def build(cls, leaves: Sequence[bytes], first: bool) -> Block:
        """`first`: the block is the first of its tree. If it isn't full, it is also the only one."""
        levels, row = height(len(leaves), first and len(leaves) < SPAN), list(leaves)
        out = np.zeros((slots(levels), DIGEST), np.uint8)
        for level in range(levels):
            out[_addresses(levels)[level][:len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST)
            if level + 1 < levels:
                row = [parent(row[i:i + ARITY]) for i in range(0, len(row), ARITY)]
        return cls(out.tobytes(), len(leaves), levels)

    def node(self, level: int, index: int) -> bytes:
        at = int(self.places[level][index]) * DIGEST
        return self.nodes[at:at + DIGEST]

    def root(self) -> bytes:
        return self.node(self.levels - 1, 0)

    def path(self, index: int) -> bytes:
        """For each level below the root: how many siblings stand left and right, and their digests."""
        out, n = [], self.n
        for level in range(self.levels - 1):
            start = index - index % ARITY
            end = min(start + ARITY, n)
            out.append(bytes((index - start, end - index - 1)))
            out += [self.node(level, i) for i in range(start, end) if i != index]
            index, n = index // ARITY, -(-n // ARITY)
        return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Siblings to the left and right, level by level."""
    at = 0
    while at < len(path):
        left, right = path[at] * DIGEST, path[at + 1] * DIGEST
        yield path[at + 2:at + 2 + left], path[at + 2 + left:at + 2 + left + right]
        at += 2 + left + right


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in steps(path):
        leaf = parent((left, leaf, right))
    return leaf


def proof_digest(path: bytes) -> bytes:
    return parent([part for step in steps(path) for part in step])


# ---- leaves ------------------------------------------------------------------------------

def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of a row's fields, in order: `-` for null, else the number of bytes, a colon and the value."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*map(framed, fields.values())).cast("binary"), 256))


def numbered(rows: DataFrame, group: str, order: Sequence[str], folder: str, name: str) -> DataFrame:
    """Rows with `at`, their place from 0 within their group by `order`, and `gid`, the place of their group.

    Nulls come first, strings are compared bytewise, null groups are a group. Rows equal in `order` have any order.
    The sorted rows are stored, so that places don't change if a task is run again.
    """
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ordered = stored(ordered.withColumn("row__", F.monotonically_increasing_id()), folder, name)
    ordered = ordered.withColumn("range__", F.shiftright("row__", 33))
    sizes = ordered.groupBy("range__", group).agg(F.count(F.lit(1)).alias("n"), F.min("row__").alias("first"))
    before = Window.partitionBy(group).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    # A range holds whole runs of small groups: count the groups that begin in each range, then those inside it.
    begins = sizes.groupBy(group).agg(F.min("range__").alias("range__"))
    inside = Window.partitionBy("range__").orderBy(group)
    begins = begins.withColumn("place", F.row_number().over(inside) - 1)
    per_range = begins.groupBy("range__").agg(F.count(F.lit(1)).alias("groups"))
    ranges = per_range.withColumn("base", F.coalesce(F.sum("groups").over(
        Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range__", "base")  # a row a range
    gids = begins.join(ranges, "range__").select(F.col(group).alias("group__"), (F.col("base") + F.col("place")).alias("gid"))
    starts = starts.join(gids, starts[group].eqNullSafe(gids["group__"])).select(
        F.col("range__").alias("r__"), "group__", "start", "gid")
    joined = ordered.join(starts, (F.col("range__") == F.col("r__")) & ordered[group].eqNullSafe(F.col("group__")))
    return joined.select(*[F.col(c) for c in rows.columns], (F.col("row__") + F.col("start")).alias("at"), F.col("gid").cast("bigint").alias("gid"))


# ---- rounds ------------------------------------------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), len(batch)]
        if held and any(held[-1].column(k)[len(held[-1]) - 1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(cuts, cuts[1:]):
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


BLOCKS = "gid bigint, block bigint, n int, levels int, nodes binary, root binary"


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, ("gid", "block")):
        gid, number = run.column("gid")[0].as_py(), run.column("block")[0].as_py()
        block = Block.build(run.column("digest").to_pylist(), number == 0)
        yield pa.RecordBatch.from_pylist(
            [{"gid": gid, "block": number, "n": block.n, "levels": block.levels, "nodes": block.nodes, "root": block.root()}],
            pa.schema([("gid", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("levels", pa.int32()),
                       ("nodes", pa.binary()), ("root", pa.binary())]))


def grow(leaves: DataFrame, folder: str, name: str) -> list[DataFrame]:
    """Stored blocks of all trees, round by round, from (gid, at, digest). In the last round each tree has one block."""
    rounds = []
    while True:
        rows = leaves.select("gid", F.floor(F.col("at") / SPAN).alias("block"), "at", "digest")
        blocks = (rows.repartition("gid", "block").sortWithinPartitions("gid", "block", "at")
                  .select("gid", "block", "digest").mapInArrow(tidy(_built), BLOCKS))
        rounds.append(stored(blocks, folder, f"{name}-{len(rounds)}"))
        if rounds[-1].where("block > 0").isEmpty():
            return rounds
        leaves = rounds[-1].select("gid", F.col("block").alias("at"), F.col("root").alias("digest"))


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path above each leaf of a block, for the block or tree that this leaf is the root of."""
    for batch in batches:
        for low in range(len(batch)):
            (row,) = batch.slice(low, 1).to_pylist()
            block = Block(row["nodes"], row["n"], row["levels"])
            for start in range(0, row["n"], 256):
                some = range(start, min(start + 256, row["n"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["gid"]] * len(some), pa.int64()), pa.array([row["block"] * SPAN + i for i in some], pa.int64()),
                     pa.array([block.path(i) + row["above"] for i in some], pa.binary()),
                     pa.array([row["top"]] * len(some), pa.binary())], ["gid", "at", "above", "top"])


def _below(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(gid, at, above, top) of the leaves of blocks, given (gid, block, above, top) of the blocks."""
    joined = blocks.select("gid", "block", "n", "levels", "nodes").join(above, ["gid", "block"])
    return joined.mapInArrow(tidy(_handed_down), "gid bigint, at bigint, above binary, top binary")


def _as_blocks(paths: DataFrame) -> DataFrame:
    return paths.withColumnRenamed("at", "block")


class Manifest:
    """Stored trees of a table: `rows` (key, group, at, gid, leaf, tampered), blocks of the groups, blocks of the upper tree.

    Rows are ordered by group, key and leaf, so rows with equal keys have a defined place; null keys and null groups come
    first. Groups of one row are trees of one node; an empty table has no rows and no root.
    """

    def __init__(self, leaves: DataFrame, key: str, group: str, folder: str):
        rows = leaves.select(F.col(key).alias("key"), F.col(group).alias("group"), "leaf", "tampered")
        self.key = key
        self.rows = numbered(rows, "group", ["key", "leaf"], folder, "rows")
        self.rounds = grow(self.rows.select("gid", "at", F.col("leaf").alias("digest")), folder, "groups")
        subroots = self.rounds[-1].select(F.lit(0).cast("bigint").alias("gid"), F.col("gid").alias("at"), F.col("root").alias("digest"))
        self.upper = grow(subroots, folder, "upper")

    def paths(self) -> tuple[DataFrame, DataFrame]:
        """(gid, block, above, subroot, root) of the lowest blocks: the paths from their roots to the root."""
        above = self.upper[-1].select("gid", "block", F.lit(b"").alias("above"), F.col("root").alias("top"))
        for blocks in reversed(self.upper):
            above = _as_blocks(_below(blocks, above))
        # The leaves of the upper tree are the groups' roots, each with one block in the last round.
        above = above.select(F.col("block").alias("gid"), F.lit(0).cast("bigint").alias("block"), "above", "top")
        subroots = self.rounds[-1].select("gid", F.col("root").alias("subroot"))
        for blocks in reversed(self.rounds[1:]):
            above = _as_blocks(_below(blocks, above))
        return above, subroots

    def proofs(self) -> DataFrame:
        """A row per row of the table: leaf, subroot, root, proof and folded root as binaries, and whether it verifies."""
        above, subroots = self.paths()
        kind = self.rows.schema["key"].dataType
        blocks = (self.rounds[0].select("gid", "block", "n", "levels", "nodes").join(above, ["gid", "block"])
                  .join(subroots, "gid").withColumn("in_block", F.lit(-1)))
        rows = self.rows.select("gid", F.floor(F.col("at") / SPAN).alias("block"), "key", "tampered",
                                F.pmod("at", F.lit(SPAN)).cast("int").alias("in_block"))
        both = rows.unionByName(blocks, allowMissingColumns=True)
        both = both.repartition("gid", "block").sortWithinPartitions("gid", "block", "in_block")
        names = ("leaf", "subroot", "root", "proof", "folded_root")
        schema = f"`{self.key}` {kind.simpleString()}, " + ", ".join(f"{c} binary" for c in names) + ", verified boolean"
        arrow_kind, key = to_arrow_type(kind), self.key

        def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, head = None, None
            for batch in batches:
                for low in range(0, len(batch), 1024):
                    part = batch.slice(low, 1024)
                    at, out = [], []
                    for i, row in enumerate(part.drop_columns(["key"]).to_pylist()):
                        if row["in_block"] < 0:
                            block, head = Block(row["nodes"], row["n"], row["levels"]), row
                            continue
                        path = block.path(row["in_block"]) + head["above"]
                        top = folded(row["tampered"], path)
                        at.append(i)
                        out.append((block.node(0, row["in_block"]), head["subroot"], head["top"], proof_digest(path), top,
                                    top == head["top"]))
                    if at:
                        yield pa.RecordBatch.from_arrays(
                            [part.column("key").take(pa.array(at)).cast(arrow_kind), *(pa.array(c, pa.binary()) for c in list(zip(*out))[:5]),
                             pa.array([r[5] for r in out])], [key, *names, "verified"])

        return both.select("in_block", "key", "tampered", "n", "levels", "nodes", "above", "top", "subroot").mapInArrow(tidy(proved), schema)


def tampered_text(key: Column, text: Column) -> Column:
    """What the check of the manifest finds in place of a text: rows with an even checksum of their key lose line ends."""
    even = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(even, F.translate(text, "\n", "")).otherwise(text)


def manifest_report(docs: DataFrame) -> DataFrame:
    """A row per document, repeated rows included; a null doc_id is never tampered with. Further columns are not read."""
    fields = {c: F.col(c) for c in FIELDS}
    leaf = leaf_digest(fields)
    other = F.contains(F.col("text"), F.lit("\n")) & (tampered_text(F.col("doc_id"), F.col("text")) != F.col("text"))
    changed = leaf_digest(fields | {"text": tampered_text(F.col("doc_id"), F.col("text"))})
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(other, changed).alias("changed"))
    leaves = leaves.select("doc_id", "source", "leaf", F.coalesce("changed", "leaf").alias("tampered"))
    folder = shared_folder(docs.sparkSession)
    # Stored, so that cutting the ranges and sorting read digests, and each text is read and hashed once.
    out = Manifest(stored(leaves, folder, "leaves"), "doc_id", "source", folder).proofs()
    hexed = [F.lower(F.hex(c)).alias(n) for c, n in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"),
                                                      ("proof", "proof_sha256"), ("folded_root", "folded_root"))]
    return out.select("doc_id", *hexed, "verified")
