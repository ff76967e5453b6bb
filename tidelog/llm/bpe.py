"""Byte-level BPE over a corpus: each distinct pre-token is encoded once, wherever it occurs.

1. Texts are cut into pre-tokens. Tasks gather documents into blocks; a block has a dictionary of its distinct
   pre-tokens, and for each document the places of its pre-tokens in that dictionary (the exploded positions, packed).
2. The dictionaries of all blocks are shuffled by word, many words to a row. Where they meet, each distinct word is
   merged once, and its ids go back to every block that asked.
3. Each block puts the ids in their places.

Only dictionaries and packed positions move, never texts, and a common word moves once per block, not once per
occurrence. Step 1 runs twice, for the dictionaries and for the positions, so that neither has to be stored; a block's
name is a digest of its content, blocks of equal content share one dictionary, and a block without its dictionary is an
error, so an input that changes between the two passes cannot give wrong ids. Both passes must therefore see the same
rows in the same order: read `docs` from a stored table, or store a shuffled frame first.

Merging is vectorised over words: in each round the pair of least rank, of equals the leftmost, is joined in every word
that still has one. Decoding joins ids with the token-byte table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm.common import partitions, pieces, text_bytes, tidy
from tidelog.llm.pretokens import starts_of
from tidelog.llm.words import OTHER_BYTE, hashes, mix

BLOCK_BYTES = 16 << 20
CUT_BYTES = 2 << 20
SHORT = 32  # bytes of a word that is merged together with others
NO_RANK = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file with a base64 token and a rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the neighbouring parts whose joint rank is least are joined, the leftmost first.

    A heap holds the possible joins, so that a word of n bytes takes O(n log n).
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: end of the part that starts at i, 0 if none starts there
    previous = list(range(-1, n - 1))
    heap = []

    def offer(start: int) -> None:
        middle = end[start]
        if middle < n and (rank := ranks.get(word[start:end[middle]])) is not None:
            heapq.heappush(heap, (rank, start, middle, end[middle]))

    for start in range(n):
        offer(start)
    while heap:
        _, start, middle, stop = heapq.heappop(heap)
        if end[start] != middle or middle >= n or end[middle] != stop:
            continue  # one of its parts has been joined otherwise
        end[start], end[middle] = stop, 0
        if stop < n:
            previous[stop] = start
        offer(start)
        if previous[start] >= 0:
            offer(previous[start])
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at:end[at]]])
        at = end[at]
    return out


def spans_at(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The elements of some stretches of an array, one stretch after the other."""
    if not len(lengths):
        return data[:0]
    ends = np.cumsum(lengths)
    return data[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


class Merger:
    """A vocabulary prepared for merging many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)
        data = np.frombuffer(b"".join(ranks), np.uint8)
        lengths = np.array([len(t) for t in ranks], np.int64)
        ends = np.cumsum(lengths)
        found = _names(data, ends - lengths, ends)
        order = np.argsort(found)
        self.whole, self.whole_rank = found[order], np.array(list(ranks.values()), np.int32)[order]
        self.whole_other = hashes(data, ends - lengths, ends, table=OTHER_BYTE)[order]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, NO_RANK if there is none or one of them is -1."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.joined[at], NO_RANK)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray,
               others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. `names` and `others` are the words' two hashes."""
        lengths = ends - starts
        counts = np.ones(len(starts), np.int64)
        table = np.full((len(starts), SHORT), -1, np.int32)
        at = np.minimum(np.searchsorted(self.whole, names), len(self.whole) - 1)
        known = (self.whole[at] == names) & (self.whole_other[at] == others)
        table[known, 0] = self.whole_rank[at[known]]
        rest = np.flatnonzero(~known & (lengths <= SHORT))
        rest = rest[np.argsort(lengths[rest], kind="stable")]
        for low in range(0, len(rest), 8192):  # words of about one length at a time
            some = rest[low:low + 8192]
            ids = self._together(data, starts[some], lengths[some])
            table[some, :ids.shape[1]] = ids
            counts[some] = (ids >= 0).sum(axis=1)
        long = np.flatnonzero(~known & (lengths > SHORT))
        extra = {int(i): merge(data[starts[i]:ends[i]].tobytes(), self.ranks) for i in long}
        if not extra:
            return table[np.arange(SHORT) < counts[:, None]], counts
        flat, low = [], 0
        for i in long:
            flat += [table[low:i][np.arange(SHORT) < counts[low:i, None]], np.array(extra[int(i)], np.int32)]
            counts[i], low = len(extra[int(i)]), i + 1
        flat.append(table[low:][np.arange(SHORT) < counts[low:, None]])
        return np.concatenate(flat), counts

    def _together(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ids of words of a few bytes, one word to a row, filled up with -1."""
        width = int(lengths.max())
        columns = np.arange(width)
        at = np.minimum(starts[:, None] + columns, len(data) - 1)
        out = np.where(columns < lengths[:, None], self.bytes[data[at]], -1).astype(np.int32)
        alive, ids = np.arange(len(out)), out
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while width > 1:
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(ids)), best]
            more = rank < NO_RANK
            if not more.all():
                out[alive[~more], :ids.shape[1]] = ids[~more]
                out[alive[~more], ids.shape[1]:] = -1
                alive, ids, ranks, best, rank = alive[more], ids[more], ranks[more], best[more], rank[more]
            if not len(alive):
                break
            rows, width = np.arange(len(ids)), ids.shape[1]
            ids[rows, best] = rank
            shift = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
            ids = np.take_along_axis(ids, shift, axis=1)
            pairs = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, pairs + (pairs >= best[:, None]), axis=1)
            left = best > 0
            ranks[rows[left], best[left] - 1] = self._rank(ids[rows[left], best[left] - 1], ids[rows[left], best[left]])
            right = best < width - 2
            ranks[rows[right], best[right]] = self._rank(ids[rows[right], best[right]], ids[rows[right], best[right] + 1])
            if width == 2:
                out[alive, 0], out[alive, 1:] = ids[:, 0], -1
                break
        return out


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hashes(data, starts, ends, lower=False)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Name and second hash of each distinct span, its first occurrence, and the place of every span among them.

    Names are 64-bit hashes. Different spans of one name are told apart by the second hash; each has a place of its own.
    """
    names = _names(data, starts, ends)
    found, first, place = np.unique(names, return_index=True, return_inverse=True)
    other = hashes(data, starts, ends, table=OTHER_BYTE)
    if (other[first][place] != other).any():
        both = np.rec.fromarrays([names, other])
        _, first, place = np.unique(both, return_index=True, return_inverse=True)
        found = names[first]
    return found, other[first], first, place.astype(np.uint32)


class Block:
    """Documents that share a dictionary."""

    def __init__(self, batches: list[pa.RecordBatch]):
        data, self.keys, spans, edges = [], [], [], [np.zeros(1, np.int64)]
        digest, base, tokens = hashlib.blake2b(digest_size=16), 0, 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column("t"))
            starts = starts_of(raw, offsets)
            digest.update(raw.tobytes())
            digest.update(offsets.tobytes())
            digest.update(str(batch.column("k").to_pylist()).encode())
            data.append(raw)
            spans.append(starts + base)
            edges.append(np.searchsorted(starts, offsets[1:]) + tokens)
            self.keys.append(batch.column("k"))
            base, tokens = base + len(raw), tokens + len(starts)
        self.name = digest.digest()
        self.data, self.edges = np.concatenate(data), np.concatenate(edges)
        starts = np.concatenate(spans)
        ends = np.append(starts[1:], base)
        names, _, first, place = distinct(self.data, starts, ends)
        # Frequent words first, so that packed places are short.
        order = np.argsort(-np.bincount(place, minlength=len(first)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        self.places = rank[place]
        self.names, self.starts, self.ends = names[order], starts[first[order]], ends[first[order]]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held, size = [], 0
    for batch in pieces(batches, "t", CUT_BYTES):
        held.append(batch)
        size += batch.column("t").nbytes
        if size >= BLOCK_BYTES:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as variable-length bytes: seven bits each, the high bit says that more follow."""
    numbers = numbers.astype(np.uint32)
    wide = max(1, -(-int(numbers.max(initial=0)).bit_length() // 7))
    columns = numbers[:, None] >> (7 * np.arange(wide, dtype=np.uint32))
    used = columns > 0
    used[:, 0] = True
    out = (columns & 127).astype(np.uint8)
    out[:, :-1] |= used[:, 1:].astype(np.uint8) << 7
    return out[used].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint32)
    ends = np.flatnonzero(raw < 128)
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    out = (raw[starts] & 127).astype(np.uint32)
    for i in range(1, int((ends - starts).max()) + 1):
        more = np.flatnonzero(ends - starts >= i)
        out[more] |= (raw[starts[more] + i] & 127).astype(np.uint32) << np.uint32(7 * i)
    return out


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) per row of `docs`, ids as little-endian unsigned 32-bit integers in one binary.

    Null texts count as empty and have no ids; null and repeated keys are kept as they are; equal rows are encoded each,
    however they are dealt to tasks; a very long text is a block of its own; an empty table gives an empty result; further
    columns are not read. `ranks` must hold all 256 single bytes.
    """
    spark = docs.sparkSession
    merger = spark.sparkContext.broadcast(Merger(ranks))  # one vocabulary: its size does not depend on the data
    narrow = np.dtype("<u2") if max(ranks.values()) < 1 << 16 else np.dtype("<u4")
    kind, arrow_kind = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    n = partitions(spark)

    def dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            part = (mix(block.names) % np.uint64(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(n + 1))
            used = [i for i in range(n) if edges[i + 1] > edges[i]]
            out = {"places": [], "sizes": [], "words": []}
            for i in used:
                at = order[edges[i]:edges[i + 1]]
                sizes = block.ends[at] - block.starts[at]
                out["places"].append(pack(at))
                out["sizes"].append(pack(sizes))
                out["words"].append(spans_at(block.data, block.starts[at], sizes).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([block.name] * len(used), pa.binary()),
                 *(pa.array(c, pa.binary()) for c in out.values())], ["part", "block", *out])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            keys = pa.chunked_array(block.keys, arrow_kind).combine_chunks()
            for low in range(0, len(keys), 512):
                some = range(low, min(low + 512, len(keys)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.name] * len(some), pa.binary()), keys.slice(low, len(some)),
                     pa.array([pack(block.places[block.edges[i]:block.edges[i + 1]]) for i in some], pa.binary()),
                     pa.array([len(block.names)] * len(some), pa.int32())], ["block", "k", "packed", "n_words"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by part; the rows of a part hold all that is asked about its words."""
        held, part = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["part"] != part:
                    yield from _merged(held, merger.value, narrow)
                    held = []
                part = row["part"]
                held.append(row)
        if held:
            yield from _merged(held, merger.value, narrow)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by block, dictionary first; a task holds one dictionary at a time. Where several blocks have
        the same content, each part of their dictionary has come several times, and one copy is kept."""
        block, parts, table, held = None, [], None, set()
        for batch in batches:
            for low in range(0, len(batch), 256):
                some, at, out = batch.slice(low, 256), [], []
                for i, row in enumerate(some.drop_columns(["k"]).to_pylist()):
                    if row["block"] != block:
                        block, parts, table, held = row["block"], [], None, set()
                    if row["ids"] is not None:
                        if row["places"] not in held:
                            held.add(row["places"])
                            parts.append(row)
                        continue
                    if table is None:
                        table, parts = _table(parts, row["n_words"], narrow), []
                    ids, starts, counts = table
                    own = unpack(row["packed"])
                    at.append(i)
                    out.append(spans_at(ids, starts[own], counts[own]).astype("<u4").tobytes())
                if at:
                    yield pa.RecordBatch.from_arrays([some.column("k").take(pa.array(at)), pa.array(out, pa.binary())],
                                                     [key, "ids"])

    words = rows.mapInArrow(tidy(dictionaries), "part int, block binary, places binary, sizes binary, words binary")
    encoded = words.repartition(n, "part").sortWithinPartitions("part").mapInArrow(
        tidy(merged), "block binary, places binary, counts binary, ids binary")
    positions = rows.mapInArrow(tidy(places), f"block binary, k {kind}, packed binary, n_words int")
    both = encoded.unionByName(positions, allowMissingColumns=True).repartition(n, "block")
    both = both.sortWithinPartitions("block", F.col("ids").isNull())
    return both.select("block", "places", "counts", "ids", "k", "packed", "n_words").mapInArrow(
        tidy(assembled), f"`{key}` {kind}, ids binary")


def _merged(rows: list[dict], merger: Merger, narrow: np.dtype) -> Iterator[pa.RecordBatch]:
    """Merge each distinct word of some dictionaries once, and answer each dictionary."""
    data = np.frombuffer(b"".join(r["words"] for r in rows), np.uint8)
    each = [unpack(r["sizes"]).astype(np.int64) for r in rows]
    ends = np.cumsum(np.concatenate(each))
    starts = np.concatenate([[0], ends[:-1]])
    names, others, first, place = distinct(data, starts, ends)
    ids, counts = merger.encode(data, starts[first], ends[first], names, others)
    at = np.cumsum(counts) - counts
    low = 0
    for row, sizes in zip(rows, each):
        own = place[low:low + len(sizes)]
        low += len(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], pa.binary()) for v in (row["block"], row["places"], pack(counts[own]),
                                                  spans_at(ids, at[own], counts[own]).astype(narrow).tobytes())],
            ["block", "places", "counts", "ids"])


def _table(parts: list[dict], n_words: int, narrow: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a dictionary, and where and how many each place has."""
    places = np.concatenate([unpack(p["places"]) for p in parts]) if parts else np.zeros(0, np.uint32)
    if len(places) != n_words:
        raise ValueError(f"a block has {len(places)} of its {n_words} words: the input changed between two passes")
    if not n_words:
        return np.zeros(0, narrow), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.concatenate([unpack(p["counts"]) for p in parts]).astype(np.int64)
    starts, counts = np.empty(n_words, np.int64), np.empty(n_words, np.int64)
    starts[places], counts[places] = np.cumsum(found) - found, found
    return np.frombuffer(b"".join(p["ids"] for p in parts), narrow), starts, counts


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: bytes of all tokens in order of their ids; where and how many each id has."""
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    lengths = np.array([len(t) for t in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded) per row: the ids joined with the token-byte table, in order. Null ids give null bytes."""
    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks))  # one vocabulary, as above
    kind = encoded.schema[key].dataType.simpleString()

    def text_of(ids: bytes | None) -> bytes | None:
        if ids is None:
            return None
        data, starts, lengths = table.value
        tokens = np.frombuffer(ids, "<u4")
        return spans_at(data, starts[tokens], lengths[tokens]).tobytes()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1024):
                part = batch.slice(low, 1024)
                out = [text_of(ids) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("ids"), pa.array(out, pa.binary())],
                                                 [key, "ids", "decoded"])

    return encoded.select(F.col(key).alias("k"), "ids").mapInArrow(tidy(decode), f"`{key}` {kind}, ids binary, decoded binary")


def public_ranks() -> dict[bytes, int]:
    """The ranks of the public vocabulary that the queries use; starts_of cuts texts as its pattern does."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def token_report(docs: DataFrame) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, per document."""
    ranks = public_ranks()
    out = decode_documents(encode_documents(docs, ranks), ranks)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_id_arrays(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens, ids) with the ids as an array of integers."""
    key = encoded.columns[0]

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(i) for i in ids], pa.int64()),
                                              pa.array(ids, pa.list_(pa.int32()))], [key, "n_tokens", "ids"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(tidy(widen), f"`{key}` {kind}, n_tokens bigint, ids array<int>")
