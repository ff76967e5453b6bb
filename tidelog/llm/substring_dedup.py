"""Substring de-duplication by sliding spans of sentences.

Sentences end after `.`, `!`, `?` or an ideographic full stop, and at line ends. Those of more than LONGEST words are cut
before each word whose hash is the least of the NEAR words on either side of it, so cuts depend on what is near and not
on where the sentence began, and every LONGEST words where there is no such word. From each sentence a span runs over
the next ones, until it has RUN sentences and MIN_WORDS words, and to each line's last sentence one runs from as late as
that allows. Spans
are hashed (words by ASCII white space, A-Z in lower case) and joined over the whole corpus. A sentence covered by any
span that is not the first of its kind, in order of doc_id and position, is removed.

A repeated passage of over 50 words has at least five sentences so cut, so spans within it reach all of them. Where it
begins or ends within a sentence, cuts agree from its first stop or its first least word on; the few words before that,
and after its last such place, stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import partitions, pieces, shared_folder, stored, text_bytes, tidy
from tidelog.llm.words import BASE, INVERSE, hashes, mix, powers, spans

RUN = 3
MIN_WORDS = 20
LONGEST = 12
NEAR = 3
LAST = (1 << 63) - 1

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


class Sentences:
    """Sentences and spans of the texts of one array, as flat arrays."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        starts, ends = spans(self.data, self.offsets)
        words = hashes(self.data, starts, ends)
        n = len(words)
        edges = np.searchsorted(starts, self.offsets)  # words before each text
        over = np.zeros(n + 1, bool)  # a sentence starts with this word
        if n:
            lines = np.cumsum(self.data == 10)
            last = self.data[ends - 1]
            over[1:] = _STOP[last]
            wide = np.flatnonzero((last == 0x82) & (ends - starts >= 3))
            over[wide + 1] |= (self.data[ends[wide] - 3] == 0xE3) & (self.data[ends[wide] - 2] == 0x80)
            over[1:-1] |= lines[starts[1:]] > lines[ends[:-1] - 1]
        over[edges] = True
        first = np.flatnonzero(over[:n])
        sizes = np.diff(np.append(first, n))
        if n:
            first = np.flatnonzero(over[:n] | _least(mix(words), first, sizes))
            sizes = np.diff(np.append(first, n))
        parts = -(-sizes // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = np.repeat(first, parts) + nth * LONGEST  # first word of each sentence
        self.edges = np.searchsorted(self.first, edges)  # sentences before each text
        self.text = np.repeat(np.arange(len(column)), np.diff(self.edges))
        self.begin = starts[self.first]  # first byte
        stop = self.edges[1:][self.text]  # sentences up to the end of the text
        to = np.append(self.first, n)  # words up to the start of each sentence
        every = np.arange(len(self.first))
        forward = np.maximum(every + RUN, np.searchsorted(to, self.first + MIN_WORDS))
        good = forward <= stop
        start, end = every[good], forward[good]
        # The last sentences of a line may be too few for a span of their own: one more span ends with them.
        closes = np.ones(len(self.first), bool)
        if n:
            closes[:-1] = (lines[self.begin[1:]] > lines[ends[self.first[1:] - 1] - 1]) | (self.text[1:] != self.text[:-1])
        last = np.flatnonzero(closes) + 1
        back = np.minimum(last - RUN, np.searchsorted(to, to[last] - MIN_WORDS, side="right") - 1)
        good = back >= self.edges[:-1][self.text[last - 1]]
        back, last = back[good], last[good]
        new = forward[back] != last
        self.start, self.end = np.concatenate([start, back[new]]), np.concatenate([end, last[new]])
        order = np.lexsort((self.end, self.start))
        self.start, self.end = self.start[order], self.end[order]
        low, high = to[self.start], to[self.end]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(BASE, n), out=sums[1:])
        self.hash = mix((sums[high] - sums[low]) * powers(INVERSE, n + 1)[low] + (high - low).astype(np.uint64))

    def nth(self) -> np.ndarray:
        """Number of the first sentence of each span within its text."""
        return self.start - self.edges[:-1][self.text[self.start]]

    def again(self) -> np.ndarray:
        """True for spans that came before in the same text."""
        out = np.ones(len(self.start), bool)
        of_text = mix(self.hash + self.text[self.start].astype(np.uint64) * np.uint64(BASE))
        out[np.unique(of_text, return_index=True)[1]] = False
        return out


def _least(h: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words of long sentences, not too near to their start, that are less than the NEAR words before them and no more
    than those after them."""
    n = len(h)
    nth = np.arange(n) - np.repeat(first, sizes)
    size = np.repeat(sizes, sizes)
    out = (size > LONGEST) & (nth >= NEAR)
    for d in range(1, NEAR + 1):
        out[d:] &= h[d:] < h[:-d]  # both are of one sentence, since nth >= NEAR
        out[:-d] &= (h[:-d] <= h[d:]) | (nth[:-d] + d >= size[:-d])
    return out


def _spans(docs: DataFrame, again: bool) -> DataFrame:
    """(h, id, nth): spans that are the first of their kind in their text, or those that are not."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            s = Sentences(batch.column("t"))
            chosen = s.again() == again
            at = s.start[chosen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.hash[chosen].view(np.int64)), batch.column("id").take(pa.array(s.text[at])),
                 pa.array(s.nth()[chosen].astype(np.int32))], ["h", "id", "nth"])

    return docs.select("id", "t").mapInArrow(tidy(emit), "h bigint, id bigint, nth int")


def _hot(common: DataFrame) -> DataFrame:
    """(hot, parts) of the spans in so many documents that a task of a join would have more than its share, as a local table.

    A share is a quarter of a partition's rows of ``common``, so there are at most four such spans per partition.
    """
    spark = common.sparkSession
    rows = common.agg(F.sum("n")).first()[0] or 0
    share = max(1, rows // (4 * partitions(spark)))
    found = common.where(F.col("n") > share).select(F.col("k").alias("hot"), F.ceil(F.col("n") / share).cast("int").alias("parts"))
    return spark.createDataFrame(found.toArrow(), "hot bigint, parts int")


def _salted(common: DataFrame, hot: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """How to deal rows of spans by document over the parts of hot spans, and the common spans, a row for each part."""
    few = F.broadcast(hot)  # at most four rows per partition
    one = F.coalesce("parts", F.lit(1))

    def shares(spans: DataFrame) -> DataFrame:
        dealt = spans.join(few, F.col("h") == F.col("hot"), "left")
        return dealt.select("h", "id", "nth", F.pmod(F.xxhash64("id"), one).cast("int").alias("salt"))

    parts = common.join(few, F.col("k") == F.col("hot"), "left")
    return shares, parts.select("k", "first", F.explode(F.sequence(F.lit(0), one - 1)).alias("of"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document that loses sentences, the others stay as they are.

    Columns: doc_id; first_docs (the documents that hold the first copies); n_sentences, n_removed; removed (start and
    end of the removed stretches, in code points); text (what is left).

    Null texts have no sentences. Null doc_ids come last in the order, as one document. Rows with equal doc_id are
    the same document: they don't repeat each other, only themselves. An empty table gives an empty result; other
    columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("text").alias("t"))
    once = _spans(rows, again=False)
    counted = once.groupBy(F.col("h").alias("k")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    spark = docs.sparkSession
    common = stored(counted.where("first < last").select("k", "first", "n"), shared_folder(spark), "common")
    hot = _hot(common)
    shares, salted = _salted(common, hot)
    later = shares(once).join(salted, (F.col("h") == F.col("k")) & (F.col("salt") == F.col("of"))).where("id > first").select(
        "id", "h", "nth", "first")
    own = shares(_spans(rows, again=True)).join(salted, (F.col("h") == F.col("k")) & (F.col("salt") == F.col("of")), "left").select(
        "id", "h", "nth", F.coalesce("first", "id").alias("first"))
    drops = later.unionAll(own).groupBy(F.col("id").alias("drop_id")).agg(
        F.collect_list(F.struct("nth", "h", "first")).alias("drops"))  # at most two per sentence of a document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            s = Sentences(batch.column("t"))
            found = {(t, n, h): e for t, n, h, e in zip(s.text[s.start].tolist(), s.nth().tolist(),
                                                        s.hash.view(np.int64).tolist(), s.end.tolist())}
            raw, out = s.data.tobytes(), []
            for i, drops in enumerate(batch.column("drops").to_pylist()):
                low, high = s.edges[i], s.edges[i + 1]
                gone = np.zeros(high - low, bool)
                firsts = set()
                for d in drops:
                    end = found.get((i, d["nth"], d["h"]))
                    if end is not None:  # else it is of another row with this doc_id
                        gone[d["nth"]:end - low] = True
                        firsts.add(d["first"])
                if gone.any():
                    out.append((i, sorted(firsts), *_without(raw[s.offsets[i]:s.offsets[i + 1]],
                                                             s.begin[low:high] - s.offsets[i], gone)))
            at = [o[0] for o in out]
            spans_of = [[{"start": a, "end": b} for a, b in o[4]] for o in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([o[1] for o in out], pa.list_(pa.int64())),
                 pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.int64()),
                 pa.array(spans_of, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([o[5] for o in out], pa.string())],
                ["doc_id", "first_docs", "n_sentences", "n_removed", "removed", "text"])

    joined = rows.join(drops, F.col("id") == F.col("drop_id")).select("doc_id", "t", "drops")
    return joined.mapInArrow(tidy(cut), "doc_id bigint, first_docs array<bigint>, n_sentences bigint, n_removed bigint, "
                                  "removed array<struct<start:bigint,end:bigint>>, text string")


def _without(raw: bytes, begins: np.ndarray, gone: np.ndarray) -> tuple[int, int, list[tuple[int, int]], str]:
    """Numbers of sentences and of removed ones, the removed stretches in code points, and the rest of a text.

    A sentence reaches to the start of the next one; what stands before the first belongs to it.
    """
    edges = np.append(begins, len(raw))
    edges[0] = 0
    kept = b"".join(raw[a:b] for a, b, g in zip(edges[:-1], edges[1:], gone) if not g)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=points[1:])
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
    stretches = [(int(points[edges[a]]), int(points[edges[b]])) for a, b in zip(turns[::2], turns[1::2])]
    return len(gone), int(gone.sum()), stretches, kept.decode()


def repeat_report(docs: DataFrame) -> DataFrame:
    """The changed documents, with removed stretches as start:end, joined by commas."""
    removed = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return remove_repeats(docs).withColumn("removed", F.array_join(removed, ","))
