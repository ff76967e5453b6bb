"""Benchmark decontamination by template canonicalisation.

Words lose punctuation at both ends and become lower case. Numbers, names (a capital followed by a small letter, not at
the start of a sentence) and units after a number become typed placeholders; what stood there is the slot's value.
Every window of WINDOW tokens is hashed, and the hashes of documents and benchmark items are joined. A question with
other numbers or names in it still has the same windows; whether it is the same question is told by its slots: where
the item has one value twice, the document must have one value twice as well.

Windows come in two forms, which are joined and judged apart: as said above, and with a capitalised word at the start
of a sentence taken for a name too, and neighbouring names, with no mark between, for one.

A document is contaminated by an item if one occurrence in it holds MIN_SHARE of the item's windows, and that
occurrence's slots are consistent. Occurrences are the windows of one distance between document and item, the windows
of distances that lie within half an item (an edited copy has several), and all windows together (scattered parts).
Items with fewer tokens than WINDOW are one window of their own length, with fewer than SHORTEST in the third form alone.
Windows with fewer than MIN_LITERAL ordinary words count on neither side. An item without any other windows has a third
form, of the words and values themselves; a document holds it only if it has all of its windows in the item's order. So
each item with a word can be found, and the shortest ones only word for word.
Each character of a script written without spaces is a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import pieces, text_bytes, text_hash, tidy
from tidelog.llm.words import BASE, LOWER, hashes, mix, powers, runs, spans

WINDOW = 8
SHORTEST = 5
MIN_LITERAL = 4
MIN_SHARE = 0.3
CONSISTENT = 0.8
FILTER_BITS = 1 << 22  # the prefilter has this size whatever the benchmark's is

UNITS = ("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons ml l liter "
         "liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months "
         "year years dollar dollars euro euros cent cents usd eur percent % degrees c f k mph kmh").split()
NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
           "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
           "million").split()

_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?()[]{}\"'*#&$%<>")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
PLAIN, WIDE, VERBATIM = 0, 1, 2  # forms of windows
_NUMBER, _NAME, _UNIT = mix(np.arange(1, 4, dtype=np.uint64))


# Scripts without spaces: kana and ideographs of three and four bytes; Thai and Lao, Burmese, Khmer. By the first two bytes.
_UNSPACED = np.zeros((256, 256), bool)
_UNSPACED[0xE3:0xEA, 0x80:0xC0] = True
_UNSPACED[0xE0, 0xB8:0xBC] = True
_UNSPACED[0xE1, 0x80:0x83] = True
_UNSPACED[0xE1, 0x9E:0xA0] = True
_UNSPACED[0xEF, 0xA4:0xAC] = True
_UNSPACED[0xF0, 0xA0:0xB4] = True


def _cut_unspaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans cut before and after each character of a script without spaces."""
    lead = np.flatnonzero(data[:-1] >= 0xE0)
    lead = lead[_UNSPACED[data[lead], data[lead + 1]]]
    if not len(lead):
        return starts, ends
    cuts = np.unique(np.concatenate([lead, lead + np.where(data[lead] >= 0xF0, 4, 3)]))
    word = np.searchsorted(starts, cuts, side="right") - 1
    cuts = cuts[(word >= 0) & (cuts > starts[word]) & (cuts < ends[word])]
    return np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))


def _listed(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(hashes(data, np.concatenate([[0], ends[:-1]]), ends))


_UNIT_WORDS, _NUMBER_WORDS = _listed(UNITS), _listed(NUMBERS)


def _in(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    return words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h


class Templates:
    """Template tokens of the texts of one array. `edges`: tokens before each text; `slot`: 1 number, 2 name, 3 unit.

    `head` and `rest`: of a name that begins with a sentence, its first word and the others; 0 if there are none."""

    form = PLAIN

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        starts, ends = _cut_unspaced(data, *spans(data, offsets))
        if not len(starts):
            self.edges, self.slot = np.zeros(len(column) + 1, np.int64), np.zeros(0, np.int8)
            self.value = self.token = self.head = self.rest = np.zeros(0, np.uint64)
            self.opener = self.joined = np.zeros(0, bool)
            return
        raw_starts, raw_ends = starts, ends
        stops = _STOP[data[ends - 1]]
        for _ in range(3):
            ends = ends - (_MARKS[data[ends - 1]] & (ends - starts > 1))
            starts = starts + (_MARKS[data[starts]] & (ends - starts > 1))
        keep = ~(_MARKS[data[starts]] & (ends - starts == 1))
        opens = np.concatenate([[True], stops[:-1]])  # the first word of a sentence
        lines = np.cumsum(data == 10)
        opens[1:] |= lines[starts[1:]] > lines[ends[:-1] - 1]
        opens[np.isin(np.arange(len(starts)), np.searchsorted(starts, offsets))] = True
        marked = np.concatenate([[True], (raw_ends != ends)[:-1]]) | (raw_starts != starts)  # a mark before this word
        marked[1:] |= ~keep[:-1]
        starts, ends, opens, marked = starts[keep], ends[keep], opens[keep], marked[keep]
        self.edges = np.searchsorted(starts, offsets)
        self.value = hashes(data, starts, ends)
        one, two = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
        three = data[np.minimum(starts + 2, len(data) - 1)]
        long = ends - starts
        digit = (one >= 48) & (one <= 57) | ((one == 45) | (one == 43)) & (long > 1) & (two >= 48) & (two <= 57)
        small = lambda c: (c >= 97) & (c <= 122) | (c >= 0xC3)
        name = (one >= 65) & (one <= 90) & (long > 1) & small(two)
        name |= (one == 0xC3) & (two >= 0x80) & (two <= 0x9E) & (long > 2) & small(three)
        number = digit | _in(self.value, _NUMBER_WORDS)
        unit = _in(self.value, _UNIT_WORDS)
        unit[:1] = False
        unit[1:] &= number[:-1]
        self.slot = np.where(number, 1, np.where(unit, 3, np.where(name & ~opens, 2, 0))).astype(np.int8)
        self.token = np.select([self.slot == 1, self.slot == 2, self.slot == 3], [_NUMBER, _NAME, _UNIT], self.value)
        self.head = self.rest = np.zeros(len(self.value), np.uint64)
        self.opener = name & opens & (self.slot == 0)
        named = self.opener | (self.slot == 2)
        self.joined = np.zeros(len(self.value), bool)  # one name with the word before
        self.joined[1:] = named[1:] & named[:-1] & ~(opens | marked)[1:]
        self.joined[self.edges[:-1][self.edges[:-1] < len(self.value)]] = False

    def wide(self) -> Templates:
        """The same texts, with names at the start of sentences, and names of several words as one token."""
        out = Templates.__new__(Templates)
        out.form, first = WIDE, np.flatnonzero(~self.joined)
        sizes = np.diff(np.append(first, len(self.value)))
        nth = np.arange(len(self.value)) - np.repeat(first, sizes)
        factors = powers(BASE, int(sizes.max(initial=0)) + 1)
        several = np.flatnonzero(sizes > 1)

        def value_of(skip: int) -> np.ndarray:
            sums = np.zeros(len(self.value) + 1, np.uint64)
            np.cumsum(np.where(nth >= skip, self.value * factors[np.maximum(nth - skip, 0)], np.uint64(0)), out=sums[1:])
            at, left = first[several], sizes[several] - skip
            total = mix(sums[at + sizes[several]] - sums[at] + left.astype(np.uint64))
            return np.where(left == 1, self.value[np.minimum(at + skip, len(self.value) - 1)], total)

        out.edges = np.searchsorted(first, self.edges)
        out.value, opener = self.value[first], self.opener[first]
        out.head, out.rest = np.where(opener, out.value, np.uint64(0)), np.zeros(len(first), np.uint64)
        out.slot = np.where(opener, 2, self.slot[first]).astype(np.int8)
        out.token = np.where(out.slot == 2, _NAME, self.token[first])
        if len(several):
            out.rest[several] = np.where(opener[several], value_of(1), np.uint64(0))
            out.value = out.value.copy()
            out.value[several] = value_of(0)
        return out

    def verbatim(self) -> Templates:
        """The same texts, with each word and value standing for itself."""
        out = Templates.__new__(Templates)
        out.form, out.edges, out.value, out.token = VERBATIM, self.edges, self.value, self.value
        out.slot = np.zeros(len(self.value), np.int8)
        out.head = out.rest = np.zeros(len(self.value), np.uint64)
        return out

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of every window of a length that lies in one text and has enough literal words."""
        n = len(self.token) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        text = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        literal = np.concatenate([[0], np.cumsum(self.slot == 0)])
        at = np.flatnonzero((text[:n] == text[length - 1:]) & (literal[length:] - literal[:n] >= min(MIN_LITERAL, length)))
        return at, runs(self.token, length)[at] ^ np.uint64(length | self.form << 8)

    def slots(self, at: np.ndarray, length: int) -> pa.ListArray:
        every = at[:, None] + np.arange(length)
        held = self.slot[every] > 0 if len(at) else np.zeros((0, length), bool)
        flat = every[held]
        ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
        parts = [pa.array(part[flat].view(np.int64)) for part in (self.value, self.head, self.rest)]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["value", "head", "rest"]))


COLUMNS = "h bigint, at int, slots array<struct<value:bigint,head:bigint,rest:bigint>>"


def _rows(t: Templates, at: np.ndarray, h: np.ndarray, length: int, batch: pa.RecordBatch, keys: list[str]) -> pa.RecordBatch:
    text = np.searchsorted(t.edges, at, side="right") - 1
    return pa.RecordBatch.from_arrays(
        [*(batch.column(k).take(pa.array(text)) for k in keys), pa.array(h.view(np.int64)),
         pa.array((at - t.edges[text]).astype(np.int32)), t.slots(at, length)],
        [*keys, "h", "at", "slots"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, form, length, size, h, at, slots) of every item; size is its tokens, length is WINDOW, or size if that is less."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            plain = Templates(batch.column("text"))
            bare = np.ones(len(batch), bool)  # no window yet
            for t in (plain, plain.wide(), plain.verbatim()):
                sizes, held = np.diff(t.edges), np.zeros(len(batch), bool)
                for length in range(1 if t.form == VERBATIM else SHORTEST, WINDOW + 1):
                    at, h = t.windows(length)
                    of = np.searchsorted(t.edges, at, side="right") - 1
                    right = sizes[of] >= WINDOW if length == WINDOW else sizes[of] == length
                    if t.form == VERBATIM:
                        right &= bare[of]
                    held[of[right]] = True
                    out = _rows(t, at[right], h[right], length, batch, ["item_id"])
                    yield pa.RecordBatch.from_arrays(
                        [out.column("item_id"), pa.array([t.form] * len(out), pa.int32()), pa.array([length] * len(out), pa.int32()),
                         pa.array(sizes[of[right]].astype(np.int32)), *(out.column(c) for c in ("h", "at", "slots"))],
                        ["item_id", "form", "length", "size", "h", "at", "slots"])
                bare &= ~held

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(tidy(emit), f"item_id {kind}, form int, length int, size int, {COLUMNS}")


def _first_in_text(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), bool)
    order = np.lexsort((h, text))  # stable: of equal windows the first one leads
    text, h = text[order], h[order]
    out[order] = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[:len(h)]
    return out


def document_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, row_hash, h, at, slots) of the windows that may be an item's, by a filter of fixed size."""
    spark = docs.sparkSession
    lengths = [tuple(r) for r in items.select("form", "length").distinct().collect()]  # at most WINDOW of each form
    cell = F.pmod("h", F.lit(FILTER_BITS)).cast("int").alias("cell")
    cells = items.select(cell).distinct().toArrow().column(0)  # at most FILTER_BITS numbers
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    held = np.asarray(cells, dtype=np.int64) if len(cells) else np.zeros(0, np.int64)
    np.bitwise_or.at(bits, held >> 3, (1 << (held & 7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast(bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            plain = Templates(batch.column("text"))
            forms = {PLAIN: plain, WIDE: plain.wide(), VERBATIM: plain.verbatim()}
            for form, length in lengths:
                t = forms[form]
                at, h = t.windows(length)
                cells = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                maybe = (shared.value[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
                if length < SHORTEST:  # the item's only window: one place in a text is enough
                    maybe &= _first_in_text(np.searchsorted(t.edges, at, side="right"), h)
                if maybe.any():
                    yield _rows(t, at[maybe], h[maybe], length, batch, ["doc_id", "row_hash"])

    rows = docs.select("doc_id", text_hash().alias("row_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(emit), f"doc_id {kind}, row_hash bigint, {COLUMNS}")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item.

    Columns: doc_id, row_hash, item_id; n_matched and n_windows (of the item); n_slots and n_consistent (distinct slot
    values of the item, and those with one counterpart); exact (every slot has the item's own value). The figures are
    those of one occurrence: an exact one if there is any, of several the one with most windows.

    Null texts have no windows; null ids are kept, and rows with equal doc_id are told apart by their text; equal rows
    count once. Items without a word are not looked for. Equal items are separate items. Empty tables give an empty result; other columns are not read.
    """
    items = item_windows(benchmark)
    found = document_windows(docs, items)
    sizes = items.groupBy("item_id", "form").agg(F.countDistinct("at").alias("n_windows"))
    item_side = items.select(F.col("h").alias("item_h"), "item_id", "form", "size", F.col("at").alias("item_at"),
                             F.col("slots").alias("item_slots"))
    met = found.join(item_side, F.col("h") == F.col("item_h")).where(F.size("slots") == F.size("item_slots"))
    met = met.withColumn("place", F.explode(_places(F.col("at") - F.col("item_at"), F.col("size"))))
    group = ["doc_id", "row_hash", "item_id", "form", "place"]
    matched = met.groupBy(*group).agg(F.countDistinct("item_at").alias("n_matched"))
    slots = met.select(*group, F.explode(_counterparts(F.col("item_slots"), F.col("slots"))).alias("s")).groupBy(
        *group, F.col("s.own").alias("own"), F.col("s.other").alias("other")).agg(F.min("s.word").alias("word"))
    per_value = slots.groupBy(*group, "own").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("own") != F.col("other")).alias("differs"),
                                                 F.min("word").alias("word"))
    judged = per_value.groupBy(*group).agg(F.count(F.when(~F.col("word"), 1)).alias("n_slots"),
                                           F.count(F.when(~F.col("word") & (F.col("n") == 1), 1)).alias("n_consistent"),
                                           F.max("differs").alias("differs"))
    judged = judged.select(*(F.col(c).alias(f"j_{c}") for c in group), "n_slots", "n_consistent", "differs")
    both = matched.join(judged, F.col("doc_id").eqNullSafe(F.col("j_doc_id"))
                        & (F.col("row_hash") == F.col("j_row_hash")) & (F.col("place") == F.col("j_place")) & (F.col("form") == F.col("j_form"))
                        & F.col("item_id").eqNullSafe(F.col("j_item_id")), "left").drop(*(f"j_{c}" for c in group))
    sizes = sizes.withColumnsRenamed({"item_id": "size_item", "form": "size_form"})
    both = both.join(sizes, F.col("item_id").eqNullSafe(F.col("size_item")) & (F.col("form") == F.col("size_form")))
    both = both.fillna(0, ["n_slots", "n_consistent"]).withColumn("exact", ~F.coalesce("differs", F.lit(False)))
    whole = (F.col("n_matched") == F.col("n_windows")) & (F.col("place.kind") == 1)  # all windows, at one distance
    enough = F.when(F.col("form") == VERBATIM, whole).otherwise(
        F.col("n_matched") >= F.greatest(F.lit(1), F.ceil(F.col("n_windows") * MIN_SHARE)))
    held = both.where(enough & (F.col("n_consistent") >= F.col("n_slots") * CONSISTENT))
    best = F.max(F.struct("exact", "n_matched", "n_consistent", "n_slots", "n_windows")).alias("best")
    return held.groupBy("doc_id", "row_hash", "item_id").agg(best).select(
        "doc_id", "row_hash", "item_id", *(f"best.{c}" for c in ("n_matched", "n_windows", "n_slots", "n_consistent", "exact")))


def _counterparts(item: Column, document: Column) -> Column:
    """(own, other, word) of the slots of two equal windows. The same word at the start of both sentences may be no name:
    it is a `word`, and what follows it in the names is compared by itself. Words don't count as consistent slots."""
    def pairs(a: Column, b: Column) -> Column:
        pair = lambda own, other, word: F.struct(own.alias("own"), other.alias("other"), F.lit(word).alias("word"))
        opener, after = pair(a["head"], b["head"], True), pair(a["rest"], b["rest"], False)
        same = (a["head"] != 0) & (a["head"] == b["head"]) & ((a["rest"] == 0) == (b["rest"] == 0))
        return F.when(same & (a["rest"] == 0), F.array(opener)).when(same, F.array(opener, after)).otherwise(
            F.array(pair(a["value"], b["value"], False)))

    return F.flatten(F.zip_with(item, document, pairs))


def _places(shift: Column, size: Column) -> Column:
    """The occurrences a matched window may belong to, by its distance from the place it has in the item: that distance
    alone, two runs of distances half an item wide that overlap by half, and the whole document."""
    width = F.greatest(F.lit(2), F.floor(size / 2))
    places = [(0, F.lit(0)), (1, shift), (2, F.floor(shift / width)), (3, F.floor((shift + F.floor(width / 2)) / width))]
    return F.array(*(F.struct(F.lit(kind).alias("kind"), at.cast("bigint").alias("at")) for kind, at in places))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the contaminated documents; all columns are kept."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("tidelog__leak_id"), F.col("row_hash").alias("tidelog__leak_row")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("tidelog__leak_id")) & (text_hash() == F.col("tidelog__leak_row")), "left_anti")


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark).drop("row_hash")
