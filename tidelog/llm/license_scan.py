"""License scans by template markup.

A template is a license's wording in which some regions are marked:

    [[ ... ]]           optional: these words may be missing; regions may be nested
    <<name:1-8>>        replaceable by any words, so many of them
    <<name:a b|c>>      replaceable by one of these wordings

All else is mandatory and has to stand as it is; case, punctuation and white space don't count. Templates are compiled
into one automaton over words: optional regions become empty moves, replaceable ones chains of moves on any word. Its
subset construction is made as texts need it and kept by the worker. A text is cut into words with numpy and each word
is looked up among the templates' words; the automaton starts only where two words in a row can begin a template, and a
template accepts the longest stretch that contains its mandatory wording. A run of the automaton is no longer than its
longest template, so the time is linear in the text, and a row needs nothing but its own text: there is no shuffle.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm.common import pieces, text_bytes, tidy
from tidelog.llm.words import hashes

# Phrases whose places are counted, and the label of each.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Public wordings of licenses and of the notices that refer to them, with regions marked.
TEMPLATES = (
    ("mit", "[[<<grant:released|licensed|distributed|available>> under]] the [[terms of the]] MIT license"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of
        the Software. [[THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<holder:1-8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.]]"""),
    ("isc", """Permission to use, copy, modify, <<and:and|and/or>> distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<holder:1-10>> AS IS"""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. [[3.]] Neither the name of <<holder:1-10>> nor the names of its contributors may be used
        to endorse or promote products derived from this software without specific prior written permission.
        [[THIS SOFTWARE IS PROVIDED BY <<holder:1-10>> AS IS]]"""),
    ("apache-2.0", """[[Licensed under]] the Apache License, Version 2.0 [[(the "License")]] [[; you may not use this file except
        in compliance with the License. You may obtain a copy of the License at <<place:1-8>> Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
        OR CONDITIONS OF ANY KIND, either express or implied. [[See the License for the specific language governing permissions
        and limitations under the License.]]]]"""),
    ("apache-2.0", "<<tag:Apache-2.0|Apache License 2.0>> [[license]]"),
    ("gpl-2.0", "GNU General Public License [[as published by the Free Software Foundation]] [[either]] <<word:version|v>> 2"),
    ("gpl-2.0-or-later", """GNU General Public License as published by the Free Software Foundation [[either]] version 2 of the
        License, or (at your option) any later version"""),
    ("gpl-3.0", "GNU General Public License [[as published by the Free Software Foundation]] [[either]] <<word:version|v>> 3"),
    ("gpl-3.0-or-later", """GNU General Public License as published by the Free Software Foundation [[either]] version 3 of the
        License, or (at your option) any later version"""),
    ("lgpl", "GNU <<kind:Lesser|Library>> General Public License"),
    ("agpl-3.0", "GNU Affero General Public License [[as published by the Free Software Foundation]] [[either]] version 3"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at"""),
    ("mpl-2.0", "Mozilla Public License <<word:version|v|>> 2.0"),
    ("epl-2.0", "Eclipse Public License [[<<word:version|v>>]] 2.0"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software"""),
    ("cc0-1.0", "CC0 1.0 [[Universal]]"),
    ("cc-by-1.0", "CC BY 1.0"), ("cc-by-2.0", "CC BY 2.0"), ("cc-by-3.0", "CC BY 3.0"),
    ("cc-by-4.0", "CC BY 4.0 [[International]]"),
    ("cc-by-sa-3.0", "CC BY-SA 3.0"), ("cc-by-sa-4.0", "CC BY-SA 4.0 [[International]]"),
    ("cc-by-nd-4.0", "CC BY-ND 4.0 [[International]]"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0 [[International]]"),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0 [[International]]"),
    ("cc-by-nc-nd-4.0", "CC BY-NC-ND 4.0 [[International]]"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 [[International]] [[Public]] License"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 [[International]] [[Public]] License"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 [[International]] [[Public]] License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0"),
)

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORDS = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_MARKS = re.compile(r"(\[\[|\]\]|<<[^:<>]*:[^<>]*>>)")
_BOUNDS = re.compile(r"(\d+)-(\d+)")
OTHER, STOP = 0, -1  # a word that no template has; the edge of a text
DEAD = -1


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.translate(_UPPER))


class Automaton:
    """All templates as one automaton over words. States of its subset construction are made when first needed."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]] = ()):
        self.vocabulary: dict[str, int] = {}
        self.moves: list[dict[int, set[int]]] = []
        self.any: list[set[int]] = []
        self.empty: list[set[int]] = []
        self.label: dict[int, str] = {}
        self.longest = max((len(words_of(t)) + sum(int(high) for _, high in _BOUNDS.findall(t)) for _, t in templates), default=0)
        starts = set()
        for label, markup in templates:
            start, end = self._template(markup)
            if end in self._closed({start}):
                raise ValueError(f"the template {markup!r} has no mandatory words")
            self.label[end] = label
            starts.add(start)
        self.phrases = [(label, [self._id(w) for w in words_of(phrase)]) for label, phrase in phrases]
        self.names = [""] * (len(self.vocabulary) + 1)
        for word, i in self.vocabulary.items():
            self.names[i] = word
        self.states: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.steps: list[dict[int, int]] = []
        self.accepts: list[tuple[str, ...]] = []
        self.start = self._state(self._closed(starts))
        raw = np.frombuffer("".join(self.names).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in self.names[1:]], dtype=np.int64)
        found = hashes(raw, np.append(0, ends[:-1])[:len(ends)], ends)
        order = np.argsort(found)
        self.found, self.ids = found[order], (order + 1).astype(np.int64)
        self.begins = self._pairs()

    # building

    def _id(self, word: str) -> int:
        return self.vocabulary.setdefault(word, len(self.vocabulary) + 1)

    def _node(self) -> int:
        self.moves.append({})
        self.any.append(set())
        self.empty.append(set())
        return len(self.moves) - 1

    def _wording(self, at: int, text: str) -> int:
        for word in words_of(text):
            to = self._node()
            self.moves[at].setdefault(self._id(word), set()).add(to)
            at = to
        return at

    def _template(self, markup: str) -> tuple[int, int]:
        first = at = self._node()
        opened = []
        for part in _MARKS.split(markup):
            if part == "[[":
                opened.append(at)
                at = self._node()
                self.empty[opened[-1]].add(at)
            elif part == "]]":
                if not opened:
                    raise ValueError(f"no region is open: {markup!r}")
                to = self._node()
                self.empty[at].add(to)
                self.empty[opened.pop()].add(to)
                at = to
            elif part.startswith("<<"):
                at = self._replaceable(at, part[2:-2].partition(":")[2])
            else:
                at = self._wording(at, part)
        if opened:
            raise ValueError(f"a region is not closed: {markup!r}")
        end = self._node()
        self.empty[at].add(end)
        return first, end

    def _replaceable(self, at: int, rule: str) -> int:
        to = self._node()
        bounds = _BOUNDS.fullmatch(rule.strip())
        if not bounds:
            for wording in rule.split("|"):
                self.empty[self._wording(at, wording)].add(to)
            return to
        low, high = map(int, bounds.groups())
        for i in range(high):
            if i >= low:
                self.empty[at].add(to)
            following = self._node()
            self.any[at].add(following)
            at = following
        self.empty[at].add(to)
        return to

    # running

    def _closed(self, nodes: set[int]) -> frozenset[int]:
        out, rest = set(nodes), list(nodes)
        while rest:
            for node in self.empty[rest.pop()] - out:
                out.add(node)
                rest.append(node)
        return frozenset(out)

    def _state(self, nodes: frozenset[int]) -> int:
        if not nodes:
            return DEAD
        if nodes not in self.states:
            self.states[nodes] = len(self.members)
            self.members.append(nodes)
            self.steps.append({})
            self.accepts.append(tuple(sorted({self.label[n] for n in nodes if n in self.label})))
        return self.states[nodes]

    def step(self, state: int, word: int) -> int:
        if state == DEAD:
            return DEAD
        known = self.steps[state]
        if word not in known:
            to = set()
            for node in self.members[state] if word != STOP else ():
                to |= self.any[node] | self.moves[node].get(word, set())
            known[word] = self._state(self._closed(to))
        return known[word]

    def _pairs(self) -> np.ndarray:
        """Which two words in a row can begin a template; words are numbered from the edge of a text, STOP, on."""
        n = len(self.names)
        out = np.zeros((n + 1, n + 1), bool)
        for a in range(n):
            second = self.step(self.start, a)
            if second != DEAD:
                out[a + 1] = bool(self.accepts[second])
                for b in range(n):
                    out[a + 1, b + 1] |= self.step(second, b) != DEAD
        return out

    def numbers(self, found: np.ndarray) -> np.ndarray:
        """Numbers of words given by their hashes."""
        if not len(self.found):
            return np.zeros(len(found), np.int64)
        at = np.minimum(np.searchsorted(self.found, found), len(self.found) - 1)
        return np.where(self.found[at] == found, self.ids[at], OTHER)

    def accepted(self, ids: list[int], at: int) -> dict[str, int]:
        """End of the longest stretch from `at` for every label that accepts one. `ids` ends with STOP."""
        state, out = self.start, {}
        while True:
            state = self.step(state, ids[at])
            if state == DEAD:
                return out
            at += 1
            for label in self.accepts[state]:
                out[label] = at


@functools.cache
def compiled(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(templates, phrases)


class Words:
    """The words of several texts as numbers, an edge after each text."""

    def __init__(self, automaton: Automaton, column: pa.Array):
        self.data, offsets = text_bytes(column)
        self.starts, self.ends = _spans(self.data, offsets)
        edges = np.searchsorted(self.starts, offsets[1:])
        self.counts = np.diff(edges, prepend=0)
        self.ids = np.insert(automaton.numbers(hashes(self.data, self.starts, self.ends)), edges, STOP)
        self.last = edges + np.arange(len(edges))  # place of each text's edge
        self.first = self.last - self.counts

    def really(self, automaton: Automaton, low: int, high: int) -> bool:
        """Words of equal hashes are compared byte by byte."""
        text = int(np.searchsorted(self.last, low))
        return all(i == OTHER or self.data[self.starts[p]:self.ends[p]].tobytes().decode().translate(_UPPER) == automaton.names[i]
                   for p, i in zip(range(low - text, high - text), self.ids[low:high].tolist()))


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; no word reaches over the edge of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[0] = edge[-1] = True
    starts = inner & (edge[:-1] | ~np.concatenate([[False], inner[:-1]]))
    ends = inner & (edge[1:] | ~np.concatenate([inner[1:], [False]]))
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _places(automaton: Automaton, words: Words) -> Iterator[tuple[int, str, int, int]]:
    """(text, label, start, end) of every place of a phrase, in order of texts and starts."""
    out = []
    for label, phrase in automaton.phrases:
        n = len(words.ids) - len(phrase) + 1
        if n <= 0:
            continue
        here = np.ones(n, bool)
        for i, word in enumerate(phrase):
            here &= words.ids[i:i + n] == word
        out += [(int(p), label, int(p) + len(phrase)) for p in np.flatnonzero(here)]
    for low, label, high in sorted(out):
        if words.really(automaton, low, high):
            text = int(np.searchsorted(words.last, low))
            yield text, label, low - int(words.first[text]), high - int(words.first[text])


def _matches(automaton: Automaton, words: Words) -> Iterator[tuple[int, str, int, int]]:
    """(text, label, start, end) of every stretch that a template accepts; those of one label don't overlap."""
    can = automaton.begins[words.ids[:-1] + 1, words.ids[1:] + 1] if len(words.ids) > 1 else np.zeros(0, bool)
    ended: dict[tuple[int, str], int] = {}
    for at in np.flatnonzero(can).tolist():
        text = int(np.searchsorted(words.last, at))
        ids = words.ids[at:min(at + automaton.longest, int(words.last[text]))].tolist()
        for label, length in automaton.accepted([*ids, STOP], 0).items():
            if at >= ended.get((text, label), 0) and words.really(automaton, at, at + length):
                ended[text, label] = at + length
                yield text, label, at - int(words.first[text]), at + length - int(words.first[text])


SPANS = "array<struct<label: string, start: bigint, end: bigint>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
         phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """(key, n_words, places, matches) per row: places of phrases and stretches that templates accept, in words from 0.

    Null texts count as empty and have no words; keys may be null or repeated, every row is answered; whole texts are
    read, however long; further columns are not read; an empty table gives an empty result.
    """
    rules = tuple(map(tuple, templates)), tuple(map(tuple, phrases))
    kind, arrow_kind = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(*rules)
        for batch in pieces(batches, "t"):
            words = Words(automaton, batch.column("t"))
            found = [[[] for _ in range(len(batch))] for _ in range(2)]
            for kind_of, source in enumerate((_places, _matches)):
                for i, label, start, end in source(automaton, words):
                    found[kind_of][i].append({"label": label, "start": start, "end": end})
            yield pa.RecordBatch.from_arrays([batch.column("k").cast(arrow_kind), pa.array(words.counts, pa.int64()),
                                              *(pa.array(c, _SPAN) for c in found)], [key, "n_words", "places", "matches"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(
        tidy(run), f"`{key}` {kind}, n_words bigint, places {SPANS}, matches {SPANS}")


def covered(spans):
    """Number of words in at least one of the spans, which are merged in order of their starts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    none = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("reached"))
    merged = F.aggregate(ordered, none, lambda a, s: F.struct(
        (a["total"] + F.greatest(s["end"] - F.greatest(s["start"], a["reached"]), F.lit(0))).alias("total"),
        F.greatest(a["reached"], s["end"]).alias("reached")))
    return merged["total"]


def license_report(docs: DataFrame) -> DataFrame:
    """Counts and labels per document. `score` is the share of its words that belong to license wording."""
    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    both = F.concat("places", "matches")
    starts = F.transform("places", lambda s: s["start"])
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(F.col("places")).alias("base_labels"), labels(both).alias("labels"),
        F.when(F.col("n_words") > 0, covered(both) / F.col("n_words")).otherwise(0.0).alias("score"),
        F.array_join(F.transform("matches", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"))),
                     ",").alias("spans"))
