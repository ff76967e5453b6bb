"""Language identification by unigrams over pieces, summed over all segmentations.

The pieces are the tokens of a fixed public vocabulary, up to MAX_PIECE bytes each; all single bytes are among them.
For each language a unigram model gives every piece a probability. A word's probability is the sum over all ways to
cut it into pieces, which a forward pass computes; a text's is the product over its words. The language with the
largest posterior wins, and the posterior is the score.

Piece probabilities come from expectation maximisation over the words of a bounded sample of labelled documents, one
language to a task: a forward and a backward pass give each piece's expected count.

Words are runs of bytes without ASCII white space, A-Z in lower case, with the space before them; longer words are cut
every UNIT bytes. Scoring looks at every word of every text; a word that comes again is scored once per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.bpe import read_ranks
from tidelog.llm.common import pieces, text_bytes, tidy
from tidelog.llm.words import BASE, BYTE, INVERSE, LOWER, hashes, mix, powers, spans

MAX_PIECE = 8
UNIT = 24
SAMPLE_DOCS = 1_500  # labelled documents to learn from, per language, about
SAMPLE_CHARS = 20_000  # of longer documents the sample holds the start
SAMPLE_WORDS = 60_000  # distinct words to learn from, per language, the most frequent
ROUNDS = 4
SMOOTH = 0.01
MEMO = 1 << 18
SCORED_BYTES = 2 << 20  # texts scored at once
UNKNOWN = "und"

_up, _down = powers(BASE, UNIT), powers(INVERSE, UNIT + 1)


class Vocabulary:
    """The pieces, found by hash."""

    def __init__(self, tokens: list[bytes]):
        tokens = sorted({bytes([b]) for b in range(256)} | {t for t in tokens if 0 < len(t) <= MAX_PIECE})
        data = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum([len(t) for t in tokens])
        found = hashes(data, np.concatenate([[0], ends[:-1]]), ends, lower=False)
        self.order = np.argsort(found)
        self.hashes = found[self.order]
        self.size = len(tokens)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers; `size` where there is no such piece."""
        at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
        return np.where(self.hashes[at] == h, self.order[at], self.size)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word with the space before it, cut every UNIT bytes; and the units before each text."""
    starts, ends = spans(data, offsets)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    if len(starts):
        spaced = (starts > 0) & (data[starts - 1] == 0x20) & ~first[starts]
        starts = starts - spaced
    parts = -(-(ends - starts) // UNIT)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = np.repeat(starts, parts) + nth * UNIT
    stop = np.minimum(cut + UNIT, np.repeat(ends, parts))
    return cut, stop, np.searchsorted(cut, offsets)


def pieces_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """ids[u, s, l - 1]: the piece of l bytes at byte s of unit u. `size` where there is none or the unit is over."""
    lengths = ends - starts
    width = int(lengths.max())
    at = starts[:, None] + np.arange(width)
    inside = np.arange(width) < lengths[:, None]
    values = np.where(inside, BYTE[data[np.minimum(at, len(data) - 1)]], 0).astype(np.uint64) * _up[:width]
    sums = np.zeros((len(starts), width + 1), np.uint64)
    np.cumsum(values, axis=1, out=sums[:, 1:])
    ids = np.full((len(starts), width, MAX_PIECE), vocabulary.size, np.int32)
    for size in range(1, min(MAX_PIECE, width) + 1):
        n = width - size + 1
        fits = (np.arange(n) + size) <= lengths[:, None]
        h = mix((sums[:, size:] - sums[:, :n]) * _down[:n])
        ids[:, :n, size - 1][fits] = vocabulary.find(h[fits])
    return ids


def forward(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """alpha[u, e]: probability of the first e bytes, summed over segmentations. table: [pieces + 1, languages]."""
    n, width, _ = ids.shape
    alpha = np.zeros((n, width + 1, table.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, width + 1):
        for size in range(1, min(MAX_PIECE, end) + 1):
            alpha[:, end] += alpha[:, end - size] * table[ids[:, end - size, size - 1]]
    return alpha


def scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary, table: np.ndarray) -> np.ndarray:
    """Log probability of each unit in each language."""
    out = np.empty((len(starts), table.shape[1]))
    order = np.argsort(ends - starts, kind="stable")
    for low in range(0, len(order), 4096):  # units of about one length at a time
        at = order[low:low + 4096]
        alpha = forward(pieces_of(data, starts[at], ends[at], vocabulary), table)
        out[at] = np.log(alpha[np.arange(len(at)), (ends - starts)[at]])
    return out


def fit(words: list[bytes], counts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation."""
    p = np.full(vocabulary.size, 1 / vocabulary.size)
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    order = np.argsort(lengths, kind="stable")
    for _ in range(ROUNDS):
        expected = np.full(vocabulary.size + 1, SMOOTH)
        table = np.append(p, 0)[:, None]
        for low in range(0, len(order), 4096):
            at = order[low:low + 4096]
            ids = pieces_of(data, (ends - lengths)[at], ends[at], vocabulary)
            n, width, _ = ids.shape
            alpha = forward(ids, table)[:, :, 0]
            beta = np.zeros((n, width + 1))
            beta[np.arange(n), lengths[at]] = 1
            for start in range(width - 1, -1, -1):
                for size in range(1, min(MAX_PIECE, width - start) + 1):
                    beta[:, start] += beta[:, start + size] * table[ids[:, start, size - 1], 0]
            weight = counts[at] / beta[:, 0]
            for start in range(width):
                for size in range(1, min(MAX_PIECE, width - start) + 1):
                    piece = ids[:, start, size - 1]
                    share = weight * alpha[:, start] * table[piece, 0] * beta[:, start + size]
                    expected += np.bincount(piece, share, vocabulary.size + 1)
        p = expected[:-1] / expected[:-1].sum()
    return p


class Model:
    """Languages, the logarithms of their shares, and a table of piece probabilities with a last row of zeros."""

    def __init__(self, languages: list[str], priors: np.ndarray, table: np.ndarray, vocabulary: Vocabulary):
        self.languages, self.priors, self.table, self.vocabulary = languages, priors, table, vocabulary


def bucket(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 5; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def learn(docs: DataFrame, vocabulary_path: str) -> Model:
    """A model from the labelled documents whose bucket is not 0. The sample is bounded by the constants above;
    languages and priors are those of all these documents."""
    tokens = list(read_ranks(vocabulary_path))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(tokens)  # one vocabulary: its size does not depend on the data
    usable = docs.where((bucket() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "doc_id")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row per language
    vocabulary = Vocabulary(tokens)
    if not sizes:
        return Model([], np.zeros(0), np.zeros((vocabulary.size + 1, 0)), vocabulary)
    steps = 1 << 20
    chance = F.create_map(*[F.lit(v) for lang, n in sorted(sizes.items())
                            for v in (lang, min(steps, math.ceil(steps * SAMPLE_DOCS / n)))])
    sample = usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)) < F.element_at(chance, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            data = LOWER[data]
            starts, ends, edges = units(data, offsets)
            if not len(starts):
                continue
            raw, languages = data.tobytes(), batch.column("lang").to_pylist()
            counts = pd.Series([raw[s:e] for s, e in zip(starts, ends)]).groupby(
                np.repeat(np.arange(len(languages)), np.diff(edges))).value_counts()
            of = [languages[i] for i in counts.index.get_level_values(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.string()), pa.array(list(counts.index.get_level_values(1)), pa.binary()),
                 pa.array(counts.to_numpy(), pa.int64())], ["lang", "word", "n"])

    def train(words: pd.DataFrame) -> pd.DataFrame:
        best = words.sort_values(["n", "word"], ascending=[False, True]).head(SAMPLE_WORDS)
        p = fit([bytes(w) for w in best["word"]], best["n"].to_numpy(float), Vocabulary(held.value))
        return pd.DataFrame({"lang": [words["lang"].iloc[0]], "p": [p.tobytes()]})

    counted = (sample.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).mapInArrow(tidy(count), "lang string, word binary, n bigint")
               .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    rows = sorted(counted.groupBy("lang").applyInPandas(train, "lang string, p binary").collect())  # a row per language
    table = np.zeros((vocabulary.size + 1, len(rows)))
    for i, row in enumerate(rows):
        table[:-1, i] = np.frombuffer(row["p"])
    total = sum(sizes[r["lang"]] for r in rows)
    return Model([r["lang"] for r in rows], np.log([sizes[r["lang"]] / total for r in rows]), table, vocabulary)


class Memo:
    """Scores of words seen before, found by hash; it starts anew when it holds MEMO words."""

    def __init__(self, model: Model):
        self.model = model
        self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h, first, back = np.unique(hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == h[inside]
        out = np.empty((len(h), len(self.model.languages)))
        out[known] = self.scores[at[known]]
        new = ~known
        if new.any():
            out[new] = scores(data, starts[first[new]], ends[first[new]], self.model.vocabulary, self.model.table)
            if len(self.hashes) + new.sum() > MEMO:
                self.hashes, self.scores = h[:MEMO], out[:MEMO]
            else:
                merged = np.concatenate([self.hashes, h[new]])
                order = np.argsort(merged, kind="stable")
                self.hashes, self.scores = merged[order], np.concatenate([self.scores, out[new]])[order]
        return out[back]


def posteriors(column: pa.Array, memo: Memo) -> np.ndarray:
    """Probability of each language for each text."""
    model = memo.model
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, edges = units(data, offsets)
    total = np.zeros((len(column), len(model.languages)))
    if len(starts):
        each = memo(data, starts, ends)
        full = np.flatnonzero(np.diff(edges))
        total[full] = np.add.reduceat(each, edges[:-1][full], axis=0)
    total += model.priors
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `lang_pred` and `lang_score`, from `text` alone.

    A null text, or one without a letter, is `und` with score 0; so is every text if nothing was learned. Of equally
    likely languages the first in alphabetical order wins. All columns are kept, but for old ones of the two new names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary numbers
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    letters = "lang_letters__"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(held.value)
        languages = np.array(held.value.languages, object)
        for batch in pieces(batches, "text", SCORED_BYTES):
            sure = np.asarray(batch.column(letters)).astype(bool) & bool(len(languages))
            best, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            if sure.any():
                p = posteriors(batch.column("text"), memo)
                best[sure], score[sure] = languages[p.argmax(axis=1)][sure], p.max(axis=1)[sure]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                [*names, "lang_pred", "lang_score"])

    rows = docs.select(*names, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letters))
    schema = docs.select(*names).schema.add("lang_pred", "string").add("lang_score", "double")
    return rows.mapInArrow(tidy(predict), schema)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language_report(docs: DataFrame) -> DataFrame:
    """Predicted language and score per document, and whether it was held out from learning."""
    out = identify(docs.select("doc_id", "text"), learn(docs, public_vocabulary()))
    return out.select("doc_id", F.coalesce(bucket() == 0, F.lit(False)).alias("held_out"), "lang_pred",
                      F.col("lang_score").alias("score"))
