"""Document fingerprints by winnowing, in DataFrame expressions only.

A text is cut into tokens: runs of at most 12 letters or digits in lower case, and single other characters that are not
white space. Rolling hashes of K tokens in a row are polynomials modulo a prime, built by doubling: the hash of 2k
tokens follows from the hashes of k tokens at i and at i + k. Of every WINDOW hashes in a row the least is chosen, of
equal ones the rightmost; hash and position lie in one long, so that one minimum decides both. Window minima come by
doubling too. Positions are kept: two texts that share K + WINDOW - 1 tokens in a row share a chosen hash, and the
positions tell where.

A text with fewer than K tokens has one hash over all of them, one without tokens has no hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import partitions, text_hash

K = 4  # tokens to a hash; a power of two
WINDOW = 16  # hashes to a window; a power of two
TOKEN = r"[\p{L}\p{N}\p{M}]{1,12}|[^\s\p{L}\p{N}\p{M}]"
PRIME = (1 << 31) - 1
BASE = 1_000_003
POSITIONS = 1 << 32
LOWEST = -(1 << 63)


def _pairs(values: Column, step: int, join) -> Column:
    """join(x[i], x[i + step]) for every i where both exist."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + step), n), join)


def _min_pair(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _rolled(step: int):
    shift = pow(BASE, step, PRIME)
    return lambda a, b: (a * F.lit(shift) + b) % F.lit(PRIME)


def _token_hash(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PRIME))


def _placed(h: Column, i: Column) -> Column:
    """Hash above, position below; later positions are smaller, so the rightmost of equal hashes wins."""
    return h * F.lit(POSITIONS) + (F.lit(POSITIONS - 1) - i)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: the chosen (hash, position) pairs as longs, in text order. A null text counts as empty.

    Each step is a projection of its own, so that no array is computed twice.
    """
    tokens, rolled = f"{name}__tokens", f"{name}__rolled"
    cut = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    df = df.withColumn(tokens, F.transform(cut, _token_hash)).withColumn(rolled, F.col(tokens))
    for i in range(K.bit_length() - 1):
        df = df.withColumn(rolled, _pairs(F.col(rolled), 1 << i, _rolled(1 << i)))
    all_of_it = F.array(_token_hash(F.array_join(tokens, " ")))
    df = df.withColumn(rolled, F.transform(
        F.when((F.size(tokens) > 0) & (F.size(tokens) < K), all_of_it).otherwise(F.col(rolled)), _placed))
    df = df.withColumn(tokens, F.when((F.size(rolled) > 0) & (F.size(rolled) < WINDOW), F.array(F.array_min(rolled))))
    for i in range(WINDOW.bit_length() - 1):
        df = df.withColumn(rolled, _pairs(F.col(rolled), 1 << i, _min_pair))
    return df.withColumn(name, F.coalesce(tokens, F.array_distinct(rolled))).drop(tokens, rolled)


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32)))


def positions(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda x: F.lit(POSITIONS - 1) - F.pmod(x, F.lit(POSITIONS)))


def listed(fingerprint: Column) -> Column:
    """hash@position, joined by commas; the hash in hexadecimal."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(
        "@", F.lower(F.hex(F.shiftright(x, 32))), F.lit(POSITIONS - 1) - F.pmod(x, F.lit(POSITIONS)))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a column `fingerprint`. Null and empty texts have an empty one; any other column may be null."""
    return with_fingerprint(docs, text, "fingerprint")


def cell_cuts(docs: DataFrame, cells: int) -> list[int]:
    """At most `cells` values of doc_id that cut the table into runs of about equal length; the last is the largest.

    Only these numbers reach the driver. percentile_approx merges bounded sketches, in doubles, so its cuts may equal no
    row; each one gives way to the largest doc_id of its run.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)], F.lit(1.0))
    row = docs.agg(F.percentile_approx(key, shares).alias("cuts"), F.max(key).alias("top")).first()
    if not row["cuts"]:
        return []
    rough = sorted({*row["cuts"], row["top"]})
    run = _cell_of(key, rough, 0, len(rough) - 1).alias("run")
    return sorted(r["cut"] for r in docs.groupBy(run).agg(F.max(key).alias("cut")).collect())  # a row per run at most


def _cell_of(key: Column, cuts: list[int], low: int, high: int) -> Column:
    """Index of the least cut that is not below the key, by a tree of comparisons."""
    if high <= low:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key <= F.lit(cuts[mid]), _cell_of(key, cuts, low, mid)).otherwise(
        _cell_of(key, cuts, mid + 1, high))


def with_next(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """Rows (doc_id, text, fingerprint, next_text, next_fingerprint): next in descending doc_id, after the last the first.

    The table is cut into cells of doc_id. Where a cell begins is known from its cut, so its first rows go to the cell
    before it as well, and each cell finds all its neighbours on its own: one shuffle, no ordering of the whole table.
    Null doc_ids come last, rows with equal doc_id are in order of a hash of their text; of equal rows, one follows the other.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cells = cells or max(64, 4 * partitions(docs.sparkSession))
    cuts = cell_cuts(docs, cells)
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    own = _cell_of(F.col("order_key"), cuts, 0, max(0, len(cuts) - 1))
    rows = docs.withColumns({"order_key": key, "order_hash": text_hash()}).withColumn("cell", own)
    # A cell's largest key is its cut; those rows are also the end of the cell above, the lowest cell's own is the top's.
    heads = F.array(F.struct(F.col("cell").alias("cell"), F.lit(False).alias("guest")),
                    F.struct(((F.col("cell") + 1) % F.lit(max(1, len(cuts)))).alias("cell"), F.lit(True).alias("guest")))
    alone = F.slice(heads, 1, 1)
    at_cut = F.col("order_key").isin(cuts) if len(cuts) <= 16 else F.col("order_key") == _cut_of(F.col("cell"), cuts)
    rows = rows.withColumn("place", F.explode(F.when(at_cut, heads).otherwise(alone)))
    rows = rows.select("doc_id", "text", "order_key", "order_hash", "place.cell", "place.guest")
    rows = with_fingerprint(rows.repartition(partitions(docs.sparkSession), "cell"), "text", "fingerprint")
    order = W.partitionBy("cell").orderBy("guest", F.col("order_key").desc(), "order_hash")
    rows = rows.withColumns({"next_text": F.lead("text").over(order),
                             "next_fingerprint": F.lead("fingerprint").over(order)})
    return rows.where(~F.col("guest")).select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def _cut_of(cell: Column, cuts: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in cuts]), cell + 1)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, and of the text with its last half replaced by the start of the next document."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "edited_fingerprint")
    own, changed, after = (hashes(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    return rows.select("doc_id", n.cast("bigint").alias("n_chars"),
                       F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       listed(F.col("fingerprint")).alias("fingerprint"),
                       listed(F.col("edited_fingerprint")).alias("edited_fingerprint"),
                       likeness(own, changed).alias("near_edited"), likeness(own, after).alias("near_next"))
