"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

1. Entries become integers, x = floor(scale * c), so that equal vectors are equal to the last bit. Each distinct vector
   is kept once: the fit list, written to the shared folder as packed integers.
2. Two passes over the fit list: sums per dimension, which are exact, then the scatter of the centred vectors. Each task
   adds up its own rows; partial sums of one row of the scatter meet in one task and are added as they come, so what is
   moved is one matrix a task, and the driver receives dimensions x dimensions numbers, whatever the table's size.
3. The scatter is factorised with pivoting, A = L L'. Columns of L are rotated in pairs until all are orthogonal: with
   L V = U D, A = U D² U', so the squared norms of the rotated columns are the eigenvalues and the normalised columns the
   components. Working on the factor keeps the accuracy that a product of the factor with itself would lose.
4. A map over the table writes the whitened coordinates. A third pass over the fit list measures how far their
   covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm.common import partitions, shared_folder, stored, tidy

SCALE = 256
COMPONENTS = 4
MAX_DIMENSIONS = 4096  # the driver factorises a matrix of this size at most
PIECE_ENTRIES = 1 << 20
LONG = 2.0**62


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, components as columns with falling eigenvalues, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: int = SCALE

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n for rows of integers. The difference is taken before the division wherever it is exact."""
        return _deviations(x, self.n, self.sums).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, exact: as longs, or as Python integers where longs are too short."""
    most = float(n) * float(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if most < LONG:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums.astype(object)


def _squares(deviations: np.ndarray) -> np.ndarray:
    """Sum of squares of each row as a long."""
    most = float(np.abs(deviations).max(initial=0))
    if deviations.dtype != object and most * most * deviations.shape[1] < LONG:
        return (deviations * deviations).sum(axis=1)
    total = (deviations.astype(object) ** 2).sum(axis=1)
    if len(total) and max(total) >= 1 << 63:
        raise ValueError("a deviation is too large for a long")
    return total.astype(np.int64)


# ---- rows as packed integers -------------------------------------------------------------

WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def _integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors are whole and finite, their lengths, and the integers of all their entries in a row."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    entries = vectors.flatten()  # those of null vectors are left out
    values = np.asarray(pc.cast(entries, pa.float64()).fill_null(np.nan))
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = np.asarray(vectors.is_valid()) & (bad[ends] == bad[ends - lengths])
    values = values[np.repeat(good, lengths)] * scale
    if values.size and np.abs(values).max() >= 2.0**63:
        raise ValueError("an entry is too large for a long")
    return good, lengths[good], np.floor(values).astype(np.int64) + 0


def packed(vectors: DataFrame, column: str, scale: int = SCALE, key: str | None = None) -> DataFrame:
    """(key, x) per row with a whole and finite vector: its integers, each in as few bytes as the row's largest needs."""
    kind = vectors.schema[key].dataType if key else None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                good, lengths, flat = _integers(part.column("v"), scale)
                ends, out = np.cumsum(lengths), []
                for start, end in zip((ends - lengths).tolist(), ends.tolist()):
                    x = flat[start:end]
                    low, high = int(x.min(initial=0)), int(x.max(initial=0))
                    wide = next(w for w in WIDTHS if np.iinfo(w).min <= low and high <= np.iinfo(w).max)
                    out.append(bytes([np.dtype(wide).itemsize]) + x.astype(wide).tobytes())
                columns = [part.column("k").filter(pa.array(good))] if key else []
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], [*["k"] * bool(key), "x"])

    chosen = [F.col(key).alias("k")] if key else []
    schema = f"k {kind.simpleString()}, x binary" if key else "x binary"
    return vectors.select(*chosen, F.col(column).alias("v")).mapInArrow(tidy(pack), schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part has many entries, unless one vector alone has."""
    widest = pc.max(pc.list_value_length(batch.column("v"))).as_py() or 1
    rows = max(1, PIECE_ENTRIES // widest)
    for low in range(0, len(batch), rows):
        yield batch.slice(low, rows)


def _matrix(x: pa.Array, dimensions: int) -> np.ndarray:
    rows = [np.frombuffer(b, WIDTHS[b[0].bit_length() - 1], offset=1) for b in x.to_pylist()]
    return np.array(rows, np.int64).reshape(len(rows), dimensions)


def _matrices(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, PIECE_ENTRIES // max(1, dimensions))
    for batch in batches:
        for low in range(0, len(batch), rows):
            part = batch.slice(low, rows)
            yield part, _matrix(part.column("x"), dimensions)


# ---- sums over the fit list --------------------------------------------------------------

def _summed(fit: DataFrame, dimensions: int, per_task, height: int, width: int) -> np.ndarray:
    """The sum over all tasks of a matrix that each task makes of its rows, as doubles."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        seen = False
        for _, x in _matrices(batches, dimensions):
            total += per_task(x)
            seen = True
        for low in range(0, height if seen else 0, 256):
            some = range(low, min(low + 256, height))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[i].tobytes() for i in some], pa.binary())],
                                             ["i", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for i, sums in zip(batch.column("i").to_pylist(), batch.column("sums").to_pylist()):
                if i != at:
                    if at is not None:
                        yield row(at, total)
                    at, total = i, np.zeros(width)
                total += np.frombuffer(sums)
        if at is not None:
            yield row(at, total)

    def row(i: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "sums"])

    schema = "i int, sums binary"
    parts = min(height, partitions(fit.sparkSession))
    rows = (fit.mapInArrow(tidy(partial), schema).repartition(parts, "i").sortWithinPartitions("i")
            .mapInArrow(tidy(added), schema).collect())  # height rows of `width` numbers
    out = np.zeros((height, width))
    for r in rows:
        out[r.i] = np.frombuffer(r.sums)
    return out


def _exact_sums(fit: DataFrame, dimensions: int) -> tuple[int, np.ndarray]:
    """Number of vectors, and their sums per dimension as integers of any size."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(dimensions, np.int64), np.zeros(dimensions, np.int64)
        for _, x in _matrices(batches, dimensions):  # at most 2**20 rows a piece: sums of 32-bit halves fit into longs
            n += len(x)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += (x >> 32).sum(axis=0)
            high, low = high + (low >> 32), low & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimensions), pa.int32()), pa.array([n, *low.tolist()], pa.int64()),
                                          pa.array([0, *high.tolist()], pa.int64())], ["i", "low", "high"])

    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")]
    rows = fit.mapInArrow(tidy(partial), "i int, low bigint, high bigint").groupBy("i").agg(*exact).collect()  # a row a dimension
    totals = {r.i: int(r.low) + (int(r.high) << 32) for r in rows}
    return totals.get(-1, 0), np.array([totals.get(i, 0) for i in range(dimensions)], object)


# ---- the factorisation -------------------------------------------------------------------

def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with as many columns as `a` has rank, so that L L' = a up to rounding. Row order is that of `a`."""
    a = np.array(a, np.float64)
    d = len(a)
    rest, out = a.diagonal().copy(), np.zeros((d, d))
    least = d * np.finfo(np.float64).eps * rest.max(initial=0)
    for k in range(d):
        p = int(rest.argmax())
        if not rest[p] > least:
            return out[:, :k]
        column = (a[:, p] - out[:, :k] @ out[p, :k]) / np.sqrt(rest[p])
        column[rest == -np.inf] = 0  # rows that were pivots before: zero but for rounding
        column[p] = np.sqrt(rest[p])
        out[:, k] = column
        rest = np.where(rest == -np.inf, rest, rest - column**2)
        rest[p] = -np.inf
    return out


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of L L', falling, and its eigenvectors as columns: pairs of columns of L are rotated until every two
    are orthogonal. A round rotates disjoint pairs at once; in a sweep each pair has its turn."""
    u = np.array(factor, np.float64)
    r = u.shape[1]
    turns = list(range(r + r % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(turns) - 1):
            half = len(turns) // 2
            pairs = [(i, j) for i, j in zip(turns[:half], reversed(turns[half:])) if max(i, j) < r]
            worst = max(worst, _rotate(u, *np.array(pairs, np.int64).reshape(-1, 2).T))
            turns = [turns[0], turns[-1], *turns[1:-1]]
        if worst <= 4 * np.finfo(np.float64).eps:
            break
    norms = np.sqrt((u * u).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order]**2, u[:, order] / norms[order]


def _rotate(u: np.ndarray, p: np.ndarray, q: np.ndarray) -> float:
    """Make columns p and q orthogonal pair by pair; gives the largest cosine before."""
    a, b = u[:, p], u[:, q]
    alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
    size = np.sqrt(alpha * beta)
    cosine = np.divide(np.abs(gamma), size, out=np.zeros_like(gamma), where=size > 0)
    turn = cosine > np.finfo(np.float64).eps
    if turn.any():
        p, q, a, b = p[turn], q[turn], a[:, turn], b[:, turn]
        zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
        t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
        c = 1 / np.sqrt(1 + t * t)
        u[:, p], u[:, q] = c * a - c * t * b, c * t * a + c * b
    return float(cosine.max(initial=0))


# ---- the operator ------------------------------------------------------------------------

def fit_list(vectors: DataFrame, column: str, folder: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Each distinct vector of integers once, stored, and the number of dimensions. Vectors of several lengths are an error."""
    fit = stored(packed(vectors, column, scale).distinct(), folder, "fit")
    lengths = fit.select(F.expr("(octet_length(x) - 1) div ascii(decode(substring(x, 1, 1), 'ISO-8859-1'))").alias("d")).agg(
        F.min("d"), F.max("d")).first()
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors have from {lengths[0]} to {lengths[1]} entries")
    if (lengths[0] or 0) > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {lengths[0]} entries; at most {MAX_DIMENSIONS} are supported")
    return fit, int(lengths[0] or 0)


def fit_whitening(vectors: DataFrame, column: str, folder: str, scale: int = SCALE) -> tuple[Whitening, DataFrame]:
    """The whitening of a table of vectors, and its stored fit list (x as packed integers).

    Null vectors and those with null or non-finite entries don't take part; repeated vectors count once. There are as
    many components as the covariance has rank: none for an empty table or a single distinct vector.
    """
    fit, d = fit_list(vectors, column, folder, scale)
    n, sums = _exact_sums(fit, d)
    if not n or not d:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, scale), fit
    centre = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, scale)

    def scatter(x: np.ndarray) -> np.ndarray:
        y = centre.centred(x)
        return y.T @ y

    covariance = _summed(fit, d, scatter, d, d) / n
    values, vectors_ = one_sided_jacobi(pivoted_cholesky((covariance + covariance.T) / 2))
    if values.size:
        vectors_ = vectors_ * np.sign(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(len(values))])
    return Whitening(n, sums, vectors_, values, float(covariance.trace()), scale), fit


def identity_error(model: Whitening, fit: DataFrame, k: int) -> float:
    """Largest entry of the covariance of the first k whitened coordinates over the fit list, less the identity."""
    k = min(k, len(model.eigenvalues))
    if not k:
        return 0.0
    first = Whitening(model.n, model.sums, model.components[:, :k], model.eigenvalues[:k], model.trace, model.scale)

    def moments(x: np.ndarray) -> np.ndarray:
        w = first.whitened(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _summed(fit, len(model.sums), moments, k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, column: str, key: str, k: int = COMPONENTS) -> DataFrame:
    """(key, deviation, coordinates) per row with a whole and finite vector; `coordinates` has the first k components.

    Keys may be null or repeated, each row is answered; further columns are not read; an empty table gives no rows.
    """
    k = min(k, len(model.eigenvalues))
    first = Whitening(model.n, model.sums, model.components[:, :k], model.eigenvalues[:k], model.trace, model.scale)
    kind, arrow_kind = vectors.schema[key].dataType.simpleString(), to_arrow_type(vectors.schema[key].dataType)
    d = len(model.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, d):
            yield pa.RecordBatch.from_arrays(
                [part.column("k").cast(arrow_kind), pa.array(_squares(_deviations(x, first.n, first.sums)), pa.int64()),
                 pa.array(list(first.whitened(x)), pa.list_(pa.float64()))], [key, "deviation", "coordinates"])

    return packed(vectors, column, model.scale, key).mapInArrow(
        tidy(project), f"`{key}` {kind}, deviation bigint, coordinates array<double>")


def whitening_report(vectors: DataFrame) -> DataFrame:
    """A row per vector and component up to 4, or up to the rank of the covariance where that is less."""
    model, fit = fit_whitening(vectors, "embedding", shared_folder(vectors.sparkSession))
    error = identity_error(model, fit, COMPONENTS)
    shares = [float(e / model.trace) for e in model.eigenvalues[:COMPONENTS]]
    rows = whiten(vectors, model, "embedding", "vec_id").select(
        "vec_id", "deviation", F.posexplode("coordinates").alias("at", "whitened"))
    explained = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
                       "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
