import numpy as np
import pytest
from pyspark.sql import functions as F
from tidelog.llm import whitening as w
from tidelog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows):
    """{vec_id: (deviation, centred vector)}, covariance and n of (vec_id, vector) pairs, with numpy alone."""
    good = [(k, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for k, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    out = [(k, sum((n * c - s) ** 2 for c, s in zip(x, sums)), np.array([(n * c - s) / n for c, s in zip(x, sums)])) for k, x in good]
    return out, covariance, n


def check(got, rows, k=4):
    expected, covariance, n = plain(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == k * len(expected)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {}
    for key, deviation, x in expected:
        assert set(by[key]) == set(range(1, k + 1))
        for i in range(k):
            r = by[key][i + 1][0]
            whole = x @ vectors[:, i] / np.sqrt(values[i])
            if abs(whole) > 1e-3:
                assert signs.setdefault(i, np.sign(whole * r.whitened)) == np.sign(whole * r.whitened)
            assert abs(abs(r.whitened) - abs(whole)) < 1e-9
            assert r.deviation == deviation and r.n == n
            assert r.explained == pytest.approx(values[i] / values.sum(), rel=1e-10)
            assert r.identity_error < 1e-10


def test_report_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = QUERIES["op12_whitening"](spark, SF)
    assert [f"{c} {t}" for c, t in out.dtypes] == ["vec_id bigint", "component int", "n bigint", "deviation bigint",
                                                   "whitened double", "explained double", "identity_error double"]
    check(out.collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = [[float(c) for c in rng.normal(size=3)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[0]) for i in range(30)]
    bad = [(2000, None), (2001, [1.0, None, 2.0]), (2002, [float("nan"), 0.0, 1.0]), (2003, [float("inf"), 0.0, 1.0])]
    frame = spark.createDataFrame(rows + bad, SCHEMA).repartition(7).select(
        "*", F.lit(1).alias("x"), F.lit("a").alias("k"), F.lit(2).alias("n"), F.lit(0).alias("component"))
    check(w.whitening_report(frame).collect(), rows)
    again = spark.createDataFrame([(None, v) for v in base] + [(5, v) for v in base], SCHEMA)
    out = w.whitening_report(again).collect()
    assert len(out) == 2 * 40 * 3 and {r.n for r in out} == {40}


@pytest.mark.parametrize("rows, components", [
    ([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0),
    ([(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [1.0, 2.0])], 1), ([(1, []), (2, [])], 0)])
def test_few_distinct_vectors(spark, rows, components):
    out = w.whitening_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == components * len(rows)
    assert all(np.isfinite(r.whitened) and r.explained == pytest.approx(1) for r in out)


def test_vectors_of_several_lengths(spark):
    with pytest.raises(ValueError, match="from 2 to 3 entries"):
        w.whitening_report(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], SCHEMA))


@pytest.mark.parametrize("seed", range(6))
def test_factorisation(seed):
    rng = np.random.default_rng(seed)
    d, rank = int(rng.integers(2, 40)), int(rng.integers(1, 40))
    x = rng.normal(size=(d, min(d, rank))) * np.exp(rng.normal(size=min(d, rank)) * 4)
    a = x @ x.T
    factor = w.pivoted_cholesky(a)
    assert np.abs(factor @ factor.T - a).max() < 1e-12 * a.max() * d
    values, vectors = w.one_sided_jacobi(factor)
    assert (np.diff(values) <= 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs((vectors * values) @ vectors.T - a).max() < 1e-12 * a.max() * d
    whole = np.linalg.eigvalsh(a)[::-1][:len(values)]
    assert np.abs(values - whole).max() < 1e-12 * whole[0] * d


def test_small_eigenvalues_keep_their_digits():
    """Of a scaled factor, one-sided rotations find small values that an eigensolver of the product loses."""
    rng = np.random.default_rng(9)
    factor = np.linalg.qr(rng.normal(size=(8, 8)))[0] * np.logspace(0, -12, 8)
    values, _ = w.one_sided_jacobi(factor)
    assert values == pytest.approx(np.logspace(0, -24, 8), rel=1e-9)


def test_exact_numbers_beyond_doubles():
    x = np.array([[2**40 + 1, -(2**40)], [5, 7]], np.int64)
    sums = np.array([2**40 + 6, -(2**40) + 7], object)
    assert w._deviations(x, 2**30, sums).tolist() == [[2**30 * a - s for a, s in zip(row, sums)] for row in x.tolist()]
    with pytest.raises(ValueError, match="too large for a long"):
        w._squares(w._deviations(x, 2**30, sums))
