import math

import numpy as np
import pytest

from tessera.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, component string, n string, __x string, __v string"


def _frame(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "c", "n", "x", "v") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _brute(vectors, components=4):
    """{(id, component): (n, deviation, whitened up to sign, explained)} by numpy on exact whole numbers."""
    fine = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    points = sorted({tuple(x) for _, x in fine})
    n, d = len(points), len(points[0])
    sums = [sum(p[k] for p in points) for k in range(d)]
    apart = np.array([[n * p[k] - sums[k] for k in range(d)] for p in points], object)
    exact = apart.T.dot(apart)  # n^2 times the scatter, in whole numbers
    values, vectors_ = np.linalg.eigh(np.array(exact / n ** 3, float))
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    out = {}
    for i, x in fine:
        y = np.array([n * a - s for a, s in zip(x, sums, strict=True)], object)
        for k in range(components):
            out[i, k + 1] = (n, int((y * y).sum()), abs(float(np.dot(y.astype(float) / n, vectors_[:, k])) / math.sqrt(values[k])),
                             values[k] / values.sum())
    return out


def _agree(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(whitened, rel=1e-6, abs=1e-7)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9


def test_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 9)) * np.array([5, 4, 3, 2, 1, 1, .5, .2, .1])
    vectors = list(enumerate((base @ np.linalg.qr(rng.normal(size=(9, 9)))[0]).tolist()))
    vectors += [(1000 + i, vectors[7][1]) for i in range(500)]  # one vector over and over counts once
    _agree(wh.whiten(_frame(spark, vectors)).collect(), _brute(vectors))


def test_large_offset_costs_no_digits(spark):
    rng = np.random.default_rng(2)
    vectors = list(enumerate((rng.normal(size=(200, 5)) * [9, 7, 5, 3, 1] + 30000).tolist()))
    _agree(wh.whiten(_frame(spark, vectors)).collect(), _brute(vectors))


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [*enumerate(rng.normal(size=(40, 5)).tolist()), (None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    odd = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0]), (53, [float("nan")] * 5), (54, [1.0, 2.0]),
           (55, [float("-inf"), 0, 0, 0, 0])]
    _agree(wh.whiten(_frame(spark, vectors + odd)).collect(), _brute(vectors))


def test_rank_below_components(spark):
    line = [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(20)]
    got = wh.whiten(_frame(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    assert wh.whiten(_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert wh.whiten(_frame(spark, [])).count() == 0
    assert wh.whiten(_frame(spark, [(1, None)])).count() == 0


def test_deviation_past_64_bits():
    x = np.array([[1 << 40, 0], [-(1 << 40), 3]])
    assert wh.deviations(x, 2, (0, 3)) == [None, None]
    assert wh.deviations(x >> 11, 2, (0, 3)) == [(1 << 60) + 9, (1 << 60) + 9]


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_eigen(d):
    rng = np.random.default_rng(d)
    b = rng.normal(size=(d, max(d - 2, 1))) * 10.0 ** rng.integers(-4, 3, size=max(d - 2, 1))
    values, vectors = wh.eigen(b @ b.T)
    want = np.linalg.eigvalsh(b @ b.T)[::-1]
    assert len(values) >= np.sum(want > 1e-9 * want[0])
    assert values == pytest.approx(want[:len(values)], rel=1e-9, abs=1e-13 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(vectors * values @ vectors.T - b @ b.T).max() < 1e-12 * want[0]
    factor, order = wh.pivoted_cholesky(b @ b.T)
    assert np.abs(factor @ factor.T - (b @ b.T)[np.ix_(order, order)]).max() < 1e-12 * want[0]
    assert (np.triu(factor[:factor.shape[1]], 1) == 0).all()


def test_query_equals_exact_arithmetic(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    _agree(wh.query(spark, sf).collect(), _brute(vectors))
