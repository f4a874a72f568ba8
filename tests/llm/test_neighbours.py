import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string, v string, id string"


def _row(i, v):
    return (i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], 0, "r", "s", "v", "i")


def _fine(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v)


def _product(a, b):
    total = 0.0  # sum() would compensate
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def _brute(rows, k, query):
    out = set()
    fine = [r for r in rows if r[0] is not None and _fine(r[1])]
    for q in (r for r in fine if query(r[0])):
        scored = [(-_product(q[1], c[1]), c[0]) for c in fine
                  if c[0] != q[0] and len(c[1]) == len(q[1])]
        out |= {(q[0], n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.fixture
def small(monkeypatch):
    """Many stripes, parts, tiles and merges on few rows."""
    for name, value in (("PART_VALUES", 300), ("STRIPE_VALUES", 64), ("FAN", 2), ("TILE_QUERIES", 3),
                        ("TILE_ROWS", 17)):
        monkeypatch.setattr(nb, name, value)


def _got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force(spark, small):
    rng = np.random.default_rng(3)
    rows = [_row(i, rng.normal(size=8) * 10.0 ** rng.integers(-3, 4)) for i in range(-20, 300)]
    assert _got(nb.nearest(spark.createDataFrame(rows, SCHEMA).filter("vec_id % 20 = 0"),
                           spark.createDataFrame(rows, SCHEMA).repartition(5), 7)) == _brute(rows, 7, lambda i: i % 20 == 0)


def test_odd_rows(spark, small):
    same = [1.0, 2.0, -1.0]
    rows = [_row(i, same) for i in range(0, 60)] + [
        _row(100, None), _row(101, []), _row(102, [0.0, 0.0, 0.0]), _row(120, [1.0, None, 2.0]),
        _row(140, [float("nan"), 1.0, 1.0]), _row(160, [float("inf"), 1.0, 1.0]), _row(None, same),
        _row(180, [1.0, 2.0]), _row(181, [3.0, 4.0]), _row(200, [1e38, -1e38, 1e-38]), _row(201, [1e-45, 0.0, 0.0])]
    got = _got(nb.nearest(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA), 5))
    assert got == _brute(rows, 5, lambda i: True)
    assert {r[2] for r in got if r[0] == 180} == {181}


def test_repeated_ids_are_rows_of_their_own(spark, small):
    rows = [_row(20, [5.0, 1.0])] * 30 + [_row(i, [1.0, float(i)]) for i in range(21, 40)] + [_row(21, [9.0, 9.0])] * 2
    found = nb.nearest(spark.createDataFrame([rows[0], _row(20, [0.0, 1.0])], SCHEMA), spark.createDataFrame(rows, SCHEMA), 4)
    best = [(1, 21, 54.0), (2, 21, 54.0), (3, 39, 44.0), (4, 38, 43.0)]
    other = [(1, 39, 39.0), (2, 38, 38.0), (3, 37, 37.0), (4, 36, 36.0)]
    assert sorted(tuple(r)[1:] for r in found.collect()) == sorted(best + other)


def test_double_vectors_and_empty_tables(spark, small):
    rows = spark.createDataFrame([(1, [1e200, 1.0]), (2, [1e-200, 3.0]), (3, [0.1, 0.2])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in nb.nearest(rows, rows, 1).collect()}
    assert got == {(1, 1): 3, (2, 1): 1, (3, 1): 1}
    none = rows.filter("vec_id > 9")
    assert nb.nearest(none, rows).count() == 0 and nb.nearest(rows, none).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    v = rng.standard_t(1.5, size=(200, 33))
    codes, steps, coded, lost = nb.quantise(v)
    got = nb.tile_scores(codes, codes) * np.multiply.outer(steps, steps)
    bound = np.multiply.outer(coded, lost) + np.multiply.outer(lost, coded + lost)
    assert (np.abs(got - v @ v.T) <= bound + 1e-9 * np.abs(v @ v.T).max()).all()
    assert (nb.tile_scores(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert _got(nb.query(spark, sf).select("query_id", F.col("rank").cast("int"), "vec_id", "score")) == _brute(
        rows, 20, lambda i: i % 20 == 0)
