"""Closed forms, split gains, isotonic points, hashing SQL and nested boosting against the ML solvers."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import FeatureHasher, HashingTF, VectorAssembler
from pyspark.sql import functions as F

from tessera.operators import linear, splits
from tessera.plans import catalog, features, models, tune
from tests.test_models import _linear


def _frame(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 100, 5]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(flat=2.0)
    pdf["y"] = 3 * pdf.a - 0.2 * pdf.b + 8 * pdf.c + rng.normal(size=n)
    return spark.createDataFrame(pdf)


def test_ridge_equals_the_solver(spark):
    df = _frame(spark)
    names = ["a", "b", "c", "flat"]
    fit = models.registry()["ridge"].build("v", "y", "p").fit(
        VectorAssembler(inputCols=names, outputCol="v").transform(df))
    got = {r.feature: r.coefficient for r in linear.ridge(df, names, "y", 0.1).collect()}
    assert [got[c] for c in names] == pytest.approx(list(fit.coefficients), rel=1e-8, abs=1e-12)
    assert got[linear.INTERCEPT] == pytest.approx(fit.intercept, rel=1e-8)


def test_closed_forms_of_odd_inputs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 9.0), (5.0, None)], "x double, y double")
    assert {r.feature: r.coefficient for r in linear.ridge(df, ["x"], "y", 0.1).collect()} == {"x": 0.0, linear.INTERCEPT: 2.0}
    assert linear.ridge(df.filter("x > 9"), ["x"], "y", 0.1).count() == 0
    flat = [tuple(r) for r in linear.shrunk(df, "x", "y", [(0.1, 1.0)]).collect()]
    assert flat == [(0.1, 1.0, 0.0, 2.0)]
    strong = linear.shrunk(_frame(spark), "a", "y", [(1e6, 1.0)]).first()
    assert strong.coefficient == 0.0


def test_split_gains_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 40, 500) / 4, rng.normal(size=500)
    rows = [(float(a), None if i % 50 == 0 else float(b), float(b) if i % 3 else None) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, z double, y double").repartition(7)
    got = {(r.feature, r.threshold): r for r in splits.split_gains(df, ["x", "z"], "y").collect()}
    for k, name in ((0, "x"), (1, "z")):
        fine = [(r[k], r[2]) for r in rows if r[k] is not None and r[2] is not None]
        v, t = np.array([a for a, _ in fine]), np.array([b for _, b in fine])
        values = np.unique(v)
        mine = {q: r for (f, q), r in got.items() if f == name}
        assert len(mine) == len(values) - 1
        for a, b in zip(values, values[1:]):
            left, right = t[v <= a], t[v >= b]
            gain = t.var() - len(left) / len(t) * left.var() - len(right) / len(t) * right.var()
            r = mine[(a + b) / 2]
            assert (r.n_left, r.n_right) == (len(left), len(right)) and r.gain == pytest.approx(gain, abs=1e-12)
    best = splits.best_split(splits.split_gains(df, ["x", "z"], "y"), 20).first()
    assert best.gain == max(r.gain for r in got.values() if min(r.n_left, r.n_right) >= 20)


def test_isotonic_points_give_the_fit_of_the_rows(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.exponential(1, 300) ** 4, np.full(200, 2.5)])  # equal-width bins would merge most of it
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, np.sqrt(x) + rng.normal(size=500))], "x double, y double")
    data = VectorAssembler(inputCols=["x"], outputCol="scaled_features").transform(df)
    est = models.registry()["isotonic"].build("scaled_features", "y", "p")
    on_rows = est.fit(data)
    points = models.isotonic_points(data, 0, "y")
    assert points.count() == len(np.unique(x))
    on_points = est.setWeightCol("weight").fit(points)
    got = [[r.p for r in m.transform(data).orderBy("x", "y").collect()] for m in (on_rows, on_points)]
    assert got[0] == pytest.approx(got[1], rel=1e-9)


def test_murmur_sql_equals_the_hashers(spark):
    terms = ["", "a", "ab", "abc", "abcd", "abcde", "é", "日本", "été x", "\U0001f600", "x" * 37, "genre=Café"]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    tf = {r.t: int(r.o.indices[0]) for r in HashingTF(inputCol="w", outputCol="o", numFeatures=1000).transform(
        df.withColumn("w", F.array("t"))).collect()}
    fh = {r.t: int(r.o.indices[0]) for r in FeatureHasher(inputCols=["t"], outputCol="o", numFeatures=1000).transform(df).collect()}
    con = duckdb.connect()
    con.execute("create table terms (term varchar)")
    con.executemany("insert into terms values (?)", [(t,) for t in terms] + [("t=" + t,) for t in terms])
    got = dict(con.sql(f"with {catalog._murmur_sql('hashed', 'terms', 'term')} "
                       f"select term, {catalog._slot_sql('h', 1000)} from hashed").fetchall())
    assert {t: got[t] for t in terms} == tf and {t: got["t=" + t] for t in terms} == fh


def test_prefixes_of_a_boosting_path_are_the_separate_fits(spark):
    prep = _linear(spark, n=400)
    train, valid = tune.inner_split(prep.train, "id")
    est = tune.BUILDERS["gbt"][0]("scaled_features", "y", "prediction").setMaxDepth(3)
    points = [{"maxIter": 4, "stepSize": 0.2}, {"maxIter": 9, "stepSize": 0.2}]
    assert tune.paths_of(est, tune.points_of({"maxIter": [4, 9], "stepSize": [0.1, 0.2]})) == [[0, 2], [1, 3]]
    for point, rmse in zip(points, tune.score_path(est, points, train, valid)):
        alone = est.copy({est.getParam(n): v for n, v in point.items()}).fit(train).transform(valid)
        assert rmse == pytest.approx(math.sqrt(alone.agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]), rel=1e-9)


def test_gbt_search_reports_every_point(spark):
    res = tune.search(_linear(spark, n=300), "gbt", grid={"maxIter": [2, 5], "maxDepth": [2], "stepSize": [0.1, 0.3]})
    rows = res.grid.collect()
    assert len(rows) == 4 and sum(r.is_best for r in rows) == 1
    best = next(r for r in rows if r.is_best)
    assert best.rmse == min(r.rmse for r in rows) and res.best_model.getNumTrees == best.maxIter


def test_partitions_follow_the_rows_and_fits_repeat(spark):
    spec = catalog._doc_spec()
    assert [features.fit_partitions(n, spec) for n in (0, 1, 100_000, 100_001, 10**9)] == [1, 1, 1, 2, 10_000]
    boards = []
    for width in ("3", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            prep = catalog._doc_prepared(spark, "/root/testdata/sf0.001")
            fit = models.fit_all(prep, ("random_forest", "gbt", "fm"), overrides={"gbt": {"maxIter": 3}, "fm": {"maxIter": 5}})
            boards.append({r.model: (r.rmse, r.mae) for r in fit.board.collect()})
            prep.release()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    for name, numbers in boards[0].items():
        assert numbers == pytest.approx(boards[1][name], rel=1e-9)
