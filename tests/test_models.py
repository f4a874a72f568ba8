"""K1-K14, M1-M9 on generated frames with a known signal, and on the driver tables."""

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.plans import models, tune
from tessera.plans.features import FeatureSpec, Prepared, prepare


def _linear(spark, n=1000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 10, n)
    y = 3 * x + 2 + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "y": y})
    df = VectorAssembler(inputCols=["x"], outputCol="scaled_features").transform(spark.createDataFrame(pdf))
    df = df.withColumn("features", F.col("scaled_features"))
    tr = df.filter(F.col("id") % 5 != 0)
    te = df.filter(F.col("id") % 5 == 0)
    spec = FeatureSpec(key="id", label="y", text=None, hashed=[], reduce=[], encoders=[], numeric=["x"],
                       indexed=[])
    return Prepared(tr, te, None, spec)


def test_linear_models_recover_signal(spark):
    prep = _linear(spark)
    fit = models.fit_all(prep, ("ridge", "glm", "random_forest", "decision_tree", "isotonic"),
                         overrides={"random_forest": {"numTrees": 10}})
    board = {r.model: r for r in fit.board.collect()}
    assert board["ridge"].r2 > 0.95 and board["glm"].r2 > 0.95 and board["isotonic"].r2 > 0.95
    assert all(math.isfinite(r.rmse) and r.seconds >= 0 for r in board.values())
    coef = fit.models["ridge"].coefficients[0]
    assert 2.7 < coef < 3.1


def test_ensemble_of_identical_models_is_identity(spark):
    prep = _linear(spark)
    fit = models.fit_all(prep, ("ridge",))
    m = fit.models["ridge"]
    ens = models.ensemble(prep, m, m, m).collect()
    assert all(abs(r.prediction - r.p_ridge) < 1e-9 for r in ens)


def test_grid_search_small(spark):
    prep = _linear(spark, n=300)
    res = tune.search(prep, "random_forest", grid={"numTrees": [5, 10], "maxDepth": [2, 4]})
    assert res.grid.count() == 4
    best = res.best.first()
    assert best.rmse == res.grid.agg(F.min("rmse")).first()[0]
    assert math.isfinite(res.test_metrics.first().rmse)


def test_feature_plan_on_documents(spark):
    from tessera.plans import catalog

    prep = catalog._doc_prepared(spark, "/root/testdata/sf0.001")
    names = prep.feature_names()
    assert len(names) == 100 + 16 + 1 + 1 + 1  # text + hashed + lang_freq + n_chars + indexed
    assert prep.train.count() + prep.test.count() > 0
    fit = models.fit_all(prep, ("ridge", "decision_tree"))
    assert fit.board.count() == 2
    imp = models.importances(fit.models["decision_tree"], names)
    assert abs(imp.agg(F.sum("importance")).first()[0] - 1.0) < 1e-9 or imp.count() == len(names)


def test_ml_query_releases_its_cache(spark):
    """A registered ML query returns a checkpointed result and leaves
    nothing cached behind (the prepared train/test tables are released)."""
    import __spark_entry__ as E

    cache = spark._jsparkSession.sharedState().cacheManager()
    spark.catalog.clearCache()
    out = E.queries()["feature_importances"](spark, "/root/testdata/sf0.001")
    assert cache.isEmpty()
    rows = out.collect()
    assert {r.model for r in rows} == {"random_forest", "decision_tree", "gbt"} and len(rows) <= 30


def test_prepared_tables_survive_losing_their_cache(spark):
    """Cached blocks can vanish with an executor; the prepared tables then
    recompute from their reliable checkpoints (not from the raw scan) and
    give the same rows."""
    from tessera.plans import catalog

    prep = catalog._doc_prepared(spark, "/root/testdata/sf0.001")
    try:
        before = sorted((r.doc_id, r.quality) for r in prep.train.select("doc_id", "quality").collect())
        spark.catalog.clearCache()  # every cached block gone
        after = sorted((r.doc_id, r.quality) for r in prep.train.select("doc_id", "quality").collect())
        assert before == after and len(after) > 0
        plan = prep.train._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" not in plan  # lineage starts at the checkpoint
    finally:
        prep.release()


def test_factorisation_machine_reads_finely_dealt_rows(spark, monkeypatch):
    """Its rows are dealt by their number alone, and a small table stays one partition with the same fit."""
    prep = _linear(spark, n=100)
    prep.train, prep.test = prep.train.repartition(1, "id").sortWithinPartitions("id"), prep.test.coalesce(1)
    seen, fit = [], models.FMRegressor.fit
    monkeypatch.setattr(models.FMRegressor, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    small = {"fm": {"maxIter": 3}}
    now = models.fit_all(prep, ("fm",), overrides=small).models["fm"]
    before = fit(models._fm("scaled_features", "y", "prediction", maxIter=3), prep.train)
    assert now.intercept == before.intercept and now.linear == before.linear and now.factors == before.factors
    monkeypatch.setattr(models, "FM_ROWS_PER_PARTITION", 20)
    models.fit_all(prep, ("fm",), overrides=small)
    assert seen == [1, 4]


def test_comparison_fits_the_whole_family(spark, monkeypatch):
    """K1-K9: by default and in ``model_comparison`` every model of the registry is fitted and scored."""
    from tessera.plans import catalog

    small = {"random_forest": {"numTrees": 2}, "gbt": {"maxIter": 2}, "fm": {"maxIter": 2}}
    prep = _linear(spark, n=100)
    assert {r.model for r in models.fit_all(prep, overrides=small).board.collect()} == set(models.registry())
    monkeypatch.setattr(catalog, "_doc_prepared", lambda *_: prep)
    fit_all = models.fit_all
    monkeypatch.setattr(models, "fit_all", lambda p, names: fit_all(p, names, overrides=small))
    board = catalog.model_comparison(spark, "").collect()
    assert len(board) == 9 and {r.model for r in board} == set(models.registry())
    assert all(math.isfinite(r.rmse) for r in board)


def test_isotonic_fit_of_points_is_the_fit_of_the_rows(spark):
    """K8 with repeated feature values of unlike counts: same steps and predictions as MLlib on every row."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 600) ** 2 / 10.0
    pdf = pd.DataFrame({"id": np.arange(600), "x": x, "y": np.sqrt(x) + rng.normal(0, 2, 600)})
    df = VectorAssembler(inputCols=["x"], outputCol="scaled_features").transform(spark.createDataFrame(pdf))
    spec = FeatureSpec(key="id", label="y", text=None, hashed=[], reduce=[], encoders=[], numeric=["x"], indexed=[])
    prep = Prepared(df.withColumn("features", F.col("scaled_features")), df, None, spec)
    prep.train = prep.train.cache()
    prep.feature_names = lambda: ["x"]
    got = models.fit_all(prep, ("isotonic",)).models["isotonic"]
    rows = models.IsotonicRegression(featuresCol="scaled_features", labelCol="y").fit(df)
    assert np.allclose(got.boundaries.toArray(), rows.boundaries.toArray())
    assert np.allclose(got.predictions.toArray(), rows.predictions.toArray())


def test_search_asks_for_more_tasks_than_cores(spark, monkeypatch):
    """Fits run at once until their partitions are TASKS_PER_CORE tasks a core; the grid does not change."""
    prep = _linear(spark, n=100)
    prep.train, prep.test = prep.train.coalesce(1), prep.test.coalesce(1)
    sizes, pool = [], tune.ThreadPool
    monkeypatch.setattr(tune, "ThreadPool", lambda n: sizes.append(n) or pool(n))
    monkeypatch.setattr(tune, "CONCURRENT_FITS", 1)
    grid = {"regParam": [0.01, 0.1, 0.2, 0.3, 0.5], "elasticNetParam": [0.0]}
    many = tune.search(prep, "ridge", grid=grid).grid.collect()
    assert sizes == [min(5, 2 * spark.sparkContext.defaultParallelism)]
    assert many == tune.search(prep, "ridge", grid=grid, parallelism=1).grid.collect()


def test_long_fits_start_first(spark, monkeypatch):
    """A forest's trees and depth make its fit long, many rows a leaf do not."""
    seen = []
    monkeypatch.setattr(tune, "score_path", lambda est, points, *_: seen.append(points[0]) or [1.0])
    grid = {"numTrees": [2, 3], "maxDepth": [1, 2], "minInstancesPerNode": [1, 40]}
    tune.search(_linear(spark, n=60), "random_forest", grid=grid, parallelism=1)
    assert [p["numTrees"] * p["maxDepth"] for p in seen] == [6, 6, 4, 4, 3, 3, 2, 2]


def test_winning_forest_reads_finely_dealt_rows(spark, monkeypatch):
    """Fitted alone, the winner is dealt over more tasks than the search's fits; a small table stays as it is."""
    prep = _linear(spark, n=100)
    prep.train, prep.test = prep.train.repartition(1, "id").sortWithinPartitions("id"), prep.test.coalesce(1)
    seen, fit = [], tune.RandomForestRegressor.fit
    monkeypatch.setattr(tune.RandomForestRegressor, "fit",
                        lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())) or fit(self, df))
    grid = {"numTrees": [3], "maxDepth": [2]}
    small = tune.search(prep, "random_forest", grid=grid)
    whole = fit(models._forest("scaled_features", "y", "prediction", numTrees=3, maxDepth=2), prep.train)
    assert small.best_model.toDebugString.split("\n")[1:] == whole.toDebugString.split("\n")[1:]
    monkeypatch.setattr(tune, "REFIT_ROWS_PER_PARTITION", 20)
    fine = tune.search(prep, "random_forest", grid=grid)
    assert [p for p, _ in seen] == [1, 1, 1, 4] and seen[1][1] == seen[3][1] == 80
    assert fine.grid.collect() == small.grid.collect()
    spec = FeatureSpec(key="id", label="y")
    monkeypatch.undo()
    assert [tune.refit_partitions(n, spec) for n in (0, 1, 15_000, 15_001, 164_000, 10**6, 10**7)] == [1, 1, 1, 2, 11, 16, 100]
    assert tune.refit_partitions(10**6, FeatureSpec(key="id", label="y", fit_partitions=3)) == 3


def test_lineitem_fits_bound_the_rows_of_a_task(spark, tmp_path, monkeypatch):
    """One file of one row group is still dealt over tasks, and the cut stays the same."""
    from tessera.plans import catalog

    rows = [(float(i % 50), i % 11 / 100.0, i % 9 / 100.0, i % 7, 100.0 * (i % 50)) for i in range(200)]
    spark.createDataFrame(rows, "l_quantity double, l_discount double, l_tax double, l_linenumber int, l_extendedprice double") \
        .coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = catalog.boosted_stumps(spark, str(tmp_path)).collect()
    monkeypatch.setattr(catalog, "_ROWS_PER_FIT_TASK", 30)
    sizes = catalog._split_vectors(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 200 and len(sizes) == 7 and max(r["count"] for r in sizes) <= 40
    assert catalog.boosted_stumps(spark, str(tmp_path)).collect() == whole
