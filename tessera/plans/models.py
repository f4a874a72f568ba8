"""The regressor family, fitted on one shared feature fit.

Every model reads the same checkpointed (key, label, features) tables from
``plans.features.prepare``. Predictions of all models are stacked into one
long table and scored in a single grouped aggregate; the ensemble chains
the three models' ``transform`` on one DataFrame (no row-id alignment of
separate plans, D6).
"""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, FMRegressor, GBTRegressor,
                                   GeneralizedLinearRegression, IsotonicRegression,
                                   LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BLEND_WEIGHTS, blend
from ..operators import audit, evaluate, topk
from ..session import cached, materialize
from .features import Prepared, dealt

SEED = 42

# Rows of a partition that the factorisation machine reads. Each of its 100 gradient steps
# takes tens of microseconds a row, far more than other fits' steps, so its rows are
# dealt finer than ROWS_PER_PARTITION; from the rows alone, so the fit repeats on any cluster.
FM_ROWS_PER_PARTITION = 2_000


@dataclass
class ModelSpec:
    name: str
    build: callable  # (features_col, label_col, prediction_col) -> estimator
    params: dict = field(default_factory=dict)


# The parameters of each regressor in the builders below.

def _ridge(elastic: float):
    def build(fc, lc, pc, **kw):
        return LinearRegression(featuresCol=fc, labelCol=lc, predictionCol=pc, maxIter=100,
                                regParam=0.1, elasticNetParam=elastic, tol=1e-6, **kw)
    return build


def _forest(fc, lc, pc, **kw):
    # cacheNodeIds keeps each row's current node per tree (checkpointed to
    # the shared folder every checkpointInterval levels) instead of sending
    # every tree to every task at each level. Same trees; on the 150-tree,
    # depth-15 grid point it fitted in 8.7 s instead of 14 s at sf0.1.
    p = dict(numTrees=30, maxDepth=8, minInstancesPerNode=10, subsamplingRate=0.8, seed=SEED,
             cacheNodeIds=True)
    p.update(kw)
    return RandomForestRegressor(featuresCol=fc, labelCol=lc, predictionCol=pc, **p)


def _gbt(fc, lc, pc, **kw):
    p = dict(maxIter=50, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=SEED)
    p.update(kw)
    return GBTRegressor(featuresCol=fc, labelCol=lc, predictionCol=pc, **p)


def _tree(fc, lc, pc, **kw):
    p = dict(maxDepth=10, minInstancesPerNode=20, minInfoGain=0.0, seed=SEED)
    p.update(kw)
    return DecisionTreeRegressor(featuresCol=fc, labelCol=lc, predictionCol=pc, **p)


def _fm(fc, lc, pc, **kw):
    p = dict(factorSize=8, fitIntercept=True, fitLinear=True, regParam=0.01,
             miniBatchFraction=0.8, initStd=0.01, maxIter=100, stepSize=0.001, seed=SEED)
    p.update(kw)
    return FMRegressor(featuresCol=fc, labelCol=lc, predictionCol=pc, **p)


def _isotonic(feature_index: int):
    def build(fc, lc, pc, **kw):
        return IsotonicRegression(featuresCol=fc, labelCol=lc, predictionCol=pc, isotonic=True,
                                  featureIndex=feature_index, **kw)
    return build


# Distinct values of the isotonic feature from which a fit says how many there are.
ISOTONIC_LARGE = 5_000_000


def isotonic_points(train: DataFrame, feature_index: int, label: str) -> DataFrame:
    """K8's input: one row per distinct value of the feature, its mean label and row count.

    Isotonic regression depends on the rows only through these, so the weighted points
    give exactly the fit of the rows. The feature column keeps its name, so the
    fitted model scores vectors. The solver pools the points on the driver: their
    number, not the rows', bounds its memory, and ``fit_all`` warns from ISOTONIC_LARGE on.
    """
    x = vector_to_array("scaled_features")[feature_index]
    return train.groupBy(x.alias("scaled_features")).agg(
        F.avg(label).alias(label), F.count(F.lit(1)).cast("double").alias("weight"))


def _glm(fc, lc, pc, **kw):
    return GeneralizedLinearRegression(featuresCol=fc, labelCol=lc, predictionCol=pc,
                                       family="gaussian", link="identity", maxIter=100,
                                       regParam=0.1, tol=1e-6, **kw)


def registry(isotonic_feature: int = 0) -> dict[str, ModelSpec]:
    """K1-K9 with the reference's parameters; the isotonic feature is named."""
    return {s.name: s for s in [
        ModelSpec("ridge", _ridge(0.0)),
        ModelSpec("random_forest", _forest),
        ModelSpec("gbt", _gbt),
        ModelSpec("decision_tree", _tree),
        ModelSpec("lasso", _ridge(1.0)),
        ModelSpec("elastic_net", _ridge(0.5)),
        ModelSpec("fm", _fm),
        ModelSpec("isotonic", _isotonic(isotonic_feature)),
        ModelSpec("glm", _glm),
    ]}


# The clean run trains every model but GBT (K3 is defined, not called there).
CLEAN_RUN = ("random_forest", "decision_tree", "ridge", "glm", "elastic_net", "fm", "lasso",
             "isotonic")
LEAK_RUN = ("ridge", "random_forest", "gbt", "decision_tree", "lasso", "elastic_net", "fm",
            "isotonic", "glm")
# K1-K9: what a comparison of the whole family fits.
ALL_MODELS = tuple(registry())


@dataclass
class FitResult:
    models: dict
    seconds: dict
    board: DataFrame       # model, rmse, mae, r2, mse, n, seconds
    predictions: DataFrame  # long: model, key, label, prediction


def fit_all(prep: Prepared, names=ALL_MODELS, specs: dict | None = None,
            overrides: dict | None = None) -> FitResult:
    """L7 + L1: fit each named model (fit timed alone), score all in one pass."""
    spark = prep.train.sparkSession
    if specs is None:
        # Isotonic regression reads one named feature (the first numeric
        # column), not whatever happens to sit in vector slot 0.
        slots = prep.feature_names()
        first = prep.spec.numeric[0] if prep.spec.numeric else None
        specs = registry(slots.index(first) if first in slots else 0)
    overrides = overrides or {}
    key, label = prep.spec.key, prep.spec.label
    models, seconds, preds = {}, {}, []
    for name in names:
        est = specs[name].build("scaled_features", label, "prediction", **overrides.get(name, {}))
        t0 = time.perf_counter()
        if isinstance(est, IsotonicRegression):
            est = est.setWeightCol("weight")
            points = materialize(isotonic_points(prep.train, est.getFeatureIndex(), label))
            distinct = points.count()
            if distinct > ISOTONIC_LARGE:
                warnings.warn(f"isotonic regression pools {distinct} distinct values on the driver", stacklevel=2)
            models[name] = est.fit(points)
        elif isinstance(est, FMRegressor):
            rows = prep.train.count()
            fine = cached(dealt(prep.train.select(key, label, "scaled_features"), key,
                                -(-rows // FM_ROWS_PER_PARTITION)))
            try:
                models[name] = est.fit(fine)
            finally:
                fine.unpersist()
        else:
            models[name] = est.fit(prep.train)
        seconds[name] = time.perf_counter() - t0
        preds.append(models[name].transform(prep.test)
                     .select(F.lit(name).alias("model"), key, label, "prediction"))
    long = preds[0]
    for p in preds[1:]:
        long = long.unionByName(p)
    metrics = evaluate.metrics_by(long, "model", label=label, prediction="prediction")
    times = spark.createDataFrame([(n, float(s)) for n, s in seconds.items()],
                                  "model string, seconds double")
    board = metrics.join(F.broadcast(times), on="model", how="inner")
    return FitResult(models, seconds, board, long)


def ensemble(prep: Prepared, ridge, forest, gbt, weights=BLEND_WEIGHTS) -> DataFrame:
    """Chained transforms on one DataFrame, then the weighted blend."""
    label = prep.spec.label
    df = prep.test
    for name, m in (("p_ridge", ridge), ("p_rf", forest), ("p_gbt", gbt)):
        df = m.copy().setPredictionCol(name).transform(df)
    return df.withColumn("prediction", blend(["p_ridge", "p_rf", "p_gbt"], weights)) \
        .select(prep.spec.key, label, "p_ridge", "p_rf", "p_gbt", "prediction")


def importances(model, names: list[str]) -> DataFrame:
    """L2: (feature, importance) with names from the assembler metadata.

    The importance vector is model metadata (one value per feature slot),
    not data, so it is turned into a small DataFrame on the driver.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    rows = [(names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(imp)]
    return spark.createDataFrame(rows, "feature string, importance double")


TREE_MODELS = ("random_forest", "decision_tree", "gbt")


def all_importances(fit: FitResult, names: list[str], k: int) -> DataFrame:
    """L2 + T3 + X5: the k largest importances of every fitted tree model, audited."""
    out = None
    for name in (n for n in TREE_MODELS if n in fit.models):
        top = topk.top_importances(audit.dominance_audit(importances(fit.models[name], names)), k)
        top = top.select(F.lit(name).alias("model"), "*")
        out = top if out is None else out.unionByName(top)
    return out


def report(fit: FitResult) -> DataFrame:
    """L3 + L5 + T4: leaderboard with minutes and the R2 verdict."""
    lb = evaluate.leaderboard(fit.board)
    return lb.withColumn("verdict", evaluate.r2_verdict(F.col("r2")))


def worst(fit: FitResult, key: str, label: str, k: int = evaluate.WORST_K) -> DataFrame:
    """The k worst predictions of every model (T2 per model, stacked)."""
    out = None
    for name in fit.models:
        p = fit.predictions.filter(F.col("model") == F.lit(name))
        w = evaluate.worst_predictions(p, key, k, label=label, prediction="prediction") \
            .withColumn("model", F.lit(name))
        out = w if out is None else out.unionByName(w)
    return out
