"""Scoring and reporting as DataFrames.

All four regression metrics come from one aggregate (the reference runs
one evaluator job per metric); nothing reaches the driver but the final
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import abs_error, blend
from ..session import materialize
from .topk import top_rows

# R2 verdict thresholds, worst-prediction count.
R2_REALISTIC = 0.4
R2_ACCEPTABLE = 0.6
WORST_K = 20


def _metric_aggs(y, p):
    # SST = n * population variance of the label: one pass, and Spark's
    # variance is a stable mergeable moment (no sum-of-squares cancellation).
    # Rows without a label or a prediction are not scored.
    y = F.when(p.isNotNull(), y)
    return [F.avg(F.pow(y - p, 2)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
            F.sum(F.pow(y - p, 2)).alias("__sse"), F.var_pop(y).alias("__vp"),
            F.count(y).alias("n")]


def _metric_cols():
    return [F.sqrt("mse").alias("rmse"), "mae",
            (F.lit(1.0) - F.try_divide(F.col("__sse"), F.col("__vp") * F.col("n"))).alias("r2"), "mse", "n"]


def metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row (rmse, mae, r2, mse, n) from a single aggregate.

    ``r2`` is null when all scored labels are equal.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return pred.agg(*_metric_aggs(y, p)).select(*_metric_cols())


def metrics_by(pred: DataFrame, model_col: str, label: str = "label",
               prediction: str = "prediction") -> DataFrame:
    """A19 for many models in one pass over a long (model, label, prediction) table."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return pred.groupBy(model_col).agg(*_metric_aggs(y, p)).select(model_col, *_metric_cols())


def with_error(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Add ``error`` = |label - prediction|."""
    return pred.withColumn("error", abs_error(label, prediction))


def worst_predictions(pred: DataFrame, key: str, k: int = WORST_K, label: str = "label",
                      prediction: str = "prediction") -> DataFrame:
    """The k largest absolute errors (ties by ``key``)."""
    e = with_error(pred, label, prediction).select(key, label, prediction, "error")
    return top_rows(e, "error", k, tie=[key])


def leaderboard(board: DataFrame) -> DataFrame:
    """L3 / T4: (model, rmse, mae, r2, minutes) sorted by RMSE; minutes null if not timed."""
    minutes = (F.when(F.col("seconds") > 0, F.col("seconds") / 60.0)
               if "seconds" in board.columns else F.lit(None).cast("double"))
    return (board.select("model", "rmse", "mae", "r2", minutes.alias("minutes"))
            .orderBy(F.col("rmse").asc(), F.col("model").asc()))


def improvement(board: DataFrame, baseline: str) -> DataFrame:
    """L4: each model's RMSE and R2 change against ``baseline``, in percent (null against 0).

    The board has one row per model, so it is checkpointed first (a bounded
    table) and the baseline row is read from that through one scalar
    subquery: the scoring plan behind the board runs once, not once more
    for the baseline.
    """
    board = materialize(board)
    base = board.filter(F.col("model") == F.lit(baseline)).select(
        F.struct("rmse", "r2").alias("b")).scalar()
    b_rmse, b_r2 = base.getField("rmse"), base.getField("r2")
    return board.select(
        "model", "rmse", "r2",
        (F.try_divide(b_rmse - F.col("rmse"), b_rmse) * 100).alias("rmse_improvement_pct"),
        (F.try_divide(F.col("r2") - b_r2, F.abs(b_r2)) * 100).alias("r2_improvement_pct"))


def r2_verdict(r2: Column) -> Column:
    """<0.4 realistic, <0.6 acceptable, else suspect leakage."""
    return (F.when(r2 < R2_REALISTIC, F.lit("realistic"))
            .when(r2 < R2_ACCEPTABLE, F.lit("acceptable"))
            .otherwise(F.lit("suspect leakage")))


def blended(pred: DataFrame, cols, weights=None, out: str = "prediction") -> DataFrame:
    """Weighted blend of prediction columns already on one row."""
    return pred.withColumn(out, blend(cols, weights) if weights else blend(cols))
