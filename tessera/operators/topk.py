"""Ordering, limits and arg-min, all as DataFrame plans.

``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: each task
keeps its own k best rows and only k rows per task reach the final merge.
Ties are always broken by a key column so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_rows(df: DataFrame, by: str, k: int, tie: list[str] | None = None,
             descending: bool = True) -> DataFrame:
    """First k rows by ``by`` (then ``tie``)."""
    o = F.col(by).desc() if descending else F.col(by).asc()
    return df.orderBy(o, *[F.col(t).asc() for t in (tie or [])]).limit(k)


def top_importances(importances: DataFrame, k: int) -> DataFrame:
    """The k largest feature importances (ties by feature name)."""
    return importances.orderBy(F.col("importance").desc(), F.col("feature").asc()).limit(k)


def best_model(board: DataFrame) -> DataFrame:
    """T5: arg-min of RMSE as one row (model, rmse)."""
    return board.agg(F.min_by("model", F.struct("rmse", "model")).alias("model"),
                     F.min("rmse").alias("rmse"))
