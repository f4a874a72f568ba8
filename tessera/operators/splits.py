"""K4, L2, X5 laid open: the variance gain of every cut of a feature.

A regression tree's first step looks for the cut of one feature that lowers the
label's variance most. ``split_gains`` gives that number for every cut, as a table: one
grouped aggregate per (feature, value), then distributed running sums over the
values (``ordered.exclusive_prefix``), so neither a feature with many values nor one
value with many rows is a single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import exclusive_prefix


def split_gains(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, threshold, n_left, n_right, gain) of every cut between neighbouring values.

    Left of a cut is value <= threshold, the middle of its two neighbours. ``gain`` is the
    label's population variance minus the size-weighted variances of both sides:
    n_left n_right (mean_left - mean_right)^2 / n^2. Rows with a null label or a null
    value do not count for that feature; a feature with one value has no cut.
    """
    long = df.select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    long = long.unpivot("y", features, "feature", "value").filter("y is not null and value is not null")
    sums = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    ran = exclusive_prefix(sums, ["feature"], "value", ["n", "s"], totals=True, previous=True)
    left, right = F.col("n_before"), F.col("n_total") - F.col("n_before")
    apart = F.col("s_before") / left - (F.col("s_total") - F.col("s_before")) / right
    share = left.cast("double") * right / (F.col("n_total").cast("double") * F.col("n_total"))
    return ran.filter("n_before > 0").select(
        "feature", ((F.col("value_previous") + F.col("value")) / 2).alias("threshold"),
        left.alias("n_left"), right.alias("n_right"), (share * apart * apart).alias("gain"))


def best_split(gains: DataFrame, least: int = 1) -> DataFrame:
    """The cut of the largest gain with ``least`` rows on either side (one row, or none); ties by feature, then threshold."""
    fine = gains.filter((F.col("n_left") >= least) & (F.col("n_right") >= least))
    return fine.orderBy(F.desc("gain"), "feature", "threshold").limit(1)
