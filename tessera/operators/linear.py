"""K1, K5, K6, K9 in closed form: linear fits from sufficient statistics.

One aggregate over the rows gives the count, the means and the centred second
moments (population covariances, computed stably); everything else is arithmetic
on that one row. The penalties are those of Spark ML's linear regression with
``standardization`` on: with population deviations s_j of the features and s_y of the
label, the ridge solves (S + (reg / s_y) diag(s_j^2)) b = c for the covariances
S and c, and for one feature every elastic net is the soft threshold of the
correlation. The ML estimators stay the solvers of the runs; these forms check them and
fit many penalties from one scan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(intercept)"


def sufficient(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: n, ``means`` and ``moments`` (rows of the covariance matrix) of features and label.

    Rows with a null in any of the columns do not count. d features take (d + 1)(d + 2) / 2
    covariances in one aggregate with partial sums; only that row leaves the executors.
    """
    names = [*features, label]
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).na.drop()
    at = range(len(names))
    pairs = {(i, j): F.covar_pop(f"x{i}", f"x{j}") for i in at for j in at if j <= i}
    row = F.struct(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f"x{i}") for i in at]).alias("means"),
                   F.array(*[F.array(*[pairs[max(i, j), min(i, j)] for j in at]) for i in at]).alias("moments"))
    return x.agg(row.alias("s")).select("s.*")


def ridge(df: DataFrame, features: list[str], label: str, reg: float) -> DataFrame:
    """(feature, coefficient) of the ridge with its intercept, from one scan.

    Features without variance get 0, as does every feature of a constant label; no
    rows give an empty result. The d x d system is solved on the driver.
    """
    spark = df.sparkSession
    schema = "feature string, coefficient double"
    row = sufficient(df, features, label).first()
    if not row["n"]:
        return spark.createDataFrame([], schema)
    means, m = np.array(row["means"]), np.array(row["moments"])
    s, c, spread = m[:-1, :-1], m[:-1, -1], np.sqrt(m[-1, -1])
    used = np.flatnonzero(np.diag(s) > 0) if spread > 0 else np.zeros(0, int)
    b = np.zeros(len(features))
    if len(used):
        s = s[np.ix_(used, used)]
        b[used] = np.linalg.solve(s + reg / spread * np.diag(np.diag(s)), c[used])
    rows = [*zip(features, b.tolist()), (INTERCEPT, float(means[-1] - means[:-1] @ b))]
    return spark.createDataFrame(rows, schema)


def soft_threshold(x: Column, by: Column) -> Column:
    """sign(x) max(|x| - by, 0)."""
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))


def shrunk(df: DataFrame, feature: str, label: str, grid: list[tuple[float, float]]) -> DataFrame:
    """(reg, elastic, coefficient, intercept) of the one-feature elastic net at every (reg, elastic) of ``grid``.

    ``elastic`` 0 is the ridge, 1 the lasso. All points come from one scan. No rows, or
    a feature or label without variance, give coefficient 0 (and a null intercept without rows).
    """
    s = sufficient(df, [feature], label).select(
        F.col("means")[0].alias("mx"), F.col("means")[1].alias("my"), F.sqrt(F.col("moments")[0][0]).alias("sx"),
        F.sqrt(F.col("moments")[1][1]).alias("sy"), F.col("moments")[0][1].alias("c"))
    points = F.array(*[F.struct(F.lit(float(r)).alias("reg"), F.lit(float(e)).alias("elastic")) for r, e in grid])
    s = s.withColumn("p", F.explode(points)).select("*", "p.*")
    scaled = F.col("reg") / F.col("sy")
    slope = (soft_threshold(F.col("c") / (F.col("sx") * F.col("sy")), scaled * F.col("elastic"))
             / (1 + scaled * (1 - F.col("elastic"))) * F.col("sy") / F.col("sx"))
    varied = (F.col("sx") > 0) & (F.col("sy") > 0)
    s = s.withColumn("coefficient", F.when(varied, slope).otherwise(F.lit(0.0)))
    return s.select("reg", "elastic", "coefficient", (F.col("my") - F.col("coefficient") * F.col("mx")).alias("intercept"))
