"""Data profiling in single-pass aggregations.

The reference runs two Spark jobs per profiled column (24 for 12 columns).
Here each profile is one aggregate over the table, reshaped to long form
with ``unpivot``; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import missing
from ..functions.scalars import pct, tenth_bin, width_bin
from ..session import materialize, stored
from .joins import BROADCAST_MAX_ROWS, lookup
from .quantiles import exact_quantiles, rank_errors

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, nulls, pct) for each column in one aggregate.

    Missing = null, or empty string for text columns (D2).
    """
    cols = cols or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count_if(missing(df, c)).alias(c) for c in cols])
    long = wide.unpivot("__rows", cols, "column_name", "nulls")
    return long.select("column_name", F.col("nulls").cast("long").alias("nulls"),
                       pct(F.col("nulls"), F.col("__rows")).alias("pct"))


def null_report(df: DataFrame, top: int = 15) -> DataFrame:
    """Every column, most nulls first (ties by name), first ``top`` rows."""
    return null_profile(df).orderBy(F.col("nulls").desc(), F.col("column_name").asc()).limit(top)


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample stddev, min, max as typed columns (one row)."""
    c = F.col(col)
    return df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"),
                  F.stddev_samp(c).alias("stddev"), F.min(c).cast("double").alias("min"),
                  F.max(c).cast("double").alias("max"))


def histogram_tenths(df: DataFrame, col: str) -> DataFrame:
    """Rows per 0.1-wide bin of ``col``, ordered by bin (D3 fixed)."""
    return (df.groupBy(tenth_bin(col).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy("bin"))


def histogram_width(df: DataFrame, col: str, lo: float, width: float) -> DataFrame:
    """Equal-width bins from ``lo``; bin k covers [lo + k*w, lo + (k+1)*w)."""
    b = width_bin(col, lo, width)
    return (df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_lo", F.lit(float(lo)) + F.col("bin") * F.lit(float(width)))
            .orderBy("bin"))


def _digest(df: DataFrame, cols: list[str]) -> list[Column]:
    """128 bits of a row. The hashes skip nulls, so which columns are null is hashed as well."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return [F.xxhash64(nulls, *cols).alias("__d1"), F.xxhash64(F.lit(1), *cols, nulls).alias("__d2")]


def duplicates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows, distinct rows and surplus copies, in two stages.

    First rows are counted by a 128-bit digest: what is shuffled is two longs and a
    count, however wide the table is, with map-side partial counts for a row
    repeated a billion times. Only rows whose digest occurs again are then grouped at
    full width, so the result does not rest on the digest. The list of those digests is
    broadcast if it has at most BROADCAST_MAX_ROWS; a longer one is joined by shuffling rows.
    """
    cols = cols or df.columns
    rows = df.select(*cols)
    digested = rows.select("*", *_digest(rows, cols))
    counts = stored(digested.select("__d1", "__d2").groupBy("__d1", "__d2").agg(F.count(F.lit(1)).alias("__c")), "row-digests")
    again = counts.filter(F.col("__c") > 1).select("__d1", "__d2")
    if again.count() <= BROADCAST_MAX_ROWS:
        again = F.broadcast(again)  # whole rows then meet the list where they are read
    whole = digested.join(again, ["__d1", "__d2"], "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("__c"))
    once = counts.filter(F.col("__c") == 1).select("__c")
    return once.unionByName(whole.select("__c")).agg(
        F.sum("__c").cast("long").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
        F.sum(F.col("__c") - F.lit(1)).cast("long").alias("duplicate_rows"))


def extremes(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10: (column, min, max) as doubles, one aggregate."""
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c)).cast("double").alias(f"{c}__min"),
                 F.max(F.col(c)).cast("double").alias(f"{c}__max")]
    wide = df.agg(*aggs)
    stacked = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__min").alias("min"),
                 F.col(f"{c}__max").alias("max")) for c in cols]))
    return wide.select(stacked)


def _moments(c: Column) -> list[Column]:
    return [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
            F.skewness(c).alias("skew_pop"), F.kurtosis(c).alias("kurt_pop")]


def _sample_shape(n: Column, g1: Column, g2: Column) -> list[Column]:
    """Sample-corrected skewness G1 and excess kurtosis G2 from g1, g2."""
    nd = n.cast("double")
    skew_s = F.when(n > 2, g1 * F.sqrt(nd * (nd - 1)) / (nd - 2))
    kurt_s = F.when(n > 3, ((nd + 1) * g2 + 6) * (nd - 1) / ((nd - 2) * (nd - 3)))
    return [skew_s.alias("skew_samp"), kurt_s.alias("kurt_samp")]


# The percentiles of the wide statistics table.
WIDE_PROBS = (0.25, 0.5, 0.75, 0.95, 0.99)


def wide_stats(df: DataFrame, cols: list[str], probs=WIDE_PROBS) -> DataFrame:
    """Per column count, mean, std, min, p25..p99, max, skew, kurtosis.

    Columns are unpivoted to (column, value) so one aggregate grouped by
    column gives the moments, and the exact quantiles come from sketch brackets
    (never one task per column). An all-null column gives count 0 and null
    statistics.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "value")
    mom = long.groupBy("column_name").agg(*_moments(F.col("value")))
    mom = mom.select("*", *_sample_shape(F.col("count"), F.col("skew_pop"), F.col("kurt_pop")))
    q = exact_quantiles(long, "value", probs, group=["column_name"])
    names = [f"p{int(round(p * 100))}" for p in probs]
    cols_order = ["column_name", "count", "mean", "std", "min", *names, "max",
                  "skew_pop", "skew_samp", "kurt_pop", "kurt_samp"]
    return mom.join(q, on="column_name", how="left").select(*cols_order)


def approx_wide_stats(df: DataFrame, cols: list[str], probs=WIDE_PROBS,
                      accuracy: int = 10000) -> DataFrame:
    """A11 at scale: ``percentile_approx`` (bounded sketch) quantiles in one pass, checked in a second.

    ``<p>_rank_error`` is how far the exact rank of each answer is from the
    asked one, as a share of the column's values, and ``within`` whether all of them
    keep the sketch's promise, 1 / ``accuracy`` (one row of rounding allowed).
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "value")
    names = [f"p{int(round(p * 100))}" for p in probs]
    qs = F.percentile_approx("value", list(probs), accuracy)
    agg = long.groupBy("column_name").agg(*_moments(F.col("value")), qs.alias("__q"))
    answers = agg.select("column_name", "count", "mean", "std", "min",
                         *[F.col("__q")[i].alias(n) for i, n in enumerate(names)], "max", "skew_pop", "kurt_pop")
    answers = materialize(answers)
    errors = rank_errors(long, "value", answers, names, probs, "column_name")
    worst = F.greatest(*[F.col(f"{n}_rank_error") for n in names]) if len(names) > 1 else F.col(f"{names[0]}_rank_error")
    return answers.join(errors, "column_name", "left").withColumn(
        "within", worst <= F.lit(1.0 / accuracy) + F.lit(1.0) / F.col("count"))


def target_shape(df: DataFrame, target: str) -> DataFrame:
    """Mean, exact median, skewness and its direction label."""
    med = exact_quantiles(df, target, [0.5], names=["median"]).select("median").scalar()
    mom = df.agg(F.avg(target).alias("mean"), F.skewness(target).alias("skewness"))
    direction = (F.when(F.col("skewness") < 0, F.lit("left"))
                 .when(F.col("skewness") > 0, F.lit("right")).otherwise(F.lit("symmetric")))
    return mom.select("mean", med.alias("median"), "skewness", direction.alias("direction"))


# Fixed value: |r| under this counts as "close to zero".
NEAR_ZERO_R = 0.1


def length_correlation(df: DataFrame, text: str, target: str) -> DataFrame:
    """Pearson r of text length with the target, plus a label."""
    r = df.agg(F.corr(F.length(text).cast("double"), F.col(target).cast("double")).alias("r"))
    return r.select("r", F.when(F.abs("r") < NEAR_ZERO_R, F.lit("close to zero"))
                    .otherwise(F.lit("not negligible")).alias("strength"))


def mean_by(df: DataFrame, key: Column | str, target: str, name: str = "key",
            order_desc: bool = False) -> DataFrame:
    """Mean target per group (and rows per group)."""
    k = F.col(key) if isinstance(key, str) else key
    g = df.groupBy(k.alias(name)).agg(F.avg(target).alias("mean_target"),
                                      F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("mean_target").desc(), F.col(name)) if order_desc else g.orderBy(name)


def boxplot(df: DataFrame, col: str, group: str | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, Tukey fences (k * IQR), whiskers, outlier count.

    Quartiles are exact (sketch brackets). Per group, the fences table has
    one row per group and is joined to the rows; overall, the fences are
    scalar subqueries. Either way the outlier count is one more aggregate.
    """
    g = [group] if group else []
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], group=g, names=["q1", "median", "q3"],
                        with_n=bool(g))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lo_fence", F.col("q1") - F.lit(k) * F.col("iqr")) \
        .withColumn("hi_fence", F.col("q3") + F.lit(k) * F.col("iqr"))
    x = F.col(col).cast("double")

    def counts(lo: Column, hi: Column) -> list[Column]:
        return [F.count(x).alias("n"),
                F.count_if((x < lo) | (x > hi)).alias("outliers"),
                F.min(F.when(x >= lo, x)).alias("whisker_lo"),
                F.max(F.when(x <= hi, x)).alias("whisker_hi")]

    stats = ["q1", "median", "q3", "iqr", "lo_fence", "hi_fence"]
    if g:
        # Fences reach the rows through the skew-safe lookup (a hot group is
        # salted by its share of the rows); the counts aggregate partially.
        fences = q.select(*g, F.col("lo_fence").alias("__lo"), F.col("hi_fence").alias("__hi"),
                          F.col("n").alias("__gn"))
        j = lookup(df.select(*g, col), fences, g, count_col="__gn")
        cnt = j.groupBy(*g).agg(*counts(F.col("__lo"), F.col("__hi")))
        out = q.drop("n").join(cnt, on=g, how="inner")
    else:
        # One scalar subquery for all six statistics (a one-row struct).
        row = q.select(F.struct(*stats).alias("s")).scalar()
        sc = {c: row.getField(c) for c in stats}
        out = df.agg(*counts(sc["lo_fence"], sc["hi_fence"])).select(
            *[sc[c].alias(c) for c in stats], "*")
    return out.select(*g, *stats, "whisker_lo", "whisker_hi", "n", "outliers")


def dtype_inventory(df: DataFrame) -> DataFrame:
    """(position, column, type) plus the row count, as a DataFrame.

    The schema is metadata on the driver already; only the row count runs a
    job, as a scalar subquery.
    """
    spark = df.sparkSession
    meta = spark.createDataFrame([(i, f.name, f.dataType.simpleString())
                                  for i, f in enumerate(df.schema.fields)],
                                 "position int, column string, type string")
    rows = df.select(F.count(F.lit(1))).scalar()
    return meta.withColumn("n_rows", rows).withColumn("n_cols", F.lit(len(df.columns)))


def distinct_count(table: DataFrame, exact: bool = True, col: str | None = None) -> DataFrame:
    """Size of a fitted encoder (plus its default entry)."""
    if exact or col is None:
        return table.agg((F.count(F.lit(1)) + 1).alias("entries"))
    return table.agg((F.approx_count_distinct(col) + 1).alias("entries"))
