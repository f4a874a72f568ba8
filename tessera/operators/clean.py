"""Row cleaning with loss accounting.

Counting before and after cleaning is one aggregate with a conditional
count of the keep predicate, instead of two count jobs over two plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import missing
from ..functions.scalars import pct

# Critical columns of the two cleaning rules (movie schema),
# and the usable-row thresholds of the sufficiency verdict.
CRITICAL_CLEAN = ("description", "genre", "director", "actors", "duration", "avg_vote",
                  "year_clean")
CRITICAL_ENRICHED = CRITICAL_CLEAN + ("votes", "reviews_from_users", "reviews_from_critics")
ENOUGH_ROWS = 10_000
CAUTION_ROWS = 5_000


def drop_nulls(df: DataFrame, cols) -> DataFrame:
    """Drop rows null in any of ``cols``."""
    return df.na.drop(how="any", subset=list(cols))


def nonempty(df: DataFrame, cols) -> DataFrame:
    """Keep rows whose text columns are all non-empty (nulls were dropped)."""
    cond = None
    for c in cols:
        e = F.col(c) != F.lit("")
        cond = e if cond is None else cond & e
    return df.filter(cond)


def keep_predicate(df: DataFrame, not_null=(), not_empty=()) -> Column:
    """The combined P6 + P7 rule as one boolean column."""
    cond = F.lit(True)
    for c in not_null:
        cond = cond & F.col(c).isNotNull()
    for c in not_empty:
        cond = cond & ~missing(df, c)
    return cond


def loss_accounting(df: DataFrame, keep: Column) -> DataFrame:
    """Original, kept, removed rows and % lost, in one pass."""
    agg = df.agg(F.count(F.lit(1)).alias("original"), F.count_if(keep).alias("kept"))
    return agg.select("original", "kept",
                      (F.col("original") - F.col("kept")).alias("removed"),
                      pct(F.col("original") - F.col("kept"), F.col("original")).alias("pct_lost"))


def sufficiency(accounting: DataFrame, enough: int = ENOUGH_ROWS,
                caution: int = CAUTION_ROWS) -> DataFrame:
    """P10: verdict on the kept rows plus the usable percentage."""
    verdict = (F.when(F.col("kept") > enough, F.lit("sufficient"))
               .when(F.col("kept") > caution, F.lit("caution"))
               .otherwise(F.lit("insufficient")))
    return accounting.select("*", pct(F.col("kept"), F.col("original")).alias("pct_usable"),
                             verdict.alias("verdict"))
