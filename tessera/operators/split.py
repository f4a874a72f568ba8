"""Train / test splitting before any fitting.

``random_split`` is the reference's ``randomSplit``; its membership depends
on the input's partitioning (D5). ``hash_split`` assigns each row from its
key alone: bucket = first 8 hex digits of md5("<seed>:<key>") mod 100, so a
row lands on the same side on any cluster, any run, and in SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Split seed and training share.
SEED = 42
TRAIN_PCT = 80


def hash_bucket(key: str | Column, seed: int = SEED, mod: int = 100) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"))), 1, 8), 16, 10)
    return F.pmod(h.cast("bigint"), F.lit(mod)).cast("int")


def hash_split(df: DataFrame, key: str, seed: int = SEED,
               train_pct: int = TRAIN_PCT) -> tuple[DataFrame, DataFrame]:
    b = hash_bucket(key, seed, 100)
    return df.filter(b < train_pct), df.filter(b >= train_pct)


def with_side(df: DataFrame, key: str, seed: int = SEED, train_pct: int = TRAIN_PCT,
              name: str = "side") -> DataFrame:
    """The split as a column ('train' / 'test'), for one-pass reporting."""
    return df.withColumn(name, F.when(hash_bucket(key, seed, 100) < train_pct, F.lit("train"))
                         .otherwise(F.lit("test")))


def random_split(df: DataFrame, weights=(0.8, 0.2), seed: int = SEED):
    """The reference's split: Bernoulli sampling per partition."""
    return df.randomSplit(list(weights), seed=seed)
