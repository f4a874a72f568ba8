"""Key joins and skew-safe lookups.

A *lookup table* has one row per key (an encoder fitted as a DataFrame).
Joining facts to it is the replacement for the reference's driver-side map
captured in a UDF. Three physical shapes, chosen by what is known about the
table:

* the table has a proven row bound (top-N, a fixed list) -> broadcast;
* otherwise a shuffle join whose hot keys are salted: every key that holds
  more than one shuffle partition's share of the rows (at most as many keys
  as partitions, by counting) is spread over sub-keys on the fact side and
  replicated on the table side, in proportion to its share, so a key holding
  a third of all rows is split across about two thirds of the partitions;
* AQE may still turn the shuffle join into a broadcast when the runtime
  size of the table is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``
  (Spark's own size check), and its skew-join rule is a second line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tables with a proven bound at or under this many rows are broadcast.
BROADCAST_MAX_ROWS = 100_000
# Sub-keys of the hottest key at most; None: the shuffle partition count.
SALT_BUCKETS = None

_SALT = "__salt"
_HOT = "__hot"


def unique_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key occurs more than once (empty when the key is unique).

    An aggregation with map-side partial counts, so it is cheap to run as an
    expectation before a join.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, key: str | list[str]) -> None:
    """Raise when ``key`` repeats (one aggregate; at most one row comes back)."""
    dup = unique_keys(df, key).limit(1).collect()
    if dup:
        raise ValueError(f"key {key!r} is not unique, e.g. {dup[0].asDict()}")


def join_on_key(left: DataFrame, right: DataFrame, key: str | list[str],
                how: str = "inner") -> DataFrame:
    """J1 (``how='left'``) and J2 (``how='inner'``): USING-style equi-join.

    The key appears once in the output. Strategy (broadcast / sort-merge /
    skew split) is left to AQE, which sees the real sizes at runtime.
    """
    return left.join(right, on=key, how=how)


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _match(lcols, rcols, null_safe: bool) -> Column:
    cond = None
    for lc, rc in zip(lcols, rcols):
        e = lc.eqNullSafe(rc) if null_safe else lc == rc
        cond = e if cond is None else cond & e
    return cond


def lookup(facts: DataFrame, table: DataFrame, key: str | list[str], *,
           count_col: str | None = None, bound: int | None = None,
           salt_by: list[str] | None = None, null_safe: bool = True,
           salt_buckets: int | None = SALT_BUCKETS,
           total: float | None = None) -> DataFrame:
    """Left-join ``facts`` to a one-row-per-key ``table`` on ``key``.

    Every fact row is kept exactly once; table columns are null where the key
    is unseen. ``bound`` is a proven upper bound on the table's rows (e.g.
    the N of a top-N fit): at or under ``BROADCAST_MAX_ROWS`` the table is
    broadcast. Otherwise hot keys are salted: those whose share of
    ``count_col`` (the fit-time count of each key) is over 1 / P, each split
    into sub-keys in proportion to its share of the rows (at most
    ``salt_buckets``, default the shuffle partition count). ``salt_by``
    names the fact columns hashed into the salt (a row key when there is
    one; all columns by default), so the salt is deterministic across task
    retries. ``null_safe`` lets a null key match a null category, as a map
    lookup of a null value would. ``total`` is the sum of ``count_col`` when
    already known (a streaming plan takes no scalar subquery); by default it
    is a scalar subquery over the table.
    """
    keys = _keys(key)
    other = [c for c in table.columns if c not in keys]
    clash = [c for c in other if c in facts.columns]
    if clash:
        raise ValueError(f"lookup columns already present in facts: {clash}")
    # Unique names on the table side, so conditions resolve by name even when
    # facts and table come from the same scan (leave-one-out, k-fold).
    tkeys = [f"__lk_{i}" for i in range(len(keys))]
    t0 = table.select(*[F.col(k).alias(tk) for k, tk in zip(keys, tkeys)], *other)
    fk = [F.col(k) for k in keys]

    if (bound is not None and bound <= BROADCAST_MAX_ROWS) or count_col is None:
        t = F.broadcast(t0) if bound is not None and bound <= BROADCAST_MAX_ROWS else t0
        j = facts.join(t, _match(fk, [F.col(tk) for tk in tkeys], null_safe), "left")
        return j.drop(*tkeys)

    # Hot keys hold more than 1 / P of the rows each, so there are fewer than
    # P of them: broadcasting that list is safe at any data size. Each gets a salt
    # count proportional to its share of the rows: about two salts per
    # shuffle partition's worth of rows, so a key holding a third of the
    # data is spread over two thirds of the partitions. Salts over all hot
    # keys add up to at most 3P replicated table rows.
    parts = salt_buckets or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = (F.lit(float(total)) if total is not None
             else t0.select(F.sum(count_col).cast("double")).scalar())
    n_salts = F.least(F.lit(parts), F.greatest(
        F.lit(1), F.ceil(F.col(count_col) / total * F.lit(2 * parts)))).cast("int")
    hkeys = [f"__hk_{i}" for i in range(len(keys))]
    hot = F.broadcast(
        t0.filter(F.col(count_col) * F.lit(parts) > total)
        .select(*[F.col(tk).alias(hk) for tk, hk in zip(tkeys, hkeys)], n_salts.alias(_HOT)))
    salt_cols = salt_by or facts.columns
    f = (facts.join(hot, _match(fk, [F.col(h) for h in hkeys], null_safe), "left")
         .drop(*hkeys)
         .withColumn(_SALT, F.when(F.col(_HOT) > 1,
                                   F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.col(_HOT)))
                     .otherwise(F.lit(0)).cast("int"))
         .drop(_HOT))
    t = (t0.join(hot, _match([F.col(tk) for tk in tkeys], [F.col(h) for h in hkeys], null_safe), "left")
         .drop(*hkeys)
         .withColumn("__tsalt", F.explode(F.when(F.col(_HOT) > 1, F.sequence(F.lit(0), F.col(_HOT) - 1))
                                          .otherwise(F.array(F.lit(0)))))
         .drop(_HOT))
    cond = _match(fk, [F.col(tk) for tk in tkeys], null_safe) & (F.col(_SALT) == F.col("__tsalt"))
    return f.join(t, cond, "left").drop(*tkeys, _SALT, "__tsalt")


def keep_or_other(facts: DataFrame, kept: DataFrame, col: str, bound: int,
                  other: str = "Other") -> DataFrame:
    """Keep the value when it is in ``kept`` (a top-N table), else ``other``.

    The kept set has at most ``bound`` rows, so it is broadcast.
    """
    k = kept.select(F.col(col).alias("__kv"), F.lit(True).alias("__keep"))
    kb = F.broadcast(k) if bound <= BROADCAST_MAX_ROWS else k
    j = facts.join(kb, F.col(col).eqNullSafe(F.col("__kv")), "left")
    return j.withColumn(col, F.when(F.col("__keep"), F.col(col)).otherwise(F.lit(other))) \
        .drop("__kv", "__keep")
