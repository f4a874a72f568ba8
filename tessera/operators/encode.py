"""Category encoders fitted as DataFrames.

A fitted encoder is a table with one row per category (category, n, value)
plus a default for unseen categories. The default is a scalar subquery over
the training rows, so fitting never collects anything to the driver and
applying is a join (``operators.joins.lookup``) that keeps every row.

Fits are hash aggregations with map-side partial aggregation, so a category
holding a third of the rows still leaves each map task as one partial row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import keep_or_other, lookup
from .ordered import exclusive_prefix
from .split import hash_bucket

# Smoothing weight of the target encoder, size of the
# cardinality cut, label for the rest.
SMOOTHING = 10.0
TOP_N = 30
OTHER = "Other"


@dataclass
class Encoding:
    """A fitted encoder: ``table`` = (column, n, value), ``default`` for unseen."""

    column: str
    table: DataFrame
    default: Column
    suffix: str

    @property
    def output(self) -> str:
        return self.column + self.suffix

    def apply(self, df: DataFrame, drop: bool = True,
              salt_by: list[str] | None = None) -> DataFrame:
        """Add ``<col><suffix>``, unseen -> default; drop the raw column."""
        t = self.table.select(self.column, F.col("n").alias("__n"), F.col("value").alias("__v"))
        j = lookup(df, t, self.column, count_col="__n", salt_by=salt_by)
        j = j.withColumn(self.output, F.coalesce(F.col("__v"), self.default)).drop("__n", "__v")
        return j.drop(self.column) if drop else j


def _count() -> Column:
    return F.count(F.lit(1))


def _target_stats(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Per-key (n rows, s = sum, nt = non-null targets, mean), fitted once.

    Checkpointed: the lookup's hot-key list and the global mean then read
    this table instead of scanning the rows again.
    """
    return materialize(df.groupBy(*keys).agg(
        _count().alias("n"), F.sum(target).alias("s"), F.count(target).alias("nt"),
        F.avg(target).alias("mean")))


def _global_mean(stats: DataFrame) -> Column:
    """mu over all rows, from the per-key table (a scalar subquery)."""
    return stats.select((F.sum("s") / F.sum("nt")).alias("mu")).scalar()


def category_stats(train: DataFrame, cols: list[str], target: str | None = None) -> dict[str, DataFrame]:
    """Per column its (category, n) table, with s, nt and mean of ``target`` where one is named.

    All columns come from one scan and one shuffle: the rows are grouped by grouping
    sets, one per column, with partial aggregates before the shuffle. The result is
    checkpointed once; a null category is a category, told from another column's rows
    by the set's number.
    """
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}
    aggs = [_count().alias("n")]
    if target is not None:
        aggs += [F.sum("__y").alias("s"), F.count("__y").alias("nt"), F.avg("__y").alias("mean")]
    # The target under another name: a column may be both a category and the target.
    rows = train.select(*cols, *([F.col(target).alias("__y")] if target is not None else []))
    if len(cols) == 1:
        return {cols[0]: materialize(rows.groupBy(cols[0]).agg(*aggs))}
    sets = materialize(rows.groupingSets([[c] for c in cols], *cols).agg(F.grouping_id().alias("__set"), *aggs))
    every = (1 << len(cols)) - 1
    values = [c for c in sets.columns if c not in cols and c != "__set"]
    return {c: sets.filter(F.col("__set") == every - (1 << (len(cols) - 1 - k))).select(c, *values)
            for k, c in enumerate(cols)}


def fit_many(train: DataFrame, encoders: list[tuple[str, str]], target: str,
             smoothing: float = SMOOTHING) -> list[Encoding]:
    """E1f, E2f and plain means of many columns from one scan of the training rows.

    ``encoders`` pairs a column with ``"frequency"``, ``"target"`` or ``"mean"``; each
    result equals that of ``fit_frequency``, ``fit_target`` or ``fit_mean`` alone.
    """
    unknown = {kind for _, kind in encoders} - set(_FROM_STATS)
    if unknown:
        raise ValueError(f"unknown encoders {sorted(unknown)}")
    needs_target = any(kind != "frequency" for _, kind in encoders)
    stats = category_stats(train, [c for c, _ in encoders], target if needs_target else None)
    return [from_stats(kind, c, stats[c], smoothing) for c, kind in encoders]


def from_stats(kind: str, col: str, stats: DataFrame, smoothing: float = SMOOTHING) -> Encoding:
    """An encoder from a column's table of ``category_stats``."""
    return _FROM_STATS[kind](col, stats, smoothing)


def _frequency_of(col: str, counts: DataFrame, smoothing: float = SMOOTHING) -> Encoding:
    total = counts.select(F.sum("n").cast("double")).scalar()
    table = counts.select(col, "n", (F.col("n") / total).alias("value"))
    return Encoding(col, table, F.lit(1.0) / total, "_freq")


def _target_of(col: str, stats: DataFrame, smoothing: float = SMOOTHING) -> Encoding:
    mu = _global_mean(stats)
    value = (F.col("mean") * F.col("n") + mu * F.lit(smoothing)) / (F.col("n") + F.lit(smoothing))
    return Encoding(col, stats.select(col, "n", value.alias("value")), mu, "_encoded")


def _mean_of(col: str, stats: DataFrame, smoothing: float = SMOOTHING) -> Encoding:
    return Encoding(col, stats.select(col, F.col("mean").alias("value"), "n"), _global_mean(stats), "_mean")


_FROM_STATS = {"frequency": _frequency_of, "target": _target_of, "mean": _mean_of}


def fit_frequency(train: DataFrame, col: str) -> Encoding:
    """E1f: value = count(category) / train rows; unseen -> 1 / train rows."""
    return _frequency_of(col, category_stats(train, [col])[col])


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """Category popularity (category, n, freq) without applying it."""
    enc = fit_frequency(df, col)
    return enc.table.withColumnRenamed("value", "freq")


def fit_target(train: DataFrame, col: str, target: str,
               smoothing: float = SMOOTHING) -> Encoding:
    """E2f: (mean_c * n_c + mu * m) / (n_c + m); unseen -> mu (global mean)."""
    return _target_of(col, category_stats(train, [col], target)[col], smoothing)


def fit_mean(train: DataFrame, col: str, target: str) -> Encoding:
    """Plain mean target per category (no smoothing); unseen -> mu."""
    return _mean_of(col, category_stats(train, [col], target)[col])


def fit_top_n(train: DataFrame, col: str, n: int = TOP_N) -> DataFrame:
    """E3f / T1: the N most frequent categories; ties broken by the value."""
    return materialize(top_of(train.groupBy(col).agg(_count().alias("n")), col, n))


def top_of(counts: DataFrame, col: str, n: int = TOP_N) -> DataFrame:
    """T1 from a fitted (category, n) table: (category, count) of the N most frequent."""
    return (counts.select(col, F.col("n").alias("count"))
            .orderBy(F.col("count").desc(), F.col(col).asc_nulls_last()).limit(n))


def reduce_cardinality(df: DataFrame, col: str, top: DataFrame, n: int = TOP_N,
                       other: str = OTHER) -> DataFrame:
    """Categories outside the fitted top-N become ``other`` in place."""
    return keep_or_other(df, top.select(col), col, bound=n, other=other)


def _without_own(target: str, total: str, known: str) -> Column:
    """Category mean without the row's own target."""
    y = F.col(target)
    others = F.col(known) - F.when(y.isNull(), F.lit(0)).otherwise(F.lit(1))
    return (F.col(total) - F.coalesce(y, F.lit(0))) / F.nullif(others, F.lit(0))


def _without_fold() -> Column:
    """Category mean without the row's fold (a fold without targets sums to nothing)."""
    others = F.col("__cnt") - F.col("__fnt")
    return (F.col("__cs") - F.coalesce("__fs", F.lit(0))) / F.nullif(others, F.lit(0))


def loo_encode(df: DataFrame, col: str, target: str, out: str | None = None,
               salt_by: list[str] | None = None) -> DataFrame:
    """Mean of the other rows' known targets, (sum_c - y) / (known_c - [y known]).

    mu when no other row of the category has a target; a null target counts
    for nothing.

    Category totals are pre-aggregated and joined back (a skew-safe lookup)
    instead of a window over the category, so no task ever holds a whole
    category.
    """
    out = out or f"{col}_loo"
    full = _target_stats(df, [col], target)
    mu = _global_mean(full)
    stats = full.select(col, F.col("s").alias("__s"), F.col("n").alias("__n"), F.col("nt").alias("__nt"))
    j = lookup(df, stats, col, count_col="__n", salt_by=salt_by)
    return j.withColumn(out, F.coalesce(_without_own(target, "__s", "__nt"), mu)).drop("__s", "__n", "__nt")


def kfold_encode(df: DataFrame, col: str, target: str, key: str, k: int = 5,
                 seed: int = 42, out: str | None = None) -> DataFrame:
    """Category mean over the other folds; fold = hash bucket of the row key.

    Category totals minus own-fold totals: two grouped aggregates and two
    skew-safe lookups; mu where the other folds hold no target of the category.
    """
    out = out or f"{col}_kfold"
    d = df.withColumn("__fold", hash_bucket(key, seed, k))
    cf_full = _target_stats(d, [col, "__fold"], target)
    # Category totals are the sum of the category x fold totals: one scan of
    # the rows feeds both tables.
    c_full = materialize(cf_full.groupBy(col).agg(F.sum("s").alias("s"), F.sum("n").alias("n"),
                                                  F.sum("nt").alias("nt")))
    mu = _global_mean(c_full)
    c = c_full.select(col, F.col("s").alias("__cs"), F.col("n").alias("__cn"), F.col("nt").alias("__cnt"))
    cf = cf_full.select(col, "__fold", F.col("s").alias("__fs"), F.col("n").alias("__fn"),
                        F.col("nt").alias("__fnt"))
    j = lookup(d, c, col, count_col="__cn", salt_by=[key])
    j = lookup(j, cf, [col, "__fold"], count_col="__fn", salt_by=[key])
    return (j.withColumn(out, F.coalesce(_without_fold(), mu))
            .drop("__cs", "__cn", "__cnt", "__fs", "__fn", "__fnt", "__fold"))


def time_encode(df: DataFrame, col: str, target: str, ts: str,
                out: str | None = None, salt_by: list[str] | None = None) -> DataFrame:
    """Mean target of the same category strictly before this row's time.

    Adds ``<out>`` (null when there is no earlier row) and ``<out>_n`` (the
    number of earlier rows). Rows are pre-aggregated per (category, time),
    running sums come from the two-level scan in ``operators.ordered`` (a hot
    category spans many tasks), and the result is joined back to the rows
    with a skew-safe lookup. The time column is used as it is (any orderable
    type), so the result does not depend on the session time zone; equal
    times never see each other.
    """
    out = out or f"{col}_past_mean"
    t = F.col(ts)
    g = (df.withColumn("__t", t).groupBy(col, "__t")
         .agg(F.sum(target).alias("__s"), _count().alias("__n")))
    past = exclusive_prefix(g, [col], "__t", ["__s", "__n"]).drop("__s")
    j = lookup(df.withColumn("__t", t), past, [col, "__t"], count_col="__n", salt_by=salt_by)
    return (j.withColumn(out, F.col("__s_before") / F.nullif(F.col("__n_before"), F.lit(0)))
            .withColumn(out + "_n", F.col("__n_before"))
            .drop("__t", "__n", "__s_before", "__n_before"))


ENCODING_SUFFIX = {"target": "_encoded", "loo": "_loo", "kfold": "_kfold", "frequency": "_freq"}


def encodings(df: DataFrame, col: str, target: str, kinds=("target", "loo", "frequency"),
              key: str | None = None, k: int = 5, seed: int = 42,
              smoothing: float = SMOOTHING, salt_by: list[str] | None = None) -> DataFrame:
    """Several in-sample encodings of one column (X4's input) from one fit.

    E2 (``target``), X1 (``loo``), X2 (``kfold``, needs ``key``) and E1
    (``frequency``) all derive from per-category sums and counts, and the
    k-fold one from the same per (category, fold) - so one grouped aggregate
    of the rows feeds all of them, and at most two skew-safe lookups bring
    the totals back (the separate encoders take one scan and one lookup
    each). Columns are named as the encoders name them; values follow the
    same formulas, with the same defaults.
    """
    unknown = set(kinds) - set(ENCODING_SUFFIX)
    if unknown:
        raise ValueError(f"unknown encodings {sorted(unknown)}")
    kfold = "kfold" in kinds
    if kfold and key is None:
        raise ValueError("k-fold encoding needs a row key")
    salt_by = salt_by or ([key] if key else None)
    d = df.withColumn("__fold", hash_bucket(key, seed, k)) if kfold else df
    if kfold:
        cf_full = _target_stats(d, [col, "__fold"], target)
        c_full = materialize(cf_full.groupBy(col).agg(
            F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("nt").alias("nt")))
    else:
        c_full = _target_stats(d, [col], target)
    mu = _global_mean(c_full)
    total = c_full.select(F.sum("n").cast("double")).scalar()
    c = c_full.select(col, F.col("s").alias("__cs"), F.col("n").alias("__cn"),
                      F.col("nt").alias("__cnt"))
    j = lookup(d, c, col, count_col="__cn", salt_by=salt_by)
    if kfold:
        cf = cf_full.select(col, "__fold", F.col("s").alias("__fs"), F.col("n").alias("__fn"),
                            F.col("nt").alias("__fnt"))
        j = lookup(j, cf, [col, "__fold"], count_col="__fn", salt_by=salt_by)
    cs, cn = F.col("__cs"), F.col("__cn")
    mean = cs / F.nullif(F.col("__cnt"), F.lit(0))
    exprs = {
        "target": (mean * cn + mu * F.lit(smoothing)) / (cn + F.lit(smoothing)),
        "loo": _without_own(target, "__cs", "__cnt"),
        "kfold": _without_fold() if kfold else None,
    }
    out = {}
    for kind in kinds:
        name = col + ENCODING_SUFFIX[kind]
        if kind == "frequency":
            out[name] = F.coalesce(cn / total, F.lit(1.0) / total)
        else:
            out[name] = F.coalesce(exprs[kind], mu)
    return (j.withColumns(out)
            .drop("__cs", "__cn", "__cnt", *(["__fs", "__fn", "__fnt", "__fold"] if kfold else [])))
