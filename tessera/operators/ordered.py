"""Distributed running sums over an ordered key.

A window ordered over a whole group runs that group in one task, which breaks
when one group holds a large share of the rows. The helper here is the textbook
two-level scan instead:

1. pre-aggregate to one row per (group, order value) - repeated values, the
   usual source of skew, collapse to one row with a count;
2. range-partition those rows on (group, order value); sampling balances
   the partitions even when a single group spans most of the data;
3. store them with the partition id (so both passes below see the
   same blocks), take running sums inside each (partition, group) block;
4. add, per block, the totals of the earlier blocks of the same group
   (a window over at most one row per block and group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .quantiles import exact_quantiles  # noqa: F401  (its earlier place)


def exclusive_prefix(rows: DataFrame, group: list[str], order: str,
                     sums: list[str], partitions: int | None = None,
                     totals: bool = False, previous: bool = False) -> DataFrame:
    """Add ``<s>_before`` = sum of ``s`` over earlier rows of the same group.

    ``rows`` must hold one row per (group, order) value (pre-aggregated).
    Output keeps all input columns. With ``totals``, ``<s>_total`` (the sum
    over the whole group) is added too, from the per-block totals, so no
    join keyed on the group alone is needed (a hot group would make it one
    task). With ``previous``, ``<order>_previous`` is the order value before (null for
    a group's first).
    """
    ordering = [F.col(g).asc_nulls_first() for g in group] + [F.col(order).asc()]
    # Without an explicit count AQE may merge adjacent ranges; merged blocks
    # are still contiguous in (group, order), which is all the scan needs.
    ranged = (rows.repartitionByRange(partitions, *ordering) if partitions
              else rows.repartitionByRange(*ordering))
    blocks = stored(ranged.withColumn("__pid", F.spark_partition_id()), "ordered-blocks")
    keys = ["__pid", *group]
    # Block totals: at most one row per (partition, group), so the windows
    # over them below are small even when one group spans every partition.
    w_in = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.select(*rows.columns, "__pid",
                          *[F.sum(s).over(w_in).alias(f"__in_{s}") for s in sums],
                          *([F.max(order).over(w_in).alias("__in_last")] if previous else []))
    block_totals = blocks.groupBy(*keys).agg(*[F.sum(s).alias(f"__bt_{s}") for s in sums],
                                             F.max(order).alias("__bt_last"))
    w_off = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("__pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*group) if group else Window.partitionBy()
    offsets = block_totals.select(
        *keys, *[F.sum(f"__bt_{s}").over(w_off).alias(f"__off_{s}") for s in sums],
        *([F.sum(f"__bt_{s}").over(w_all).alias(f"__tot_{s}") for s in sums] if totals else []),
        *([F.max("__bt_last").over(w_off).alias("__off_last")] if previous else []))
    # Null-safe on the group so a null category keeps its rows. Without a
    # group the offsets table has at most one row per partition: broadcast.
    okeys = {k: f"__ok_{i}" for i, k in enumerate(keys)}
    off = offsets.withColumnsRenamed(okeys)
    off = off if group else F.broadcast(off)
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(okeys[k]))
        cond = e if cond is None else cond & e
    joined = inner.join(off, cond, "inner")
    return joined.select(
        *rows.columns,
        *[(F.coalesce(F.col(f"__in_{s}"), F.lit(0)) + F.coalesce(F.col(f"__off_{s}"), F.lit(0)))
          .alias(f"{s}_before") for s in sums],
        *([F.col(f"__tot_{s}").alias(f"{s}_total") for s in sums] if totals else []),
        *([F.coalesce("__in_last", "__off_last").alias(f"{order}_previous")] if previous else []))
