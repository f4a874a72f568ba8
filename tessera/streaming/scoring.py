"""Fitted encoders applied to a stream.

The reference has no streaming; this only lets the encoders fitted in batch
(``operators.encode``) score rows as they arrive. Each encoder table is
static, so applying it is a stream-static left join (the stream side is
never buffered or stateful). The join is the batch path's skew-safe lookup:
a category holding a large share of the fitted rows is salted over several
shuffle partitions in every micro-batch. Unseen categories get the fit-time
default; it and the fitted row total are resolved once to literals because
streaming plans do not take scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import Encoding
from ..operators.joins import lookup


def freeze(enc: Encoding) -> Encoding:
    """Resolve the default (one scalar) and cache the fitted table."""
    default = enc.table.sparkSession.range(1).select(enc.default.alias("d")).first()["d"]
    table = enc.table.persist()
    return Encoding(enc.column, table, F.lit(default), enc.suffix)


def apply_stream(stream: DataFrame, encoders: list[Encoding], drop: bool = True,
                 salt_by: list[str] | None = None) -> DataFrame:
    """Add ``<col><suffix>`` for each frozen encoder to a streaming DataFrame.

    ``salt_by`` names the stream columns hashed into the salt of hot
    categories (a row key when there is one; all columns by default).
    """
    out = stream
    for enc in encoders:
        t = enc.table.select(enc.column, F.col("n").alias("__n"), F.col("value").alias("__v"))
        total = t.agg(F.sum("__n")).first()[0] or 0
        out = (lookup(out, t, enc.column, count_col="__n", salt_by=salt_by, total=total)
               .withColumn(enc.output, F.coalesce(F.col("__v"), enc.default))
               .drop("__n", "__v"))
        if drop:
            out = out.drop(enc.column)
    return out
