"""Null / empty predicates that are safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing(df: DataFrame, name: str) -> Column:
    """P5: null, or empty string for string columns only.

    Comparing a numeric column with ``''`` raises under ANSI (D2), so the
    empty-string test is applied only where the column is text.
    """
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return c.isNull() | (c == F.lit(""))
    return c.isNull()


def null_unless(cond: Column, value: Column) -> Column:
    """``value`` where ``cond`` holds, else null."""
    return F.when(cond, value)
