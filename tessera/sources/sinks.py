"""Result sinks and partition spreading.

Reports are DataFrames; sinks write them as files in the caller's folder.
Nothing is formatted as text and nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str) -> None:
    """The leaderboard is a handful of rows; one JSON file is enough."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Worst-prediction listings (or any prediction table) as parquet."""
    df.write.mode("overwrite").parquet(path)


def land_parquet(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """S2 follow-up: land an unsplittable text read as splittable Parquet once."""
    (spread(df, partitions) if partitions else df).write.mode("overwrite").parquet(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin repartition, sized to the cluster by default.

    Only worth it after an unsplittable read (multi-line CSV); elsewhere
    AQE sizes partitions from runtime statistics.
    """
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n)


#: Session setting that names the width text-heavy queries are spread to.
SPREAD_CONF = "spark.tessera.spreadPartitions"


def spread_if_asked(df: DataFrame) -> DataFrame:
    """S8 before heavy per-row work on a table stored as a few large row groups.

    Only where the session sets ``SPREAD_CONF``: then rows are dealt
    round-robin over that many partitions. A table with many splits needs no
    shuffle, so by default there is none. Never changes the rows.
    """
    n = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(n)) if n else df
