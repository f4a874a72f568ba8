"""Helpers shared by the operators: stored intermediate tables, ASCII folding, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: The ASCII white space that separates words in several contracts.
SPACES = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()``, but later reads prune columns and the
    planner knows the table's true size, so its broadcast decision is a size
    check. A lost executor re-reads the shared files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], wish: str) -> str:
    """``wish`` behind as many underscores as it takes to be no column's name, case aside."""
    lower = {c.lower() for c in taken}
    while wish.lower() in lower:
        wish = f"_{wish}"
    return wish


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def split_words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v longs): root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). A
    node's smallest neighbour is a partial aggregate joined back to its edges,
    so a hub's edges are never gathered in one task. Each round's edges are
    written to the shared folder; the driver sees two numbers per round, the
    count of edges and an order-free checksum, and stops when both stand still.
    """
    e = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
               .filter("u < v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        large = (both.join(least, F.col("u") == F.col("n")).filter("v > u")
                 .select(F.least("m", "u").alias("u"), "v").filter("u < v").distinct())
        up = large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
        small = large.join(up, F.col("v") == F.col("n"))
        e = stored(small.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
                   .filter("u < v").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return stored(roots.union(e.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct(), "roots")
