"""The training-data pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontamination, quality_rules, simhash, suffix_dedup
from tessera.llm.common import stored

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash", simhash.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("decontamination", decontamination.stage),
    ("bpe", bpe.stage),
]

#: Several stages (quantile sketches, fingerprints, suffix order, merges) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each one's rows are stored before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    name, last = STAGES[-1]
    return last(spark, docs, sf_dir)
