"""Measure how a hot key is spread over tasks by the salted lookup.

Runs a fact table where one key holds a third of the rows through
(a) a plain shuffle join to its encoder table, (b) ``joins.lookup`` with
hot-key salting, (c) a running mean over ``Window.partitionBy(key)`` and
(d) ``encode.time_encode`` (two-level prefix scan) and (e) a box plot per
key (exact quartiles, fences joined back by the salted lookup), with AQE's skew-join
rule switched off to isolate the effect. Per-task shuffle records come from Spark's event log, written to a
fresh scratch folder. Prints one JSON line per variant: the largest task's
share of the rows in the join stage.

    python tools/skew_check.py [rows]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def stage_task_records(log_dir: str) -> dict[int, list[int]]:
    per_stage: dict[int, list[int]] = defaultdict(list)
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or "appstatus" in os.path.basename(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = ev.get("Task Metrics") or {}
                rec = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                per_stage[ev["Stage ID"]].append(rec)
    return per_stage


def main(rows: int) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from pyspark.sql import Window

    from tessera.operators import encode, joins, profile
    from tessera.session import DEFAULT_CONF, ensure_checkpoint_dir

    scratch = tempfile.mkdtemp(prefix="skew-check-", dir="/tmp")
    results = {}
    for variant in ("plain", "salted", "window", "prefix", "boxplot"):
        log_dir = os.path.join(scratch, variant)
        os.makedirs(log_dir)
        b = SparkSession.builder.master("local[8]").appName(f"skew-{variant}")
        for k, v in DEFAULT_CONF.items():
            b = b.config(k, v)
        spark = (b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
                 .config("spark.eventLog.compress", "false")
                 .config("spark.sql.shuffle.partitions", "32")
                 .config("spark.sql.adaptive.skewJoin.enabled", "false")
                 .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
                 .config("spark.sql.autoBroadcastJoinThreshold", "-1")
                 .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
                 .getOrCreate())
        ensure_checkpoint_dir(spark)
        facts = spark.range(rows).select(
            "id", F.when(F.col("id") % 3 == 0, F.lit("hot"))
            .otherwise(F.concat(F.lit("k"), (F.col("id") % 50000).cast("string"))).alias("c"),
            (F.col("id") % 97).cast("double").alias("y"))
        table = facts.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"))
        timed = facts.withColumn("ts", F.timestamp_seconds(F.col("id") * 7 % 1_000_003))
        if variant == "plain":
            out = joins.lookup(facts, table, "c")
        elif variant == "salted":
            out = joins.lookup(facts, table, "c", count_col="n", salt_by=["id"])
        elif variant == "window":
            w = Window.partitionBy("c").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
            out = timed.withColumn("past", F.avg("y").over(w))
        elif variant == "prefix":
            out = encode.time_encode(timed, "c", "y", "ts", salt_by=["id"])
        else:
            out = profile.boxplot(facts, "y", group="c")
        out.write.format("noop").mode("overwrite").save()
        spark.stop()
        per_stage = stage_task_records(log_dir)
        # worst stage among those that shuffle at least half the rows
        big = [recs for recs in per_stage.values() if sum(recs) >= rows // 2]
        recs = max(big, key=lambda r: max(r) / sum(r))
        total = sum(recs)
        results[variant] = {"variant": variant, "rows": rows, "stage_tasks": len(recs),
                            "max_task_records": max(recs), "stage_records": total,
                            "max_task_share": round(max(recs) / total, 4)}
        print(json.dumps(results[variant]))


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000)
