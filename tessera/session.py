"""Session construction and lineage cuts.

ANSI mode stays on (the Spark 4 default): every cast of dirty input goes
through ``try_cast`` instead of switching ANSI off. AQE is on so shuffle
partition counts are coalesced at runtime and skewed join partitions are
split; explicit broadcasts are used only where a size bound is proven.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Partition sizing: scan splits, AQE's target reducer size, the size above
# which AQE splits a skewed join partition, and a cap on the initial shuffle
# width (map statuses on the driver grow with maps x reducers).
SCAN_SPLIT_BYTES = 512 << 20
ADVISORY_BYTES = 256 << 20
SKEW_PARTITION_BYTES = 1 << 30
SHUFFLE_BYTES_PER_PARTITION = 1 << 30
MAX_SHUFFLE_PARTITIONS = 100_000


def scale_conf(input_bytes: int, cores: int,
               max_partitions: int = MAX_SHUFFLE_PARTITIONS) -> dict[str, str]:
    """Partition settings for reading ``input_bytes`` on ``cores`` task slots.

    Scans split at 512 MB. The initial shuffle width is one partition per GB
    of input (at least two per core, at most ``max_partitions``, because map
    statuses on the driver grow with maps x reducers; beyond it the initial
    partitions grow past 1 GB and spill, nothing is dropped): the widest shuffles
    here carry projected columns after map-side partial aggregation, well
    under the input size, and AQE coalesces every shuffle toward 256 MB
    reducers and splits join partitions over 1 GB. The salted lookup sizes
    its salts from this width, so a hot key spreads over the cluster. For
    100 TB on 8,000 cores: 204,800 scan tasks, 100,000 shuffle partitions.
    """
    width = -(-input_bytes // SHUFFLE_BYTES_PER_PARTITION)
    partitions = max(2 * cores, min(max_partitions, width))
    return {
        "spark.sql.files.maxPartitionBytes": str(SCAN_SPLIT_BYTES),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(ADVISORY_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(SKEW_PARTITION_BYTES),
    }


def get_session(master: str | None = None, app: str = "tessera",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None,
                input_bytes: int | None = None, cores: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster ``master`` is left to ``spark-submit``; tests pass
    ``local[N]``. With ``input_bytes`` and ``cores`` the partition settings
    come from ``scale_conf``; an explicit ``shuffle_partitions`` wins.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if input_bytes is not None and cores is not None:
        conf.update(scale_conf(input_bytes, cores))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only in local mode.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that is
    read from the session and used as is. Only a local session (tests,
    bench) with no folder configured gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster run needs a shared "
            "checkpoint folder")
    path = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a Parquet table in the shared checkpoint folder.

    For tables that grow with the data: rows are written once, compressed, without being
    cached first; later reads prune columns and push filters down, and the planner
    knows the size. Such tables stay until the folder is cleared. Rows come back
    in any order and every column as nullable.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder (order and partitions stay).

    Used before work that reads the same table many times (model fits,
    two-pass prefix sums) so a lost executor re-reads checkpoint files
    instead of recomputing the whole upstream plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # Writing a reliable checkpoint runs the plan a second time unless it is
    # persisted; keep it cached only for the duration of the write.
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return src.checkpoint(eager=True)
    finally:
        src.unpersist(blocking=False)


def cached(df: DataFrame) -> DataFrame:
    """Persist spill-able, caller unpersists in ``finally``."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
