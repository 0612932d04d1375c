"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime-settable options. Adaptive execution is what sizes shuffles, splits hot
# join keys and turns a join into a broadcast once the measured side is small.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where what follows the join could use its partitions and is then shuffled again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

# State lives in RocksDB so that it is bounded by local disk, not by the heap.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # No look-up before every write only to count the rows of the state.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def configure(spark: SparkSession, streaming: bool = False) -> SparkSession:
    """Apply the settings above to a running session."""
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    # A listing task takes many folders of a partitioned table instead of one each.
    listers = max(32, 2 * spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(listers))
    if streaming:
        for name, value in STREAM_SETTINGS.items():
            spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    A local temporary folder is used only when the setting is absent and the
    session runs in one process, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tradewake-")
    return f"{root.rstrip('/')}/tradewake-{uuid.uuid4().hex}"
