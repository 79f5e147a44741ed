"""SparkSession construction and the shared (cluster-visible) work folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  UTC makes timestamp_ntz <-> timestamp casts
# an identity, AQE re-plans joins/partition counts from runtime sizes and
# splits skewed shuffle partitions, ANSI turns silent overflow into errors.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpointed intermediates (operators.common.reuse) are removed once
    # their DataFrames are garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "storepulse", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's settings.

    On a cluster pass ``master=None`` and size ``shuffle_partitions`` to the
    data (roughly input bytes / 128 MB for the widest shuffle).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    ``spark.checkpoint.dir`` (or an already-set SparkContext checkpoint dir)
    is honoured as given.  There is no fallback: a folder of one machine
    would lose the data of the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    name = "-".join(parts) if parts else "work"
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
