"""Session defaults and the shared scratch folder.

Scratch data (partitioned copies, snapshots written by the checks, lineage cuts) always
goes below the folder the cluster names in ``spark.checkpoint.dir``.  Only when that is
unset -- a bare local session, as in tests -- do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Conservative defaults; a cluster deployment overrides the partition counts.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # (dynamic partition overwrite is set on the one write that needs it, the hour table,
    # not session-wide: a session default would change every partitioned overwrite)
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "hitfeed", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the executor; a cluster sizes this at deploy time
        conf["spark.driver.memory"] = "16g"
        # listing thousands of hour directories: one listing task per directory (the
        # default, right for a cluster) costs more than the listing itself on 8 threads
        conf["spark.sql.sources.parallelPartitionDiscovery.parallelism"] = "64"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_root(spark)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch output: ``spark.checkpoint.dir`` when the cluster sets it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if root:
            # getCheckpointDir appends a per-application UUID; use its parent
            root = root.rstrip("/").rsplit("/", 1)[0]
    if not root:
        # unset: a bare local session (tests).  On a cluster a driver-local folder would lose data.
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="hitfeed-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(root)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared scratch folder."""
    return f"{scratch_root(spark)}/hitfeed-{name}-{uuid.uuid4().hex[:12]}"
