"""Session settings the library is written for.  Cluster size and shuffle
width stay with the cluster; nothing here pins a master."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    # without it every Column call records its call site, which costs more than planning the query
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "quoteflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_folders: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local session, where driver and executors are one machine, may fall
    back to a temporary folder of its own, which goes away with the process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if not _own_folders:
        _own_folders.append(tempfile.TemporaryDirectory(prefix="quoteflow-", ignore_cleanup_errors=True))
    return _own_folders[0].name
