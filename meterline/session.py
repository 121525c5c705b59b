"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "meterline", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC, ANSI, adaptive session. ``conf`` overrides any default below."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.filterPushdown": "true",
        # call-site capture costs the driver several calls per expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # state of the minute and leaderboard streams stays off the JVM heap
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder path that every executor can reach.

    It lies under the folder the cluster names in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own, since there driver and executors are one machine.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="meterline-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
