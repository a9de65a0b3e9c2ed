"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "sonolog", cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever used under a ``local`` master, where driver and
    executors are one process; on a cluster without the setting this raises.
    """
    context = spark.sparkContext
    configured = (
        spark.conf.get(CHECKPOINT_CONF, None)
        or context.getConf().get(CHECKPOINT_CONF)
        or context.getCheckpointDir()
    )
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="sonolog-")
    context.setCheckpointDir(root)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one run's intermediate table."""
    return os.path.join(shared_dir(spark), "sonolog", f"{name}-{uuid.uuid4().hex}")
