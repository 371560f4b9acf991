"""Shared scratch folder of the cluster."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by the session; only where none is named and the master is local, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path for a written table under the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are over.

    It does so when the driver's garbage is collected, which a driver with little to do leaves to a timer of 30 minutes.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
