"""Session defaults of the engine."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def place(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share, below the session's checkpoint folder; a temporary one where none is set and all runs in one process."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="loomstone-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def findable(spark: SparkSession) -> None:
    """Lets local Python workers import this package where the driver found it only by its own path."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH", ""))))


def collected(spark: SparkSession) -> None:
    """Asks the driver's collector to look before a step.

    Spark drops shuffle and checkpoint files (these where
    spark.cleaner.referenceTracking.cleanCheckpoints is set) when the collector finds that
    nothing refers to them; those of the steps before would else add up on the disks, as
    would the garbage of many plans in the driver's heap.
    """
    gc.collect()  # what Python holds in cycles
    spark.sparkContext._jvm.System.gc()
