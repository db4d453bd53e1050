"""Where streams put their output and checkpoints, and long plans their written steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the application's checkpoint folder. Where neither is set, a local master gets a
    temporary folder, and any other master an error: its executors could not read the driver's disk."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        root = sc.getCheckpointDir()
    return root
