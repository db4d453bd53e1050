"""Written steps in the folder that all executors share: they cut a plan's lineage and survive lost executors. And the shipping of
this package to the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming.sink import shared_folder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId in _shipped or not root.is_dir():
        return
    _shipped.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex[:12]}/{name}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._step = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    if path := getattr(df, "_step", None):
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def placed(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows dealt by ranges of (key, order) and sorted, with ``__part`` (the range) and ``__seq`` (their place in all
    rows), written, so that both stay what they are."""
    rows = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__seq", F.monotonically_increasing_id())
    return written(rows.withColumn("__part", F.shiftright("__seq", 33).cast("int")), "placed")
