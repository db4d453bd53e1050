"""A stored index of objects: bucketed and sorted by id, so that a lookup moves only what is asked for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming.sink import shared_folder


class ObjectIndex:
    """One row for each object: its id and the least pack that holds it. ``buckets``: files' worth of rows of a bucket should fit a task."""

    def __init__(self, spark: SparkSession, table: str, buckets: int):
        self.spark, self.table, self.buckets = spark, table, buckets

    @classmethod
    def build(cls, packs: DataFrame, buckets: int | None = None) -> ObjectIndex:
        """The index over packs' objects (oid, pack). Objects of several packs are merged within each task before they are shuffled."""
        spark = packs.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"object_index_{uuid.uuid4().hex[:12]}"
        rows = packs.groupBy("oid").agg(F.min("pack").alias("pack"))
        # dealt as the buckets are, so each task writes one file
        rows.repartition(n, "oid").write.bucketBy(n, "oid").sortBy("oid").option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
        return cls(spark, table, n)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def lookup(self, asked: DataFrame, how: str = "left") -> DataFrame:
        """``asked`` (oid, ...) with ``pack``. The index is read where it lies: its side of the join has no exchange."""
        return asked.join(self.rows().hint("merge"), "oid", how)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
