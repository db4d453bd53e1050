"""Chunks by their SHA-256 as a partitioned table, written and read by Spark's own formats.

Rows are (hash, size, content) under a folder for each first byte of the hash, sorted by hash, with a Bloom filter on it. So any
file system that Spark knows will do, a failed or repeated write leaves nothing that readers see (rows appear when the
job commits), and a lookup by hash reaches the scan: its folder by the prefix, its row groups by the filter. Chunks are
never changed. Two writers may add the same chunk at once; rows of one hash are equal, and readers take one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "hash string, size bigint, content binary, prefix string"


def _prefix(h: Column) -> Column:
    return F.substring(h, 1, 2)


class ChunkTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def rows(self) -> DataFrame:
        """All rows: hash, size, content, prefix."""
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def put(self, df: DataFrame, content: str) -> None:
        """Add each distinct content that is not there. Contents meet the stored hashes, never stored contents; a null is no chunk."""
        data = F.col(content).cast("binary")
        new = df.where(F.col(content).isNotNull()).select(F.sha2(data, 256).alias("hash"), F.octet_length(data).cast("long").alias("size"), data.alias("content"))
        new = new.dropDuplicates(["hash"]).withColumn("prefix", _prefix(F.col("hash")))
        if self._exists():
            new = new.join(self.rows().select("prefix", "hash"), ["prefix", "hash"], "left_anti")
        out = new.select("hash", "size", "content", "prefix").repartition("prefix").sortWithinPartitions("prefix", "hash")
        out.write.mode("append").partitionBy("prefix").option("parquet.bloom.filter.enabled#hash", "true").parquet(self.path)

    def get(self, *hashes: str) -> DataFrame:
        """(hash, size, content) of the given hashes; only their folders are opened."""
        found = self.rows().where(F.col("prefix").isin(sorted({h[:2] for h in hashes})) & F.col("hash").isin(*hashes))
        return found.select("hash", "size", "content").dropDuplicates(["hash"])

    def ranges(self, wanted: DataFrame, chunk: str, at: str, n: str) -> DataFrame:
        """``wanted`` with ``part``: n bytes of the chunk from byte ``at``. A missing chunk or a range that goes beyond it is an
        error, as is a range of nothing at its end."""
        own = self.rows().dropDuplicates(["hash"]).select(F.col("hash").alias("__h"), F.col("prefix").alias("__p"), "size", "content")
        both = wanted.join(own, (_prefix(F.col(chunk)) == F.col("__p")) & (F.col(chunk) == F.col("__h")), "left")
        bad = F.col("size").isNull() | (F.col(at) >= F.col("size")) | (F.col(n) > F.col("size") - F.col(at))
        part = F.when(bad, F.raise_error(F.concat(F.lit("no such range of chunk "), chunk)).cast("binary"))
        part = part.otherwise(F.substring("content", (F.col(at) + 1).cast("int"), F.col(n).cast("int")))
        return both.select(*[F.col(f"`{c}`") for c in wanted.columns], part.alias("part"))

    def corrupt(self) -> DataFrame:
        """(hash, size) of the chunks whose content or size does not match."""
        ok = (F.sha2("content", 256) == F.col("hash")) & (F.octet_length("content") == F.col("size")) & (_prefix(F.col("hash")) == F.col("prefix"))
        return self.rows().where(~F.coalesce(ok, F.lit(False))).select("hash", "size")
