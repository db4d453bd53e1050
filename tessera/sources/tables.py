"""Base tables, and the views that bind the engine's concepts to them.

Every view is written twice: as a DataFrame here, and as SQL for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: View name to SQL, in order of dependence.
VIEW_SQL: dict[str, str] = {
    "files_now": "SELECT doc_id, source, lang, CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END AS content FROM documents",
    "snap_old": "SELECT doc_id, text AS content FROM documents WHERE doc_id % 10 <> 3",
    "snap_new": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || '#v2' ELSE text END AS content FROM documents WHERE doc_id % 10 <> 7",
    "live_refs": "SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'",
    "chunk_refs": "SELECT l_orderkey AS manifest, l_partkey AS hash, CAST(p_size AS BIGINT) AS len FROM lineitem JOIN part ON l_partkey = p_partkey",
    "objects": "SELECT p_partkey AS hash, CAST(p_size AS BIGINT) AS size FROM part",
    "reachable": "SELECT DISTINCT hash FROM chunk_refs JOIN live_refs ON manifest = o_orderkey",
    "jobs": "SELECT event_id AS id, user_id AS key, event_type AS kind, CAST(floor(value) AS BIGINT) AS size, ts FROM events",
    "commits": "SELECT conv_id, turn, text FROM conversations",
}


class Tables:
    """Attribute access to the tables and views of a directory. Reads are lazy and pruned by Catalyst."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @property
    def files_now(self) -> DataFrame:
        empty = F.when(F.col("doc_id") % 50 == 0, F.lit("")).otherwise(F.col("text"))
        return self.documents.select("doc_id", "source", "lang", empty.alias("content"))

    @property
    def snap_old(self) -> DataFrame:
        return self.documents.where("doc_id % 10 <> 3").select("doc_id", F.col("text").alias("content"))

    @property
    def snap_new(self) -> DataFrame:
        new = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("#v2"))).otherwise(F.col("text"))
        return self.documents.where("doc_id % 10 <> 7").select("doc_id", new.alias("content"))

    @property
    def live_refs(self) -> DataFrame:
        return self.orders.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")

    @property
    def chunk_refs(self) -> DataFrame:
        size = self.part.select(F.col("p_partkey").alias("hash"), F.col("p_size").cast("long").alias("len"))
        return self.lineitem.select(F.col("l_orderkey").alias("manifest"), F.col("l_partkey").alias("hash")).join(size, "hash")

    @property
    def objects(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("hash"), F.col("p_size").cast("long").alias("size"))

    @property
    def reachable(self) -> DataFrame:
        live = self.live_refs.select(F.col("o_orderkey").alias("manifest"))
        return self.lineitem.select(F.col("l_orderkey").alias("manifest"), F.col("l_partkey").alias("hash")).join(live, "manifest").select("hash").distinct()

    @property
    def jobs(self) -> DataFrame:
        return self.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("size"), "ts")

    @property
    def commits(self) -> DataFrame:
        return self.conversations.select("conv_id", "turn", "text")


def with_views(sql: str) -> str:
    """The SQL with the views it names (and those that these name) as common table expressions."""
    body, wanted = sql.strip(), []
    text = body
    for name in reversed(VIEW_SQL):
        if re.search(rf"\b{name}\b", text):
            wanted.insert(0, name)
            text += " " + VIEW_SQL[name]
    if not wanted:
        return body
    views = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in wanted)
    if m := re.match(r"WITH(\s+RECURSIVE)?\s", body, re.I):
        return f"WITH{m[1] or ''} {views}, {body[m.end():]}"
    return f"WITH {views} {body}"
