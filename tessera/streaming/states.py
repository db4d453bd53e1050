"""Structured Streaming forms: file source, availableNow trigger, event time with watermarks, keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{directory}/{name}.parquet*")


def events(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """The events table as a stream; ts becomes a zoned timestamp, which watermarks need."""
    return table(spark, directory, "events", files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there, and return the rows of its sink as a table.

    The sink is Parquet in the folder all executors share; in update and complete mode each
    micro-batch is written apart, and the last one that wrote a row wins (column ``__batch``).
    """
    from tessera.streaming.sink import shared_folder

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.withColumn("__batch", F.lit(0)).schema).parquet(f"{base}/out")


def heartbeats(stream: DataFrame) -> DataFrame:
    """Newest beat of each worker (update mode)."""
    return stream.groupBy("user_id").agg(F.max("ts").alias("beat"), F.count("*").alias("beats"))


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts of one-hour windows in event time, closed by the watermark."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def idle_sessions(stream: DataFrame, idle: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, began, evicted, n): runs of uses with gaps below ``idle``, told when the watermark has passed their end (append mode).
    Times are microseconds."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", idle).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_micros("w.start").alias("began"), F.unix_micros("w.end").alias("evicted"), "n")


def lifecycle(stream: DataFrame) -> DataFrame:
    """Each key's last state, kept in keyed state: (user_id, state, changes)."""

    def step(key, batches: Iterator[pd.DataFrame], state):
        last, at, n = state.get if state.exists else ("", -1, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for i, kind in zip(rows["event_id"], rows["event_type"]):
            n += kind != last
            if i > at:
                last, at = kind, int(i)
        state.update((last, at, int(n)))
        yield pd.DataFrame({"user_id": [key[0]], "state": [last], "changes": [int(n)]})

    rows = stream.select("user_id", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, state string, changes bigint", "last string, at bigint, n bigint", "update", "NoTimeout")


def triggers(stream: DataFrame, tracked: DataFrame) -> DataFrame:
    """Webhook events of tracked keys: a stream joined with a table."""
    return stream.join(tracked, "user_id", "left_semi").where("event_type = 'purchase'").select("event_id", "user_id")


def publish(stream: DataFrame) -> DataFrame:
    """Two-phase publication: (key, phase, __batch) of what was published, in the order a reader may see it.

    Each micro-batch first publishes the shallow form of its ready keys (phase 1) and only after that write has
    succeeded the full form (phase 2), so no key is ever served in full before its shallow form could be. A repeated
    micro-batch writes its own folder anew.
    """
    from tessera.streaming.sink import shared_folder

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/publish-{uuid.uuid4().hex[:12]}"

    def put(batch: DataFrame, number: int) -> None:
        for phase, kinds in ((1, ("click", "purchase", "signup")), (2, ("purchase", "signup"))):
            some = batch.where(F.col("event_type").isin(*kinds)).select(F.col("user_id").alias("key"), F.lit(phase).alias("phase")).distinct()
            some.write.mode("overwrite").parquet(f"{base}/out/__batch={number}/part={phase}")

    q = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema("key bigint, phase int, __batch int, part int").option("basePath", f"{base}/out").parquet(f"{base}/out")
