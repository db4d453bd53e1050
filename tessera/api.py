"""Operators over a caller's own DataFrames.

Nothing here knows the test tables: every function takes DataFrames (and the names of their columns) and returns one.
The stores that a deployment brings are described by the protocols below; anything with these methods will do.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as f


class ObjectStore(Protocol):
    def objects(self) -> DataFrame:
        """(hash, size) of all stored objects."""


class RefStore(Protocol):
    def references(self) -> DataFrame:
        """(ref, hash): what each live reference names, through manifests or at once."""


class JobQueue(Protocol):
    def jobs(self) -> DataFrame:
        """(id, key, status, class, created_at)."""


class Frames:
    """The stores above over given DataFrames."""

    def __init__(self, objects: DataFrame | None = None, references: DataFrame | None = None, jobs: DataFrame | None = None):
        self._objects, self._references, self._jobs = objects, references, jobs

    def objects(self) -> DataFrame:
        return self._objects

    def references(self) -> DataFrame:
        return self._references

    def jobs(self) -> DataFrame:
        return self._jobs


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, deleted, same or modified. Contents are compared null-safely; a key stands once in each snapshot."""
    side = lambda df, c: df.select(key, F.struct(content).alias(c))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("modified")
    return side(old, "o").join(side(new, "n"), key, "full_outer").select(key, change.alias("change"))


def sync_plan(old: DataFrame, new: DataFrame, known: DataFrame, key: str, content: str) -> DataFrame:
    """(hash, size): the contents to upload for a new snapshot: of its added and modified files, each content once, without
    the hashes in known (hash) and without empty ones."""
    changed = snapshot_diff(old, new, key, content).where("change IN ('added', 'modified')").select(key)
    rows = new.join(changed, key, "left_semi").where(F.octet_length(content) > 0)
    each = rows.groupBy(f.content_hash(content).alias("hash")).agg(F.max(f.byte_length(content)).alias("size"))
    return each.join(known.select("hash"), "hash", "left_anti")


def garbage(store: ObjectStore, refs: RefStore, ledger: DataFrame, now: int, grace: int) -> DataFrame:
    """(hash, size, first_seen, fate) of objects that no reference names: kept until ``grace`` after they were first seen
    so (ledger: hash, first_seen; those not in it are seen now), then delete."""
    orphans = store.objects().join(refs.references().select("hash"), "hash", "left_anti")
    seen = F.coalesce("first_seen", F.lit(now).cast("long"))
    rows = orphans.join(ledger.select("hash", "first_seen"), "hash", "left").select("hash", "size", seen.alias("first_seen"))
    return rows.withColumn("fate", F.when(F.col("first_seen") + grace <= now, "delete").otherwise("keep"))


def next_jobs(queue: JobQueue, workers: DataFrame) -> DataFrame:
    """(worker, id): of each worker (worker, ceiling or null) the oldest queued job whose class it may take. Jobs are
    reduced to the oldest of each class first, so only classes meet workers."""
    oldest = queue.jobs().where("status = 'queued'").groupBy("class").agg(F.min(F.struct("created_at", "id")).alias("j"))
    able: Column = F.col("ceiling").isNull() | (F.col("class") <= F.col("ceiling"))
    return workers.join(F.broadcast(oldest), able).groupBy("worker").agg(F.min("j").alias("j")).select("worker", "j.id")  # a row for each class


def unique_bytes(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, unique_bytes): bytes of each key, equal contents counted once."""
    one = rows.groupBy(key, f.content_hash(content).alias("hash")).agg(F.max(f.byte_length(content)).alias("n"))
    return one.groupBy(key).agg(F.sum("n").alias("unique_bytes"))
