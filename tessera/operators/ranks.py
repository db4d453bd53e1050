"""Exact order statistics of groups by histograms: a wanted rank is narrowed to one bucket, round after round.

Each round counts a group's values between two bounds in equal buckets, finds the bucket that holds the rank, and takes that
bucket's least and greatest value as the next bounds, until they are equal. Counting combines within each task before its shuffle,
so a group's values are never brought together: a group costs at most ``BUCKETS`` rows a round, and each round divides the range
that is left. Bounds are values that occur and buckets follow the order of values, so nothing is approximate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .steps import discard, written

BUCKETS = 1024


def select_ranks(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, rank, value) for each wanted (key, rank, lo, hi), rank counted from 0 among the key's values (key, v: double)
    in order, lo and hi being the key's least and greatest value. NaN and null are no values."""
    rounds = [written(wanted.select("key", "rank", F.col("rank").alias("left"), "lo", "hi"), "ranks")]
    while not (open_ := rounds[-1].where("lo < hi")).isEmpty():
        near = values.join(open_, "key").where("v >= lo AND v <= hi")
        span = F.col("hi") / 2 - F.col("lo") / 2  # halves, so that it does not overflow
        at = F.when(span > 0, F.least(F.floor(F.try_divide(F.col("v") / 2 - F.col("lo") / 2, span) * BUCKETS), F.lit(BUCKETS - 1)))
        at = at.otherwise(F.when(F.col("v") > F.col("lo"), BUCKETS - 1).otherwise(0))
        counts = near.groupBy("key", "rank", "left", at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        w = Window.partitionBy("key", "rank").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows
        inside = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where("left >= before AND left < before + n")
        new = written(rounds[-1].where("lo = hi").unionByName(inside.select("key", "rank", (F.col("left") - F.col("before")).alias("left"), "lo", "hi")), "ranks")
        discard(rounds.pop())
        rounds.append(new)
    return rounds[-1].select("key", "rank", F.col("lo").alias("value"))


def quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, one column for each share): exact quantiles, interpolated between the two neighbouring ranks. Groups without a value
    are left out."""
    values = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    of = written(values.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    at = {name: (F.col("n") - 1) * share for name, share in shares.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at.values()])))
    found = select_ranks(values, of.select("key", "lo", "hi", F.explode(ranks).alias("rank")))
    by = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m"))  # two for each share
    low, high = (lambda x: F.element_at("m", F.floor(x))), (lambda x: F.element_at("m", F.ceil(x)))
    cols = [(low(x) + (high(x) - low(x)) * (x - F.floor(x))).alias(name) for name, x in at.items()]
    return of.join(by, "key").select(F.col("key").alias(key), *cols)
