"""Connected components by alternating stars (distributed union-find), DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): root is the least node reachable.

    Nodes without an edge do not appear. Self links, repeated links and null ends are
    ignored; no edges give no rows. Each round joins every node's neighbours to the least
    one (large star, then small star); links are rows of a written table, never collected.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = written(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(e)
        e = new
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    path = e._tessera_path
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())
    out._tessera_path = path
    return out
