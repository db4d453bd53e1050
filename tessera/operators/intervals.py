"""Joins of intervals by buckets, prefix sums, islands and tiling."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .steps import placed

#: Bounds that one step of the search for a range passes over.
_STEP = 64


def exclusive_sum(size: str, order: str, key: str | None = None, parts: int = 0) -> Column:
    """Bytes before each row, in order (per key)."""
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(order)
    return F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def range_parts(df: DataFrame, order: str) -> Column:
    """The number of the range of ``order`` that a row lies in, as an expression over fixed bounds.

    The bounds are found once, by one job over the order column, and become a constant of the plan: one value for
    each shuffle partition. A column made of spark_partition_id() would not do, because every use of a
    range exchange samples bounds of its own. Equal values share a range; nulls are in range 0.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[order].dataType.simpleString()
    ranged = df.select(F.col(order).alias("b")).where("b IS NOT NULL").repartitionByRange(n, "b").withColumn("p", F.spark_partition_id())
    low = ranged.groupBy("p").agg(F.min("b").alias("b")).agg(F.to_json(F.sort_array(F.collect_set("b")))).first()[0]
    bounds = lambda step: F.from_json(F.lit(json.dumps(json.loads(low)[::step])), f"array<{kind}>")
    below = lambda a: F.coalesce(F.size(F.filter(a, lambda x: x <= F.col(order))), F.lit(0))
    # every STEP-th bound first, then those between
    coarse = F.greatest(below(bounds(_STEP)), F.lit(1)) - 1
    return (coarse * _STEP + below(F.slice(bounds(1), coarse * _STEP + 1, _STEP))).cast("int")


def global_exclusive_sum(df: DataFrame, order: str, size: str | list[str], out: str | list[str] = "start") -> DataFrame:
    """Add the bytes before each row over the whole table, without one task that sees it all.

    Rows are dealt by fixed ranges of ``order``; each range's total is summed, the few totals are
    accumulated, and each range adds its own running sum to its base. Several sizes share the work.
    """
    sizes, outs = ([x] if isinstance(x, str) else x for x in (size, out))
    rows = df.withColumn("__p", range_parts(df, order))
    totals = rows.groupBy("__p").agg(*[F.sum(s).alias(f"__t{k}") for k, s in enumerate(sizes)])
    base = totals.select("__p", *[exclusive_sum(f"__t{k}", "__p").alias(f"__b{k}") for k in range(len(sizes))])  # a row per range
    w = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"__s{k}": F.coalesce(F.sum(s).over(w), F.lit(0)) for k, s in enumerate(sizes)})
    joined = own.join(F.broadcast(base), "__p")
    return joined.select(*df.columns, *[(F.col(f"__s{k}") + F.col(f"__b{k}")).cast("long").alias(o) for k, o in enumerate(outs)])


def positions(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Add each row's place (from 1) among its key's rows. Rows are dealt by ranges of (key, order), whatever the keys' sizes; order is
    unique within a key."""
    rows = placed(df, key, order)
    first = rows.groupBy("__part").agg(F.min("__seq").alias("s"), F.count("*").alias("n"))
    base = first.select("__part", "s", exclusive_sum("n", "__part").alias("base"))  # a row for each range
    at = rows.join(F.broadcast(base), "__part").withColumn("__at", F.col("base") + F.col("__seq") - F.col("s"))
    begin = at.groupBy(key).agg(F.min("__at").alias("__begin"))
    own = F.col(f"__k.{key}").eqNullSafe(F.col(f"__b.{key}"))
    return at.alias("__k").join(begin.alias("__b"), own).select(*[F.col(f"__k.{c}") for c in df.columns], (F.col("__at") - F.col("__begin") + 1).alias(out))


def global_lead(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Add the next row's ``value`` over the whole table (null for the last row), by fixed ranges of ``order``."""
    rows = df.withColumn("__p", range_parts(df, order))
    w = Window.partitionBy("__p").orderBy(order)
    firsts = rows.groupBy("__p").agg(F.min_by(value, order).alias("__v"))
    after = firsts.select("__p", F.lead("__v").over(Window.partitionBy(F.lit(0)).orderBy("__p")).alias("__v"))  # a row per range
    own = rows.withColumns({"__n": F.lead(value).over(w), "__last": F.lead(F.lit(1)).over(w).isNull()})
    joined = own.join(F.broadcast(after), "__p")
    return joined.select(*df.columns, F.when(F.col("__last"), F.col("__v")).otherwise(F.col("__n")).alias(out))


def overlap_join(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, bucket: int) -> DataFrame:
    """Pairs with ls < re and le > rs (half-open, non-empty): equi-joins on shared buckets of the line.

    Buckets have widths ``bucket`` * 4**level; an interval's own level is the first one as wide as itself, so
    it touches two buckets there at most, however long it is. A pair meets at the higher of its two own levels:
    the longer interval is filed under that level only, the shorter under its own and the wider ones that
    the other side has. A pair is kept in the first bucket that both touch, so no distinct is needed.
    """

    def level(s: str, e: str) -> Column:
        return F.greatest(F.ceil(F.log(4.0, (F.col(e) - F.col(s)) / bucket) - 1e-9), F.lit(0)).cast("int")

    def width(lv: Column) -> Column:
        return F.call_function("shiftleft", F.lit(bucket).cast("long"), (2 * lv).cast("int"))

    def touched(df: DataFrame, s: str, e: str) -> DataFrame:
        first, last = F.floor(F.col(s) / width(F.col("__l"))), F.floor((F.col(e) - 1) / width(F.col("__l")))
        return df.withColumn("__b", F.explode(F.sequence(first, last)))

    a, b = left.where(F.col(ls) < F.col(le)).withColumn("__la", level(ls, le)), right.where(F.col(rs) < F.col(re)).withColumn("__lb", level(rs, re))
    hit = (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs))
    first = F.col("__b") == F.floor(F.greatest(ls, rs) / width(F.col("__l")))
    most = lambda df, c: F.broadcast(df.agg(F.max(c).alias("__top")))  # one row
    up = lambda df, own, other, c, more: df.join(most(other, c)).where(F.col(own) + more <= F.col("__top")).withColumn("__l", F.explode(F.sequence(F.col(own) + more, "__top")))
    wide_b = touched(up(a, "__la", b, "__lb", 0), ls, le).join(touched(b.withColumn("__l", F.col("__lb")), rs, re), ["__l", "__b"])
    wide_a = touched(a.withColumn("__l", F.col("__la")), ls, le).join(touched(up(b, "__lb", a, "__la", 1), rs, re), ["__l", "__b"])
    cols = [*left.columns, *right.columns]
    return wide_b.where(hit & first).select(*cols).unionByName(wide_a.where(hit & first).select(*cols))


def islands(df: DataFrame, flag: str, order: str, key: str | None = None) -> DataFrame:
    """Add ``island``: the number of the maximal run of rows with equal flag that a row is in."""
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(order)
    new = F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1)
    return df.withColumn("__n", new).withColumn("island", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__n")


def tiles(df: DataFrame, key: str, start: str, end: str, total: str) -> DataFrame:
    """Per key, whether the intervals start at 0, end at total, and each begins where the last one ended."""
    w = Window.partitionBy(key).orderBy(start, end)
    x = df.withColumn("__next", F.lead(start).over(w))
    ok = (F.min(start) == 0) & (F.max(end) == F.max(total)) & F.bool_and(F.coalesce(F.col("__next") == F.col(end), F.lit(True)))
    return x.groupBy(key).agg(ok.alias("tiled"))
