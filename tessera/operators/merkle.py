"""Snapshots as trees of digests: a comparison looks only into parts whose digests differ.

A snapshot's rows are stored as (key, prefixes, digest, length), and above them, for every prefix of every level, the digest
of all rows below it. A digest is the exclusive or of its rows' (key, content) hashes, 128 bits: it depends on no order, is summed
within each task before a shuffle, and tells sets apart because keys are unique. Contents are read once, when a tree is
stored. Two trees are compared from the coarsest level down: only prefixes whose parents differ are met, and only rows under
prefixes that differ at the finest level are joined, so what is shuffled follows the change and not the snapshots.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import discard, written


@dataclass
class Tree:
    """rows: key, p0, p1, ... (prefixes, coarse to fine), d1, d2 (digest), len. nodes: level, the same prefixes (null below the
    level), d1, d2, n."""

    rows: DataFrame
    nodes: DataFrame
    levels: int


def digest(key: str, content: str) -> dict[str, Column]:
    """d1, d2: 128 bits of a row; a null content differs from an empty one."""
    what = [F.col(key), F.col(content), F.col(content).isNull()]
    return {"d1": F.xxhash64(F.lit(1), *what), "d2": F.xxhash64(F.lit(2), *what)}


def stored(snapshot: DataFrame, key: str, content: str, prefixes: list[Callable[[Column], Column]]) -> Tree:
    """The tree of a snapshot. key: unique and not null. prefixes: each level's prefix of a key, coarse to fine; each
    is determined by the one after it."""
    p = [f"p{k}" for k in range(len(prefixes))]
    at = {name: f(F.col(key)) for name, f in zip(p, prefixes)}
    length = F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
    rows = written(snapshot.select(F.col(key).alias("key"), *[c.alias(k) for k, c in at.items()], *[c.alias(k) for k, c in digest(key, content).items()], length.alias("len")), "rows")
    both = [F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2")]
    finest = rows.groupBy(*p).agg(*both, F.count("*").alias("n"))
    level = F.lit(len(p)) - F.bit_count(F.grouping_id())
    nodes = finest.rollup(*p).agg(*both, F.sum("n").alias("n"), level.cast("int").alias("level"))
    return Tree(rows, written(nodes, "nodes"), len(p))


def unequal(old: Tree, new: Tree) -> DataFrame:
    """The finest prefixes (p0, p1, ...) under which the trees differ, by descent; a written table."""
    open_, above = None, []
    for level in range(old.levels + 1):
        p = [f"p{k}" for k in range(level)]
        side = lambda t, s: t.nodes.where(F.col("level") == level).select("level", *p, *[F.col(c).alias(c + s) for c in ("d1", "d2", "n")])  # noqa: B023, E731
        a, b = side(old, "o"), side(new, "n")
        if above:
            a, b = a.join(open_, above, "left_semi"), b.join(open_, above, "left_semi")
        both = a.join(b, ["level", *p], "full_outer")
        same = F.coalesce((F.col("d1o") == F.col("d1n")) & (F.col("d2o") == F.col("d2n")) & (F.col("no") == F.col("nn")), F.lit(False))
        found = written(both.where(~same).select("level", *p), "open")
        discard(open_)
        open_, above = found, p
        if found.isEmpty():
            break
    return open_ if above and len(above) == old.levels else open_.where("false").select(*[F.lit(None).cast(old.rows.schema[f"p{k}"].dataType).alias(f"p{k}") for k in range(old.levels)])


def changes(old: Tree, new: Tree) -> DataFrame:
    """(key, change) of the keys added, deleted or modified."""
    p = [f"p{k}" for k in range(old.levels)]
    open_ = unequal(old, new).select(*p)
    some = lambda t, s: t.rows.join(open_, p, "left_semi").select("key", F.struct("d1", "d2").alias(s))
    both = some(old, "o").join(some(new, "n"), "key", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified")
    return both.select("key", change.alias("change")).where("change IS NOT NULL")
