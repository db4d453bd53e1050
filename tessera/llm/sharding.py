"""Byte-balanced sharding by histogram sort (DataFrame functions only).

Rows are ordered by (k1, k2). The exact byte counts below candidate boundaries are taken
over all partitions; each round looks only into the intervals that still hold a wanted
boundary and counts 256 sub-intervals of each, until the boundary is within the tolerance
or falls between two rows. Boundaries of shards are held to a tight tolerance; those of the slices in which
a shard is sorted only to a loose one, so few rounds and cells are needed for many slices. Rows then move
once, to the slice of the shard that the splitters name.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, written

_LOW = -(1 << 63)
_ALL = (1 << 64) - 1


def _unsigned(key: str) -> Column:
    """The key's bits in unsigned order."""
    return F.col(key).bitwiseXOR(F.lit(_LOW))


def _refine(rows: DataFrame, group: Column, key: str, wanted: dict[int, tuple[int, list[int]]], tolerance: dict[int, int]) -> dict[int, tuple[int, int, int, int, int]]:
    """For each wanted byte count: (group, key, bytes below key, bytes below the next key, rows between).

    wanted: for each group value, the bytes before it and the counts sought inside it. Looks at
    unsigned prefixes of the key, a byte longer each round. Only counts come to the driver: at
    most 256 for each boundary that is still open.
    """
    found: dict[int, tuple[int, int, int, int, int]] = {}
    open_ = {(g, 0): x for g, x in wanted.items()}
    for level in range(1, 9):
        if not open_:
            break
        some = rows.withColumn("g", group)
        if None not in wanted:
            some = some.where(F.col("g").isin([g for g, _ in open_]))
        if level > 1:
            some = some.where(F.shiftrightunsigned(_unsigned(key), 72 - 8 * level).isin([p for _, p in open_]))
        cell = F.shiftrightunsigned(_unsigned(key), 64 - 8 * level)
        sums = [F.sum("size").cast("long").alias("n"), F.count("*").alias("c"), F.min(key).alias("a"), F.max(key).alias("b")]
        got = {(r["g"], r["p"] & _ALL): r for r in some.groupBy("g", cell.alias("p")).agg(*sums).collect()}
        nxt: dict[tuple, tuple[int, list[int]]] = {}
        for (g, prefix), (at, ws) in open_.items():
            cells = []
            for p in range(prefix << 8, (prefix << 8) + 256):
                if r := got.get((g, p)):
                    cells.append((p, at, at + r["n"], r))
                    at += r["n"]
            for w in ws:
                p, lo, hi, r = next(c for c in cells if c[1] <= w <= c[2])
                if r["a"] == r["b"] or w - lo <= tolerance[w]:
                    found[w] = (g, r["a"], lo, hi, r["c"])
                elif hi - w <= tolerance[w]:
                    found[w] = (g, r["b"] + 1, hi, hi, 0)
                else:
                    nxt.setdefault((g, p), (lo, []))[1].append(w)
        open_ = nxt
    return found


def splitters(rows: DataFrame, shards: int, slices: int = 1, tolerance: float = 0.001, loose: float = 0.25) -> list[tuple[int, int]]:
    """shards * slices - 1 ascending (k1, k2): rows at or above the i-th belong to part i + 1 or later.

    Needs bigint columns k1, k2 and size > 0, not null. A boundary inside the rows of one k1
    (equal keys may hold any share) is refined on k2. tolerance is a share of a shard, for the boundaries of shards;
    loose one of a slice, for the others.
    """
    total, parts = rows.agg(F.sum("size").cast("long")).first()[0] or 0, shards * slices
    if not total:
        return []
    tol: dict[int, int] = {}
    for i in range(1, parts):
        w = total * i // parts
        tol[w] = min(tol.get(w, total), int(total / parts * loose) if i % slices else int(total / shards * tolerance))
    out: dict[int, tuple[int, int]] = {}
    inner: dict[int, tuple[int, list[int]]] = {}
    for w, (_, k, lo, hi, n) in _refine(rows, F.lit(None).cast("long"), "k1", {None: (0, sorted(tol))}, tol).items():
        if n < 2 or w - lo <= tol[w]:
            out[w] = (k, _LOW) if w - lo <= hi - w else (k + 1, _LOW)
        else:
            inner.setdefault(k, (lo, []))[1].append(w)
    for w, (k, k2, lo, hi, _) in (_refine(rows, F.col("k1"), "k2", inner, tol) if inner else {}).items():
        out[w] = (k, k2 if w - lo <= hi - w else k2 + 1)
    return [out[total * i // parts] for i in range(1, parts)]


def _part(at: list[tuple[int, int]], a: str, b: str) -> Column:
    """How many splitters are <= (a, b): first among every _STEP-th one, then among those between."""
    at = [(p, q) for p, q in at if p <= -1 - _LOW and q <= -1 - _LOW]  # no row is above the largest bigint
    if not at:
        return F.lit(0)
    step = max(1, int(len(at) ** 0.5))
    table = lambda x: F.from_json(F.lit(json.dumps([{"a": p, "b": q} for p, q in x])), "array<struct<a: bigint, b: bigint>>")
    below = lambda t: F.size(F.filter(t, lambda s: (s["a"] < F.col(a)) | ((s["a"] == F.col(a)) & (s["b"] <= F.col(b)))))
    whole = F.greatest(below(table(at[::step])) - 1, F.lit(0)) * step
    return (whole + below(F.slice(table(at), whole + 1, step))).cast("int")


def shard(rows: DataFrame, shards: int = 24, k1: str = "k1", k2: str = "k2", size: str = "size", slices: int = 1, tolerance: float = 0.001) -> DataFrame:
    """Add ``shard`` (0..shards-1, near equal bytes) and ``slot`` (0.. in the shard's order).

    Order: (k1, k2), two bigints; nulls sort as the least value, rows of equal keys in any order
    but never across a boundary. All other columns stay; rows are exchanged once. Each shard is
    sorted in ``slices`` tasks. Sizes that are null or below 1 weigh 1. An empty table
    gives no rows.
    """
    keys = {"__k1": F.coalesce(F.col(k1), F.lit(_LOW)), "__k2": F.coalesce(F.col(k2), F.lit(_LOW))}
    x = rows.withColumns(keys)
    weight = F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("long")
    small = written(x.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), weight.alias("size")), "sizes")
    parts = shards * slices
    at = splitters(small, shards, slices, tolerance)
    counts = {r["part"]: r["n"] for r in small.groupBy(_part(at, "k1", "k2").alias("part")).agg(F.count("*").alias("n")).collect()}
    discard(small)
    starts, before = [], 0
    for p in range(parts):
        before = 0 if p % slices == 0 else before
        starts.append(before)
        before += counts.get(p, 0)
    out = x.withColumn("__part", _part(at, "__k1", "__k2"))
    w = Window.partitionBy("__part").orderBy("__k1", "__k2")
    start = F.get(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), F.col("__part"))
    out = out.withColumn("slot", (start + F.row_number().over(w) - 1).cast("long"))
    return out.withColumn("shard", F.floor(F.col("__part") / slices).cast("int")).drop("__k1", "__k2", "__part")
