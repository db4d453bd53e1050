"""Centroid clustering of integer vectors, exact, by exponion search.

Every vector carries its centroid, an upper bound of its distance to it, and a lower bound of its distance to any other. When
centroids have moved, the bounds are widened by how far. A vector whose upper bound is strictly below its lower bound, or
strictly below half the way to the nearest other centroid, keeps its centroid and is not looked at. For any other one the upper
bound is made exact, and if that does not decide, the centroids inside the ball around its own centroid of radius
2 * upper + distance to the nearest other are scanned, along the list of its centroid's neighbours sorted by distance. The
ball holds the nearest and the second nearest; its radius is inclusive, so ties are found, and the smaller number wins.

Distances that decide are sums of 64-bit integers. Bounds are doubles, widened by a relative margin of 1e-9, far above
their rounding, so rounding never skips a vector. Each round is one pass over a written table, which holds the
next state and, in a few more rows per task, the sums of each centroid's vectors; only sums by centroid and component reach
the driver (k * 64 numbers).

Defined results: a vector is kept if it has exactly ``size`` components, none null or non-finite; components are clamped to
+-2**27 after flooring (|x| beyond 131,072), where squared distances would leave 64 bits. Repeated rows and ids give
a row each; a null id counts as an empty one in the order of starts, whose ties go by the vector. With fewer vectors than
``k`` there are as many centroids; without any there are no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, written

#: Largest absolute component.
LIMIT = 1 << 27
#: Relative margin of the bounds.
MARGIN = 1e-9


def integers(vectors: DataFrame, size: int, scale: int, vec: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of the components of the kept vectors."""
    x = F.col(vec)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-2.0 * LIMIT)), F.lit(2.0 * LIMIT))), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return vectors.where((F.size(x) == size) & ~F.exists(x, bad)).select("vec_id", whole.alias("v"))


class Neighbours:
    """Distances between centroids: each one's others in order of distance, and half the way to the nearest."""

    def __init__(self, c: np.ndarray):
        k = len(c)
        d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2).astype(float))
        self.c, self.d = c, d
        self.order = np.argsort(d, axis=1, kind="stable")
        self.sorted = np.take_along_axis(d, self.order, axis=1)
        off = d + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.nearest = off.min(1) if k > 1 else np.full(k, np.inf)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    e = x - c
    return np.einsum("ij,ij->i", e, e)


def first_assignment(x: np.ndarray, c: np.ndarray):
    """Nearest centroid (ties: smaller number), and both bounds."""
    d = np.stack([squared(x, y) for y in c], axis=1)
    a = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(x)), a].astype(float)) * (1 + MARGIN)
    d[np.arange(len(x)), a] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(float)) * (1 - MARGIN) if len(c) > 1 else np.full(len(x), np.inf)
    return a, upper, lower


def exponion(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Neighbours):
    """The state under the centroids of ``now``; returns it and how many distances to centroids were taken."""
    a, upper, lower = a.copy(), upper.copy(), lower.copy()
    skip = np.maximum(lower, now.nearest[a] / 2 * (1 - MARGIN))
    todo = np.flatnonzero(upper >= skip)
    exact = squared(x[todo], now.c[a[todo]])
    upper[todo] = np.sqrt(exact.astype(float)) * (1 + MARGIN)
    open_ = upper[todo] >= skip[todo]
    taken = len(todo)
    todo, exact = todo[open_], exact[open_]
    if len(now.c) == 1:
        return a, upper, lower, taken
    own = a[todo]
    radius = (2 * upper[todo] + now.nearest[own]) * (1 + MARGIN)
    best, who = exact.copy(), own.copy()
    second = np.full(len(todo), np.iinfo(np.int64).max)
    for j in np.unique(own):
        mine = np.flatnonzero(own == j)
        reach = np.searchsorted(now.sorted[j], radius[mine], side="right")
        for place in range(len(now.c)):
            far = mine[reach > place]
            if not len(far):
                break
            other = int(now.order[j, place])
            if other == j:
                continue
            d = squared(x[todo[far]], now.c[other])
            taken += len(far)
            wins = (d < best[far]) | ((d == best[far]) & (other < who[far]))
            second[far] = np.where(wins, best[far], np.minimum(second[far], d))
            best[far] = np.where(wins, d, best[far])
            who[far] = np.where(wins, other, who[far])
    a[todo] = who
    upper[todo] = np.sqrt(best.astype(float)) * (1 + MARGIN)
    lower[todo] = np.sqrt(second.astype(float)) * (1 - MARGIN)
    return a, upper, lower, taken


def _pass(state: DataFrame, size: int, cs: list[np.ndarray], last: bool) -> DataFrame:
    """One round over a table of vectors (the first: v as an array) under the centroids cs[-1], which were cs[-2] before."""
    import pyarrow as pa

    now = Neighbours(cs[-1])
    moved = np.sqrt(((cs[-1] - cs[-2]) ** 2).sum(1).astype(float)) * (1 + MARGIN) if len(cs) > 1 else None
    k = len(cs[-1])
    if moved is not None:
        others = np.array([max([m for i, m in enumerate(moved) if i != j], default=0.0) for j in range(k)])
    width = pa.list_(pa.int64())

    def run(batches):
        sums, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if moved is None:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)
                a, upper, lower = first_assignment(x, now.c)
            else:
                data = b"".join(batch.column("v").to_pylist())
                x = np.frombuffer(data, np.int32).reshape(-1, size).astype(np.int64)
                a = batch.column("a").to_numpy(zero_copy_only=False).astype(np.int64)
                upper = batch.column("upper").to_numpy(zero_copy_only=False) + moved[a]
                lower = batch.column("lower").to_numpy(zero_copy_only=False) - others[a]
                a, upper, lower, _ = exponion(x, a, upper * (1 + MARGIN), lower - np.abs(lower) * MARGIN, now)
            if not len(x):
                continue
            raw = x.astype(np.int32)
            for j in np.unique(a):
                own = a == j
                sums[j] += x[own].sum(0)
                n[j] += own.sum()
            none = pa.nulls(len(x), pa.int64())
            exact = pa.array(squared(x, now.c[a])) if last else none
            v = pa.nulls(len(x), pa.binary()) if last else pa.array([raw[i].tobytes() for i in range(len(raw))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, pa.array(a, pa.int32()), pa.array(upper), pa.array(lower), exact, none, pa.nulls(len(x), width)], names)
        some = np.flatnonzero(n)
        if len(some) and not last:
            m = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, kind), pa.nulls(m, pa.binary()), pa.array(some, pa.int32()), *[pa.nulls(m, pa.float64())] * 2, pa.nulls(m, pa.int64()), pa.array(n[some]), pa.array(sums[some].tolist(), width)], names
            )

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["vec_id", "v", "a", "upper", "lower", "distance", "n", "sums"]
    kind = to_arrow_type(state.schema["vec_id"].dataType)
    schema = f"vec_id {state.schema['vec_id'].dataType.simpleString()}, v binary, a int, upper double, lower double, distance long, n long, sums array<long>"
    return map_batches(state, run, schema)


def next_centroids(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means; an empty cluster keeps its centroid."""
    part = state.where("n IS NOT NULL").select("a", "n", F.posexplode("sums").alias("at", "s"))
    big = lambda x: F.sum(F.col(x).cast("decimal(38,0)"))
    out = c.copy()
    for x in part.groupBy("a", "at").agg(big("n").alias("n"), big("s").alias("s")).collect():  # k * size rows
        out[x.a, x.at] = int(x.s) // int(x.n)
    return out


def starts(rows: DataFrame, k: int, salt: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``salt:vec_id``, in that order."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([x.v for x in first], np.int64)


def cluster(vectors: DataFrame, k: int, rounds: int, size: int = 64, scale: int = 1024, salt: int = 3) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, the final centroids) after ``rounds`` rounds and one more assignment."""
    rows = integers(vectors, size, scale)
    c = starts(rows, k, salt)
    if not len(c):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), c
    cs, state = [c], rows
    for _ in range(rounds):
        new = written(_pass(state, size, cs, False), "vectors")
        if state is not rows:
            discard(state)
        state = new
        cs = [cs[-1], next_centroids(state, cs[-1])]
        state_rows = state.where("n IS NULL").select("vec_id", "v", "a", "upper", "lower")
        state_rows._tessera_path = state._tessera_path
        state = state_rows
    out = written(_pass(state, size, cs if rounds else cs[-1:], True).select("vec_id", F.col("a").alias("cluster"), "distance"), "clusters")
    if state is not rows:
        discard(state)
    return out, cs[-1]


def report(vectors: DataFrame, k: int, rounds: int, **kw) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    import hashlib

    rows, c = cluster(vectors, k, rounds, **kw)
    total = {x.cluster: int(x.d) for x in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    names = {j: hashlib.sha256(",".join(map(str, y.tolist())).encode()).hexdigest() for j, y in enumerate(c)}
    of = lambda d, kind: F.element_at(F.create_map(*[F.lit(x).cast(t) for j, v in d.items() for x, t in ((j, "int"), (v, kind))]), F.col("cluster")) if d else F.lit(None).cast(kind)
    inertia = F.lit(sum(total.values())).cast("long")
    return rows.select("vec_id", "cluster", "distance", of(total, "long").alias("cluster_inertia"), inertia.alias("inertia"), of(names, "string").alias("centroid_sha256"))
