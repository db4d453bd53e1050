"""Ordered folds: computations whose state resets on the data, which no window frame expresses.

Each is per group, in a total order, in an Arrow-fed worker; a group is one repository's or
key's sequence. The state at a row depends on all rows before it, so one group is one task's stream.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, key: str, order: list[str], needs: list[str], start: Callable[[], object], step: Callable, column: str, kind: str) -> DataFrame:
    """Add ``column``: for each row in order, the value that step(state, *needs) -> (state, value) gives.

    Rows are dealt and sorted by key and order; a task streams over its rows and starts a new state where
    the key changes, so no group is ever held in memory. Missing values are None.
    """

    def run(batches):
        last, state, fresh = None, None, True
        for batch in batches:
            out = []
            for k, *values in zip(batch.column(key).to_pylist(), *[batch.column(c).to_pylist() for c in needs]):
                if fresh or k != last:
                    last, state, fresh = k, start(), False
                state, value = step(state, *values)
                out.append(value)
            yield batch.append_column(column, pa.array(out, pa.bool_() if kind == "boolean" else pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{column}` {kind}"
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def token_bucket(df: DataFrame, key: str, at: str, tie: str, seconds: int, burst: int, whole: bool = True) -> DataFrame:
    """Add ``allowed``: a token comes every ``seconds``. whole: the refill truncates to integers and restamps on every
    call (so frequent calls can starve it, which is kept on purpose); else it is fractional."""

    def step(state, now):
        tokens, last = state
        passed = 0 if last is None else max(0, now - last)
        tokens = min(burst, tokens + (passed // seconds if whole else passed / seconds))
        ok = tokens >= 1
        return (tokens - ok, now), bool(ok)

    return ordered_fold(df, key, [at, tie], [at], lambda: (burst, None), step, "allowed", "boolean")


def bounded_queue(df: DataFrame, key: str, at: str, tie: str, hold: int, places: int) -> DataFrame:
    """Add ``accepted``: whether an arrival finds one of ``places`` free, which it then keeps for ``hold``. The state is the times at
    which places become free again, at most as many as there are."""

    def step(state, now):
        state = tuple(x for x in state if x > now)
        ok = len(state) < places
        return (state + (now + hold,) if ok else state), ok

    return ordered_fold(df, key, [at, tie], [at], tuple, step, "accepted", "boolean")


def newest_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``lands``: whether the write replaces what is stored, in order of arrival.

    It lands if nothing is stored, if the commit is the stored one, if generations exist on both
    sides and are not smaller, or, without generations on either side, if synced_at is not
    smaller. Needs columns commit_id, generation, synced_at. The rule is not a maximum: it depends on arrival.
    """

    def step(old, commit, generation, synced):
        if old is None or old[0] == commit:
            ok = True
        elif old[1] is not None and generation is not None:
            ok = generation >= old[1]
        else:
            ok = (synced or 0) >= (old[2] or 0)
        return ((commit, generation, synced) if ok else old), ok

    return ordered_fold(df, key, [order], ["commit_id", "generation", "synced_at"], lambda: None, step, "lands", "boolean")


def compact_levels(levels: list[int], most: int) -> list[int]:
    """Merge the adjacent pair of least combined size (first on ties) until at most max(most, 1) remain.
    A merged level's size is modelled as the sum."""
    levels = list(levels)
    while len(levels) > max(most, 1):
        i = min(range(len(levels) - 1), key=lambda k: (levels[k] + levels[k + 1], k))
        levels[i : i + 2] = [levels[i] + levels[i + 1]]
    return levels


def compaction(df: DataFrame, key: str, order: list[str], size: str, most: int) -> DataFrame:
    """(key, level, size) after compaction of each group's levels (few for each key)."""
    item = F.struct(*order, F.col(size).cast("long").alias("__size"))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("l")).select(key, F.col("l.__size").alias("l"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "l": [compact_levels([int(x) for x in v], most) for v in pdf["l"]]})

    kind = df.schema[key].dataType.simpleString()
    done = rows.mapInPandas(run, f"`{key}` {kind}, l array<bigint>")
    return done.select(key, F.posexplode("l").alias("level", "size")).withColumn("level", F.col("level").cast("long"))
