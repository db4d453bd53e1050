"""Greedy batches of a long sequence by successor pointers: no key is one task's, however many rows it has.

A batch that begins at row i ends before next(i), the first row that closes it, which a search in the running sums of
sizes finds. Batches are therefore the rows met from the first one along next(). Rows are dealt by ranges of (key, order);
a range's part of a key is a segment. Within a segment, pointer doubling gives every row the last batch begun from it
inside the segment and how many batches lie between, in log rounds over arrays. A segment meets what comes before it only
through the bytes of the batch that is open at its start, and whichever these are, the first row to begin a batch lies
among the rows of the segment's first batch length. So a segment is summed up by those rows, with the bytes left open at its
end and the batches begun, if a batch begins there. These summaries are folded in order (a key has at most as many as there
are ranges), and each segment then marks its batches from its own first one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import placed, ship


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key values, rows) of each run of equal keys in sorted batches. One run is held at a time."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows, bool)
        for k in keys:
            code = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cut[1:] |= code[1:] != code[:-1]
        at = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            own = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and own != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


class Rule:
    """When a batch closes. target: before an item with which it would hold more. early: also as soon as it holds that much.
    bytes_only: a batch of empty items does not close before a large one. A change of mark closes a batch in any case."""

    def __init__(self, target: int, early: bool, bytes_only: bool):
        self.target, self.early, self.bytes_only = max(target, 1), early, bytes_only

    def next(self, n: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """For each row of a segment the first row after the batch that begins there, or the number of rows."""
        m, incl = len(n), np.cumsum(n)
        i, before = np.arange(m), incl - n
        some = self._first_bytes(n, i) if self.bytes_only else i
        out = np.maximum(np.searchsorted(incl, before + self.target, side="right"), some + 1)
        if self.early:
            out = np.minimum(out, np.searchsorted(incl, before + self.target, side="left") + 1)
        change = np.append(np.flatnonzero(marks[1:] != marks[:-1]) + 1, m)
        return np.minimum(out, change[np.searchsorted(change, i, side="right")])

    def _first_bytes(self, n: np.ndarray, i):
        with_bytes = np.append(np.flatnonzero(n > 0), max(len(n) - 1, 0))
        return with_bytes[np.minimum(np.searchsorted(with_bytes, i), len(with_bytes) - 1)]

    def entry(self, open_bytes: int, incl: np.ndarray, m: int, change: int, first_bytes: int) -> int:
        """The first row to begin a batch if one with so many bytes is open. incl: running sums of the first rows, all that
        a batch can reach; change: the first row at which the mark changes."""
        left = self.target - open_bytes
        out = int(np.searchsorted(incl, left, side="right"))
        if self.bytes_only and open_bytes == 0:
            out = max(out, first_bytes + 1)
        if self.early:
            out = 0 if left <= 0 else min(out, int(np.searchsorted(incl, left, side="left")) + 1)
        return min(out, change, m)


def last_begun(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the last one met along ``follow`` and how many steps away it is, by pointer doubling."""
    m = len(follow)
    at = np.where(follow < m, follow, np.arange(m))
    steps = (follow < m).astype(np.int64)
    while True:
        further = at[at]
        if (further == at).all():
            return at, steps
        steps = steps + steps[at]
        at = further


def met(follow: np.ndarray, first: int) -> np.ndarray:
    """Whether each row is met along ``follow`` from row ``first``: the set doubles its reach in every round."""
    m = len(follow)
    out = np.zeros(m + 1, bool)
    out[first] = True
    jump = np.append(follow, m)
    while (jump < m).any():
        out[jump[np.flatnonzero(out)]] = True
        jump = jump[jump]
    out[jump[np.flatnonzero(out)]] = True
    return out[:m]


def greedy_batches(df: DataFrame, key: str, order: str, size: str, target: int, early: bool = False, breaker: str | None = None, bytes_only: bool = False) -> DataFrame:
    """Add ``batch``, the number of each row's batch within its key: see :class:`Rule`. An item above the target stands alone.

    order: unique within a key. A null size counts as 0, a null key is a key, and null marks are equal.
    """
    rule = Rule(target, early, bytes_only)
    rows = placed(df, key, order)
    mark = F.col(breaker).cast("string") if breaker else F.lit(None).cast("string")
    columns = df.columns
    own = {"__n": F.coalesce(F.col(size).cast("long"), F.lit(0)), "__mark": mark}
    segments = ["__key", "__part"]
    narrow = rows.select(F.col(key).alias("__key"), "__part", "__seq", *[c.alias(k) for k, c in own.items()])
    ship(df.sparkSession)
    dealt = lambda x: x.repartition(*segments).sortWithinPartitions(*segments, "__seq")

    def arrays(table: pa.Table):
        n = table.column("__n").to_numpy()
        return n, table.column("__mark").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

    def summary(batches):
        for (k, part), table in runs(batches, segments):
            n, marks = arrays(table)
            m, incl = len(n), np.cumsum(n)
            follow = rule.next(n, marks)
            last, steps = last_begun(follow)
            changes = np.flatnonzero(marks[1:] != marks[:-1]) + 1
            change = int(changes[0]) if len(changes) else m
            first_bytes = int(rule._first_bytes(n, 0))
            few = min(rule.entry(0, incl, m, change, first_bytes) + 1, m)
            said = table.column("__mark")
            row = [k, part, m, int(incl[-1]), change, first_bytes, said[0].as_py(), said[m - 1].as_py(), incl[:few], (incl[-1] - incl + n)[last[:few]], steps[:few]]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, arrow.types)], schema=arrow)

    def fold(batches):
        last, batch, open_bytes, mark = None, -1, None, None
        for x in batches:
            out = []
            for i in range(x.num_rows):
                of = {c: x.column(c)[i] for c in x.schema.names}
                if batch < 0 or of["__key"].as_py() != last:
                    last, batch, open_bytes = of["__key"].as_py(), -1, None
                m, incl = of["m"].as_py(), of["incl"].values.to_numpy()
                if open_bytes is None or of["first_mark"].as_py() != mark:
                    first = 0
                else:
                    first = rule.entry(open_bytes, incl, m, of["change"].as_py(), of["first_bytes"].as_py())
                out.append((last, of["__part"].as_py(), first, batch))
                if first < m:
                    batch += 1 + of["steps"].values[first].as_py()
                    open_bytes = of["open"].values[first].as_py()
                else:
                    open_bytes += of["total"].as_py()
                mark = of["last_mark"].as_py()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), entries.types)], schema=entries)

    def number(batches):
        for _, table in runs(batches, segments):
            first, base = table.column("__first")[0].as_py(), table.column("__base")[0].as_py()
            table = table.slice(1)  # the segment's entry stands before its rows
            follow = rule.next(*arrays(table))
            numbers = base + np.cumsum(met(follow, first))
            done = table.select(columns).append_column("batch", pa.array(numbers, pa.int64()))
            yield from done.to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.schema[key].dataType.simpleString()
    schema = f"__key {kind}, __part int, m long, total long, change long, first_bytes long, first_mark string, last_mark string, incl array<long>, open array<long>, steps array<long>"
    entry = f"__key {kind}, __part int, __first long, __base long"
    empty = lambda s: to_arrow_schema(df.sparkSession.createDataFrame([], s).schema)
    arrow, entries = empty(schema), empty(entry)
    found = dealt(narrow).mapInArrow(summary, schema).repartition("__key").sortWithinPartitions("__key", "__part")
    firsts = found.mapInArrow(fold, entry).withColumn("__seq", F.lit(-1).cast("long"))
    both = rows.withColumns(own | {"__key": F.col(key)}).unionByName(firsts, allowMissingColumns=True)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", batch bigint"
    return dealt(both).mapInArrow(number, out)
