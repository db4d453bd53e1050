"""Ranges of stored chunks, read through a caller's function."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def fetched(wanted: DataFrame, fetch: Callable[[object, int, int], bytes], chunk: str, start: str, length: str, out: str = "content", gap: int = 4096) -> DataFrame:
    """Add ``out``: the bytes start .. start + length of each row's chunk.

    fetch(chunk, first, end) -> bytes runs in the workers. Rows are dealt and sorted by chunk and start, so
    neighbouring ranges of one chunk (less than ``gap`` bytes apart, within one Arrow batch) cost one call. A null chunk, start or
    length gives null; an answer of the wrong length is an error; the order of rows is not kept.
    """
    names = list(wanted.columns)

    def run(batches):
        for batch in batches:
            keys, at, n = (batch.column(names.index(c)).to_pylist() for c in (chunk, start, length))
            rows = [i for i in range(len(keys)) if None not in (keys[i], at[i], n[i])]
            got: list[bytes | None] = [None] * len(keys)
            k = 0
            while k < len(rows):
                first, end, last = at[rows[k]], at[rows[k]] + n[rows[k]], k + 1
                while last < len(rows) and keys[rows[last]] == keys[rows[k]] and at[rows[last]] <= end + gap:
                    end, last = max(end, at[rows[last]] + n[rows[last]]), last + 1
                data = fetch(keys[rows[k]], first, end)
                if len(data) != end - first:
                    raise ValueError(f"chunk {keys[rows[k]]}: {len(data)} bytes in place of {end - first}")
                for i in rows[k:last]:
                    got[i] = bytes(data[at[i] - first : at[i] - first + n[i]])
                k = last
            yield batch.append_column(out, pa.array(got, pa.binary()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema) + f", `{out}` binary"
    return wanted.repartition(chunk).sortWithinPartitions(chunk, start).mapInArrow(run, schema)
