"""Normalised content-defined chunking with a gear hash (own table and bounds), and zstd frames.

Up to the mean length a boundary needs a hash of more zero bits, beyond it one of fewer, which draws lengths to the mean.
Boundaries depend on the bytes since the last boundary alone, so cutting a stream piece by
piece gives the same chunks as cutting it at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_GEAR = np.random.Generator(np.random.PCG64(1)).integers(0, 2**64, 256, dtype=np.uint64)
_SHIFT = 32
#: How much rarer boundaries are before the mean length, and how much more common after it.
NORMAL = 4


def cut_points(data: bytes, least: int = 256, mean: int = 1024, most: int = 4096) -> list[int]:
    """Ends of the chunks of data: ascending, the last is len(data). mean is a power of two, 4 at least."""
    n, out, at = len(data), [], 0
    if not n:
        return out
    v = _GEAR[np.frombuffer(data, np.uint8)]
    h = np.zeros(n, np.uint64)
    for k in range(min(_SHIFT, n)):  # the hash of the last 32 bytes, for all places at once
        h[k:] += v[: n - k] << np.uint64(k)
    bits = h >> np.uint64(40)
    rare, common = (np.flatnonzero(bits % np.uint64(m) == 0) + 1 for m in (mean * NORMAL, mean // NORMAL))
    while at < n:
        first = at + max(least, _SHIFT)
        k = np.searchsorted(rare, first)
        if k < len(rare) and rare[k] < at + mean:
            end = int(rare[k])
        else:
            k = np.searchsorted(common, max(first, at + mean))
            end = int(common[k]) if k < len(common) else n
        at = min(end, at + most, n)
        out.append(at)
    return out


def chunks(df: DataFrame, key: str, content: str, least: int = 256, mean: int = 1024, most: int = 4096) -> DataFrame:
    """(key, chunk_index, chunk_offset, raw_len, raw_hash) of each row's content."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, c in zip(pdf[key], pdf[content]):
                data, at = (c or "").encode(), 0
                for i, end in enumerate(cut_points(data, least, mean, most)):
                    rows.append((k, i, at, end - at, hashlib.sha256(data[at:end]).hexdigest()))
                    at = end
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk_offset", "raw_len", "raw_hash"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInPandas(run, f"`{key}` {kind}, chunk_index int, chunk_offset bigint, raw_len int, raw_hash string")


def frames(batches, level: int = 3):
    """Arrow batches (key, content) as (key, raw_len, compressed_len, same), one content at a time: neither frames nor decoded texts
    of a batch are held."""
    import pyarrow as pa
    import zstandard

    up, down = zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()
    for batch in batches:
        raw_len, compressed_len, same = [], [], []
        for c in batch.column(1):
            raw = (c.as_py() or "").encode()
            z = up.compress(raw)
            raw_len.append(len(raw))
            compressed_len.append(len(z))
            same.append(down.decompress(z, max_output_size=max(1, len(raw))) == raw)
        columns = [batch.column(0), pa.array(raw_len, pa.int64()), pa.array(compressed_len, pa.int64()), pa.array(same, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "raw_len", "compressed_len", "same"])


def zstd_lengths(df: DataFrame, key: str, content: str, level: int = 3) -> DataFrame:
    """(key, raw_len, compressed_len, same): each content as a zstd frame, checked by decompression."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInArrow(lambda batches: frames(batches, level), f"`{key}` {kind}, raw_len bigint, compressed_len bigint, same boolean")
