"""Shared plumbing: the shared folder, code shipping, fast word hashing."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()
#: Seconds between two collections of the driver's garbage, at least; and when the last one was.
PAUSE = 2.0
_collected = [0.0]


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir():
        return  # already running from a shipped archive
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir). Where it is unset, a local master gets
    a temporary folder, and any other master an error: its executors could not read the driver's disk."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        sc.setCheckpointDir(root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The finished job's shuffle files are let go: Spark deletes them when the driver collects its
    garbage, which it would otherwise do rarely. Small jobs that follow each other closely share one collection.
    """
    path = f"{shared_root(df.sparkSession)}/tessera-{uuid.uuid4().hex[:12]}/{name}"
    schema = df.schema
    df.write.parquet(path)
    if time.monotonic() - _collected[0] > PAUSE:
        df.sparkSession._jvm.System.gc()
        _collected[0] = time.monotonic()
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def crc_of_id(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string"))


# ---------------------------------------------------------------- word hashing

_rng = np.random.Generator(np.random.PCG64(20240229))
_T = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_pow = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        a = np.full(size, base, dtype=np.uint64)
        a[0] = 1
        have = _pow[base] = np.multiply.accumulate(a)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of contract words.
NONSPACE = ~_space
#: ASCII letters and digits, and every byte of a multi-byte character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x80:] = True
ALNUM[ord("0") : ord("9") + 1] = True
ALNUM[ord("A") : ord("Z") + 1] = True
ALNUM[ord("a") : ord("z") + 1] = True
#: Folds A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null is empty."""
    import pyarrow as pa

    if hasattr(col, "combine_chunks"):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if off else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Word hashes of rows i..j: ``h`` (uint64), ``off`` (words before each row), byte spans."""

    __slots__ = ("h", "off", "start", "end", "raw")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, i: int, j: int, is_word=NONSPACE, fold=None):
        lo, hi = int(offsets[i]), int(offsets[j])
        b = raw[lo:hi]
        if fold is not None:
            b = fold[b]
        doc = (offsets[i : j + 1] - lo).astype(np.int64)
        self.raw = b
        w = is_word[b]
        n = len(b)
        if n == 0:
            self.h = np.zeros(0, np.uint64)
            self.off = np.zeros(j - i + 1, np.int64)
            self.start = self.end = np.zeros(0, np.int64)
            return
        prev = np.empty(n, bool)
        prev[0] = False
        prev[1:] = w[:-1]
        inner = doc[:-1][doc[:-1] < n]
        prev[inner] = False
        s = np.flatnonzero(w & ~prev)
        nxt = np.empty(n, bool)
        nxt[-1] = False
        nxt[:-1] = w[1:]
        nxt[inner[inner > 0] - 1] = False
        e = np.flatnonzero(w & ~nxt) + 1
        self.start, self.end = s, e
        self.off = np.searchsorted(s, doc).astype(np.int64)
        if len(s) == 0:
            self.h = np.zeros(0, np.uint64)
            return
        length = e - s
        at = np.zeros(len(s), np.int64)
        np.cumsum(length[:-1], out=at[1:])
        pos = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(at, length)
        v = _T[b[w]] * powers(int(_R), int(length.max()))[pos]
        h = np.add.reduceat(v, at)
        self.h = mix(h ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _inverse(r: int) -> int:
    return pow(r, -1, 1 << 64)


_W1, _W2 = 0x2545F4914F6CDD1D, 0xDA942042E4DD58B5


def windows(h: np.ndarray, length: int, base: int = _W1) -> np.ndarray:
    """Hash of every run of ``length`` consecutive values (may cross rows; mask those)."""
    n = len(h)
    if n < length:
        return np.zeros(0, np.uint64)
    p, q = powers(base, n), powers(_inverse(base), n)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(h * p, out=s[1:])
    return mix((s[length:] - s[:-length]) * q[: n - length + 1])


def window_rows(off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of ``length`` lies inside one row, and that row."""
    n = np.diff(off)
    k = np.maximum(n - length + 1, 0)
    row = np.repeat(np.arange(len(n)), k)
    at = np.cumsum(k) - k
    return np.arange(int(k.sum())) - np.repeat(at - off[:-1], k), row


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over a[i..i+width-1] for every i, by doubling."""
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)
