"""Exact substring dedup by level-wise doubling.

A window of ``min_words`` words can only recur where its parts recur. So short windows are
looked at first, and of those only the ones that content selects: the one with the least hash
inside each full window, which equal full windows share. Windows found in two texts survive
and are extended to twice the length: of the full windows around a survivor, the selected window of the
double length is looked up again, and so on until no candidate survives or the length asked for is
reached, where full windows are compared (longer windows cannot change what is covered).
A word is removed if it lies in a full window that also starts in a document with a smaller
doc_id; windows are judged on the input.

Defined results: a null or empty text has no words; rows without doc_id are kept whole and
remove nothing; rows with one doc_id do not remove each other, and each loses only what other documents
hold of its own text; windows do not cross documents; texts of fewer than min_words words stay whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _W1, _W2, Words, chunks, discard, map_batches, signed, sliding, text_buffers, window_rows, windows, written

#: Shortest window that the doubling may begin with.
BASE = 8


def lengths(min_words: int) -> list[int]:
    """Lengths of the levels, each at most twice the one before, up to min_words."""
    out = [min_words]
    while (out[0] + 1) // 2 >= BASE:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _least(w: Words, length: int, full: int):
    """Starts of the full windows, their rows, and the least hash of a part of ``length`` words in each."""
    starts, row = window_rows(w.off, full)
    if not len(starts):
        return starts, row, np.zeros(0, np.uint64)
    return starts, row, sliding(windows(w.h, length), full - length + 1, np.minimum)[starts]


def _surviving(batch, i: int, j: int, row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the full windows' least parts are among the survivors (column 2) of their rows."""
    alive = batch.column(2)
    values, ends = alive.values.to_numpy(zero_copy_only=False).view(np.uint64), alive.offsets.to_numpy()
    keep = np.zeros(len(h), bool)
    at = np.searchsorted(row, np.arange(j - i + 1))
    for d in np.unique(row):
        keep[at[d] : at[d + 1]] = np.isin(h[at[d] : at[d + 1]], values[ends[i + d] : ends[i + d + 1]])
    return keep


def _anchors(length: int, full: int, before: int | None = None):
    """(h, k): the least parts of ``length`` of the full windows of each text, once per text; k names the text. before: only of
    the windows whose least part of that length survived."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            raw, off = text_buffers(batch.column(1))
            for i, j in chunks(off):
                w = Words(raw, off, i, j)
                _, row, h = _least(w, length, full)
                if before and len(h):
                    keep = _surviving(batch, i, j, row, _least(w, before, full)[2])
                    row, h = row[keep], h[keep]
                if len(h):
                    new = np.ones(len(h), bool)  # neighbours mostly share their least part
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    pair = np.unique(np.rec.fromarrays([row[new], h[new]], names="d,h"))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(pair["h"])), pa.array(ids[pair["d"] + i])], names=["h", "k"])

    return run


def _extended(length: int, full: int):
    """Full windows whose least part is among the row's survivors, each once per row at its first start."""

    def run(batches):
        for batch in batches:
            k, ids = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), dtype=np.int64) for c in (0, 3))
            raw, off = text_buffers(batch.column(1))
            for i, j in chunks(off):
                w = Words(raw, off, i, j)
                starts, row, h = _least(w, length, full)
                if not len(h):
                    continue
                keep = _surviving(batch, i, j, row, h)
                starts, row = starts[keep], row[keep]
                if len(starts):
                    h1 = windows(w.h, full, _W1)[starts]
                    by = np.lexsort((starts, h1, row))
                    one = np.ones(len(by), bool)
                    one[1:] = (h1[by][1:] != h1[by][:-1]) | (row[by][1:] != row[by][:-1])
                    pick = np.sort(by[one])
                    starts, row, h1 = starts[pick], row[pick], h1[pick]
                    h2 = windows(w.h, full, _W2)[starts]
                    at = (starts - w.off[row]).astype(np.int32)
                    cols = [signed(h1), signed(h2), ids[row + i], k[row + i], at]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "doc_id", "k", "at"])

    return run


def _twice(found: DataFrame) -> DataFrame:
    """(k, alive): of each text, the windows that another text has too."""
    twice = found.groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a < b").select("h")
    return written(found.join(twice.hint("merge"), "h", "left_semi").groupBy("k").agg(F.collect_set("h").alias("alive")), "alive")


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, k, copy boolean, at array<int>) of the texts that lose words; k is the text's xxhash64.

    copy: a smaller doc_id has the same text, so every full window goes. at: first starts of the
    windows that also start in a smaller doc_id. Equal texts are looked into once, by their least doc_id.
    """
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    some = some.withColumns({"k": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), F.col("text"))})
    names = written(some.select("doc_id", "k", "k2"), "names")
    reps = written(names.groupBy("k", "k2").agg(F.min("doc_id").alias("rep")), "reps")
    copies = written(names.join(reps, ["k", "k2"]).where("rep < doc_id").select("doc_id", "k").distinct(), "copies")
    discard(names)
    levels = lengths(min_words)
    found = written(map_batches(some.select("k", "text"), _anchors(levels[0], min_words), "h long, k long"), "anchors")
    for length, before in [*zip(levels[1:-1], levels), (None, levels[-2] if len(levels) > 1 else min_words)]:
        alive = _twice(found)
        discard(found)
        one = alive.join(reps, "k").select(F.col("rep").alias("doc_id"), "k", "k2", "alive")
        wide = some.join(one, ["doc_id", "k", "k2"]).select("k", "text", "alive", "doc_id")
        if length:
            found = written(map_batches(wide, _anchors(length, min_words, before), "h long, k long"), "anchors")
        else:
            found = written(map_batches(wide, _extended(before, min_words), "h1 long, h2 long, doc_id long, k long, at int"), "windows")
        discard(alive)
    first = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = written(first.select("h1", "h2", "first"), "first")
    late = found.join(first.hint("merge"), ["h1", "h2"]).where("first < doc_id").groupBy("doc_id", "k").agg(F.collect_set("at").alias("at"))
    late = written(late, "late")
    for x in (found, first, reps):
        discard(x)
    no = F.lit(None).cast("array<int>")
    return late.select("doc_id", "k", F.lit(False).alias("copy"), "at").unionByName(copies.select("doc_id", "k", F.lit(True).alias("copy"), no.alias("at")))


def kept_words(docs: DataFrame, found: DataFrame, min_words: int = 50, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) per row of docs; found as from :func:`repeats`."""

    def run(batches):
        for batch in batches:
            n, gone, sha, kept = [], [], [], []
            texts = batch.column(1)
            raw, off = text_buffers(texts)
            for d, (t, copy, at) in enumerate(zip(texts.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                words = (t or b"").split()
                left = words
                if copy and len(words) >= min_words:
                    left = []
                elif at:
                    h = windows(Words(raw, off, d, d + 1).h, min_words)
                    cover = np.zeros(len(words) + 1, np.int32)
                    start = np.flatnonzero(np.isin(h, h[[k for k in at if k < len(h)]]))
                    cover[start] += 1
                    cover[start + min_words] -= 1
                    left = [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                b = b" ".join(left)
                n.append(len(words))
                gone.append(len(words) - len(left))
                sha.append(hashlib.sha256(b).hexdigest())
                if with_text:
                    kept.append(b)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    per = found.groupBy("doc_id", "k").agg(F.max("copy").alias("copy"), F.max("at").alias("at"))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("k"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.join(per, ["doc_id", "k"], "left").select("doc_id", "text", "copy", "at")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return map_batches(rows, run, schema)


def substring_dedup(docs: DataFrame, min_words: int = 50, with_text: bool = True) -> DataFrame:
    """Remove repeated passages of ``docs`` (doc_id, text); see the module for the rule."""
    return kept_words(docs, repeats(docs, min_words), min_words, with_text)
