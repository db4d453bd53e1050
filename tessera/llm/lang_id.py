"""Language identification by nearest centroid.

A text is its normalised TF-IDF vector of hashed 2- and 3-grams of UTF-8 bytes (ASCII letters
lower-cased, digits, punctuation and white space as one space). Each language has several
centroids from spherical k-means over a bounded sample; the nearest by cosine gives the
language, and a text further from it than nearly all of the language's own sample is
marked as rejected.

Only the fit is bounded: ``PER_LANG`` labelled texts of each language, first by hash of
doc_id. Every whole text is scored. Defined results: null texts and texts without a letter
are ``und`` with score 0; if nothing could be learned, so are all; ties go to the first
language by name; repeated rows are scored alike. Languages are assumed to be few
(their names are collected).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALNUM, LOWER, chunks, map_batches, text_buffers

#: Bound of the fit: texts of each language.
PER_LANG = 300
DIM = 4096
CENTROIDS = 4
#: Share of a language's own sample that may lie beyond the rejection distance.
REJECT = 0.002

_fold = np.where(ALNUM, LOWER, 0x20).astype(np.uint8)
_fold[ord("0") : ord("9") + 1] = 0x20


def vectors(raw: np.ndarray, off: np.ndarray):
    """(i, j, float32 matrix of log(1 + count)) for runs of rows."""
    for a, b in chunks(off):
        for i in range(a, b, 256):
            j = min(b, i + 256)
            lo, hi = int(off[i]), int(off[j])
            t = np.full(hi - lo + 2, 0x20, np.int64)
            t[1:-1] = _fold[raw[lo:hi]]
            row = np.repeat(np.arange(j - i), np.diff(off[i : j + 1])) * DIM
            # a gram belongs to the row of its middle byte; a neighbour from another row is a space
            left, mid, right = t[:-2].copy(), t[1:-1], t[2:].copy()
            cut = (off[i + 1 : j] - lo).astype(np.int64)
            cut = cut[(cut > 0) & (cut < hi - lo)]
            left[cut], right[cut - 1] = 0x20, 0x20
            keep = (mid != 0x20) | (left != 0x20)
            left, mid, right, row = left[keep], mid[keep], right[keep], row[keep]
            key = ((left << 16 | mid << 8 | right) * 0x9E3779B1 & 0xFFFFFFFF) >> 20
            two = ((left << 8 | mid) * 0x85EBCA6B + 0x27D4EB2F & 0xFFFFFFFF) >> 20
            x = np.bincount(np.concatenate([row + key, row + two]), minlength=(j - i) * DIM).reshape(j - i, DIM)
            yield i, j, np.log1p(x).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the farthest points, deterministic."""
    c = [_unit(x.mean(0, keepdims=True))[0]]
    while len(c) < min(k, len(x)):
        c.append(x[int(np.argmin((x @ np.array(c).T).max(1)))])
    c = np.array(c)
    for _ in range(10):
        own = (x @ c.T).argmax(1)
        c = _unit(np.array([x[own == g].mean(0) if (own == g).any() else c[g] for g in range(len(c))]))
    return c


class Model:
    def __init__(self, names: list[str], x: np.ndarray):
        self.langs = sorted(set(names))
        names = np.array(names)
        df = (x > 0).sum(0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 1
        x = _unit(x * self.idf)
        parts = [_clusters(x[names == g], CENTROIDS) for g in self.langs]
        self.c = np.concatenate(parts).astype(np.float32)
        self.of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.far = np.array([np.quantile((x[names == g] @ p.T).max(1), REJECT) - 0.05 for g, p in zip(self.langs, parts)])

    def predict(self, x: np.ndarray):
        """Language, score and rejection of rows of :func:`vectors`."""
        s = _unit(x * self.idf) @ self.c.T
        best = np.stack([s[:, self.of == g].max(1) for g in range(len(self.langs))], 1)
        top = best.argmax(1)
        p = np.exp(20 * (best - best.max(1, keepdims=True)))
        cos = best[np.arange(len(x)), top]
        return top, (p.max(1) / p.sum(1)) * np.clip(cos, 0, 1) ** 0.25, cos < self.far[top]


def _features(batches):
    for batch in batches:
        raw, off = text_buffers(batch.column(1))
        for i, j, x in vectors(raw, off):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def fit(train: DataFrame) -> Model | None:
    """Learn from rows (doc_id, text, lang) with a language and a text."""
    train = train.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # Spark keeps PER_LANG rows of each language in every task before it shuffles them
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = train.select("doc_id", "lang", F.row_number().over(w).alias("n")).where(F.col("n") <= PER_LANG).select("doc_id", "lang").distinct()
    some = train.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("lang", F.col("text").cast("string"))  # PER_LANG rows a language
    got = map_batches(some, _features, "lang string, x binary").orderBy("lang", F.xxhash64("x")).collect()
    return None if not got else Model([r["lang"] for r in got], np.stack([np.frombuffer(r["x"], np.float32) for r in got]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            letter = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, x in vectors(raw, off):
                top, score, far = m.predict(x)
                ok = letter[i:j]
                names = [m.langs[g] if o else "und" for g, o in zip(top, ok)]
                cols = [batch.column(0).slice(i, j - i), pa.array(names), pa.array(np.where(ok, score, 0).astype(float)), pa.array(far | ~ok)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "rejected"])

    return map_batches(rows, run, "doc_id long, lang_pred string, score double, rejected boolean")
