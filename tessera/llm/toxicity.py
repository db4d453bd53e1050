"""Toxicity by nearest labelled examples.

Examples are a bounded sample of labelled texts. Texts are vectors over every term of the
examples (words, and the beginnings of longer ones): (1 + log count) * idf * r, where idf comes
from all documents and r is the strength of the term's association with the label among the
examples (the absolute phi coefficient of their 2 x 2 table), so that function words do not decide who is near.
No term is left out. The index keeps postings for every term; those of frequent terms lie in blocks of
``BLOCK`` examples with the largest weight in each block. A query reads the postings of its rare terms, bounds
what frequent terms can add in every block by the block maxima, opens the blocks of the highest sums, and then all
others that may still hold one of the k nearest, so the neighbours by cosine are exact. Their labels vote with weights that fall with
distance, and an isotonic map, fitted on leave-one-out votes of the examples, turns the vote
into a calibrated score. Neighbours are reported as evidence.

Only the fit is bounded (``SAMPLE`` examples, first by hash of doc_id); document frequencies count
all documents, and every whole text is scored. A term that no example has adds to a text's length with
the idf of one document and the mean r of terms of one example. Defined results: a null, empty or unrelated text (no
term of an example) gets the share of toxic examples; with no labels
every score is 0; similarity ties go to the example that comes first by hash of doc_id; repeated rows are
scored alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Words, chunks, discard, map_batches, mix, signed, text_buffers, written

#: Bound of the fit: labelled texts.
SAMPLE = 4000
BLOCK, NEAREST = 64, 10
#: Blocks that are opened before the others' bounds are held against what was found.
FIRST = 6
#: A term is frequent if more than one in so many examples has it.
FREQUENT = 12
#: Weight of "no evidence" in a vote.
PRIOR = 0.0005
#: Beginnings of longer words, in bytes, that are terms too: they stand for inflected and compound forms.
BEGINNINGS = (3, 5, 7)
#: Texts that are scored at once, and terms of them at most (a longer text stands alone).
TEXTS, TERMS = 64, 30_000
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype=np.uint64)


def _rows(col):
    """(i, j, term hashes, terms before each row) of runs of texts: words and their beginnings."""
    raw, off = text_buffers(col)
    for i, j in chunks(off):
        w = Words(raw, off, i, j, ALNUM, LOWER)
        row = np.repeat(np.arange(j - i), np.diff(w.off))
        hashes, rows = [w.h], [row]
        for n in BEGINNINGS:
            long = np.flatnonzero(w.end - w.start > n)
            h = np.full(len(long), n, np.uint64)
            for k in range(n):
                h = (h + _BYTE[w.raw[w.start[long] + k]]) * np.uint64(0x9E3779B97F4A7C15)
            hashes.append(mix(h))
            rows.append(row[long])
        row = np.concatenate(rows)
        by = np.argsort(row, kind="stable")
        yield i, j, np.concatenate(hashes)[by], np.searchsorted(row[by], np.arange(j - i + 1))


def _terms(batches):
    for batch in batches:
        for i, j, h, at in _rows(batch.column(2)):
            for d in range(j - i):
                t, n = np.unique(h[at[d] : at[d + 1]], return_counts=True)
                cols = [batch.column(0).slice(i + d, 1), batch.column(1).slice(i + d, 1), pa.array([signed(t)], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "toxic", "terms", "counts"])


def _spread(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (many[0] of them), then the same for each further range."""
    at = np.cumsum(many) - many
    return np.arange(int(many.sum())) - np.repeat(at - start, many)


class Index:
    """Labelled examples as postings in blocks. docs: each example's distinct terms and their counts."""

    def __init__(self, terms: np.ndarray, df: np.ndarray, n_docs: int, ids: list[int], labels: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]]):
        """terms: all terms of docs, ascending, with their document frequencies df among n_docs documents."""
        self.terms, y = terms, labels.astype(float)
        n, pos = len(docs), float(y.sum())
        self.zero = (pos + 0.1) / (n + 2)
        places = [np.searchsorted(terms, t).astype(np.int32) for t, _ in docs]
        c, a = np.zeros(len(terms)), np.zeros(len(terms))
        for x, toxic in zip(places, y):  # the terms of one text are distinct
            c[x] += 1
            a[x] += toxic
        r = np.abs(a * n - c * pos) / np.sqrt(np.maximum(pos * (n - pos) * c * (n - c), 1e-9))
        self.weight = (np.log((n_docs + 1) / (df + 1)) + 1) * r
        self.other = (np.log((n_docs + 1) / 2) + 1) * float(r[c == 1].mean() if (c == 1).any() else r.mean() if len(r) else 0)
        vec = [self._weights(x, m, np.zeros(0)) for x, (_, m) in zip(places, docs)]
        # like examples share blocks, so block maxima are tight
        order = sorted(range(n), key=lambda k: (tuple(places[k][np.argsort(-vec[k], kind="stable")][:3].tolist()), k))
        self.ids, self.y, self.rank = [ids[k] for k in order], y[order], np.array(order, np.int64)
        self.n, self.blocks = n, -(-n // BLOCK)
        ex = np.repeat(np.arange(n), [len(places[k]) for k in order])
        t, w = np.concatenate([places[k] for k in order]), np.concatenate([vec[k] for k in order])
        by = np.argsort(t, kind="stable")
        t, self.ex, self.w = t[by], ex[by].astype(np.int32), w[by]
        self.first = np.searchsorted(t, np.arange(len(terms) + 1))
        # frequent terms: their postings as blocks of examples x terms, and the largest weight of each term in a block
        often = np.flatnonzero(c * FREQUENT > n)
        self.often = np.full(len(terms), -1)
        self.often[often] = np.arange(len(often))
        self.tiles = np.zeros((self.blocks * BLOCK, len(often)))
        some = self.often[t] >= 0
        self.tiles[self.ex[some], self.often[t[some]]] = self.w[some]
        self.top = self.tiles.reshape(self.blocks, BLOCK, len(often)).max(1).T
        del t, w, by, ex, some
        votes, few = np.zeros(n), TEXTS // 4  # the driver has less room than the workers
        for i in range(0, n, few):
            q = [(places[k], vec[k]) for k in order[i : i + few]]
            votes[i : i + len(q)] = self.votes(q, np.arange(i, i + len(q)))[0]
        self.x, self.p = _isotonic(votes, self.y)

    def _weights(self, place: np.ndarray, counts: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Weights of known terms, over the length of the whole vector; rest: the counts of the unknown ones."""
        w = (1 + np.log(counts)) * self.weight[place]
        return w / np.sqrt(max(float(w @ w) + self.other**2 * float(((1 + np.log(rest)) ** 2).sum()), 1e-300))

    def query(self, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a text's distinct terms with counts."""
        at = np.searchsorted(self.terms, t)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == t if len(self.terms) else np.zeros(len(t), bool)
        return at[known], self._weights(at[known], counts[known], counts[~known])

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, the places and cosines (above 0) of the NEAREST examples, exact; skip: a place each leaves out."""
        d, width = len(queries), self.blocks * BLOCK
        place, q = np.concatenate([x[0] for x in queries]), np.concatenate([x[1] for x in queries])
        doc = np.repeat(np.arange(d), [len(x[0]) for x in queries])
        dense = self.often[place]
        common = np.zeros((d, self.top.shape[0]))
        common[doc[dense >= 0], dense[dense >= 0]] = q[dense >= 0]
        doc, place, q = doc[dense < 0], place[dense < 0], q[dense < 0]
        many = self.first[place + 1] - self.first[place]
        at = _spread(self.first[place], many)
        key = np.repeat(doc * width, many) + self.ex[at]
        scores = np.bincount(key, weights=np.repeat(q, many) * self.w[at], minlength=d * width).astype(float).reshape(d, self.blocks, BLOCK)
        if skip is not None:
            scores.reshape(d, width)[np.arange(d), skip] = -np.inf
        bound = common @ self.top
        reach = scores.max(2) + bound
        shut = np.ones((d, self.blocks), bool)
        low = np.zeros((d, 1))
        for first in (True, False):
            # a block stays shut only if its bound is under what NEAREST examples have reached (with room for rounding)
            if first and self.blocks > FIRST:
                opened = reach >= np.partition(reach, self.blocks - FIRST, axis=1)[:, [self.blocks - FIRST]]
            else:
                opened = shut & (bound > 0) & (reach + 1e-9 >= low)
            for b in np.flatnonzero(opened.any(0)):
                who = np.flatnonzero(opened[:, b])
                scores[who, b] += common[who] @ self.tiles[b * BLOCK : (b + 1) * BLOCK].T
            shut &= ~opened
            if first and self.n > NEAREST:
                low = np.partition(scores.reshape(d, width), width - NEAREST, axis=1)[:, [width - NEAREST]]
        out = []
        for one in np.round(scores.reshape(d, width), 12):
            least = np.partition(one, width - NEAREST)[width - NEAREST] if width > NEAREST else 0
            at = np.flatnonzero((one >= least) & (one > 0))
            at = at[np.lexsort((self.rank[at], -one[at]))][:NEAREST]
            out.append((at, one[at]))
        return out

    def votes(self, queries, skip: np.ndarray | None = None) -> tuple[np.ndarray, list[list[int]]]:
        """Each query's share of toxic votes, and its three nearest examples."""
        raw, ids = np.zeros(len(queries)), []
        for k, (at, s) in enumerate(self.nearest(queries, skip)):
            w = np.clip(s, 0, 1) ** 3
            raw[k] = float((w * self.y[at]).sum() / (w.sum() + PRIOR))
            ids.append([self.ids[i] for i in at[:3]])
        return raw, ids

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[list[int]]]:
        """Score and evidence of texts given as distinct terms and counts."""
        queries = [self.query(*t) for t in texts]
        raw, ids = self.votes(queries)
        s = np.clip(0.98 * np.interp(raw, self.x, self.p) + 0.02 * raw, 0, 1)
        return np.where([bool(i) for i in ids], s, self.zero), ids


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots to interpolate between."""
    if not len(x):
        return np.array([0.0, 1.0]), np.array([0.0, 0.0])
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, n, s = pools.pop()
            u = pools[-1]
            pools[-1] = [(u[0] * u[1] + v * n) / (u[1] + n), u[1] + n, (u[2] * u[1] + s * n) / (u[1] + n)]
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


def _frequencies(terms):
    """Task's counts of the texts that hold each of the terms, and the number of texts (place -1)."""

    def run(batches):
        known = terms.value
        df, n = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for i, j, h, at in _rows(batch.column(0)):
                n += j - i
                place = np.searchsorted(known, h)
                place[place == len(known)] = 0
                ok = known[place] == h
                row = np.repeat(np.arange(j - i), np.diff(at))[ok]
                df += np.bincount(np.unique(row * len(known) + place[ok]) % len(known), minlength=len(known))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["place", "n"])

    return run


def fit(train: DataFrame, docs: DataFrame) -> Index | None:
    """Learn from labels (doc_id, toxic) of the texts of docs (doc_id, text)."""
    ids = train.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("toxic").cast("long"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE).dropDuplicates(["doc_id"])
    rows = docs.select(F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text"))
    some = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")  # SAMPLE rows
    some = written(map_batches(some, _terms, "doc_id long, toxic long, terms array<long>, counts array<long>"), "examples")
    # repeated rows of a doc_id may be more than SAMPLE
    got = some.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("terms", "counts")).limit(SAMPLE).toArrow()
    discard(some)
    if not got.num_rows:
        return None
    columns = [[x.values.to_numpy(zero_copy_only=False) for x in got[c]] for c in ("terms", "counts")]
    vec = [(t.view(np.uint64), n.astype(float)) for t, n in zip(*columns)]
    terms = np.unique(np.concatenate([t for t, _ in vec]))
    df, n_docs = np.zeros(len(terms)), docs.count()
    if len(terms):
        shared = docs.sparkSession.sparkContext.broadcast(terms)
        counts = map_batches(rows.select("text"), _frequencies(shared), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).where("place >= 0").toArrow()
        df[counts["place"].to_numpy()] = counts["n"].to_numpy()  # a number for each term of the sample
    return Index(terms, df, n_docs, got["doc_id"].to_pylist(), got["toxic"].to_numpy(), vec)


def score(docs: DataFrame, index: Index | None) -> DataFrame:
    """(doc_id, score, evidence array<long>) of every row (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text"))
    if index is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.array().cast("array<bigint>").alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        m = shared.value
        for batch in batches:
            for i, j, h, at in _rows(batch.column(1)):
                a = 0
                while a < j - i:
                    b = max(a + 1, min(a + TEXTS, int(np.searchsorted(at, at[a] + TERMS, side="right")) - 1))
                    s, evidence = m.scores([np.unique(h[at[d] : at[d + 1]], return_counts=True) for d in range(a, b)])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + a, b - a), pa.array(s), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])
                    a = b

    return map_batches(rows, run, "doc_id long, score double, evidence array<long>")
