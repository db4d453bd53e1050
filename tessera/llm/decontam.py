"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over ``SPAN`` consecutive tokens; the tokens at its ignored places
do not enter the hash, so a test passage is still met after some of its tokens were
substituted. Test hashes go to the workers in blocks of bounded size, every training
window is looked up, and each hit is verified: on its alignment, some stretch of the
test item must have at least ``min_match`` equal tokens and a share of ``identity`` or more. Every stretch is
considered: with weights that add up to nought at the share, a stretch is good if its running sum ends no lower than it
began, and for each end the first such beginning is found in the running minimum.

The masks meet every stretch that the verification can accept at 13 equal tokens and a share of 0.7, wherever it lies in
item and document (so also at more, or a higher share). A good stretch of 26 equal tokens and more holds a shorter good one
(one of two halves is good), so there are few lengths; a search over all patterns of these (in the tests) finds none whose windows
the masks all miss.

Tokens: lower-cased runs of letters, digits and non-ASCII characters. Defined results: a
null or empty text or item hits nothing; an item of less than ``min_match`` tokens is held
whole against its alignment and needs ``min_short`` equal tokens and a share of ``identity`` of
all its tokens (so of less than ``min_short`` tokens it never hits); repeated items hit each; rows of one
doc_id are looked at one by one, and a hit in any of them takes all of them out; a null doc_id is reported as null
and stays; of the good stretches of a pair the one with most equal tokens is reported, of these the shortest, then the last in the document; extra columns
stay, whatever their names; an empty table of documents or items gives no hits.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Words, chunks, map_batches, mix, powers, text_buffers, window_rows, windows

#: Fixed masks: 1 = the token counts. The two places that each ignores.
SPAN = 7
IGNORED = ((0, 1), (1, 2), (2, 5), (2, 6), (3, 5), (4, 5))
MASKS = tuple("".join("0" if i in places else "1" for i in range(SPAN)) for places in IGNORED)
#: What the masks are proved for: least equal tokens, and least share of them.
LEAST_MATCH, LEAST_SHARE = 13, 0.7
#: Test tokens that one broadcast block holds (8 bytes each, and a hash a token for each mask).
BLOCK_TOKENS = 500_000
_B = 0x9FB21C651E98DF25


def _seeds(h: np.ndarray) -> list[np.ndarray]:
    """For each mask, the hash of every span (may cross rows)."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return [np.zeros(0, np.uint64)] * len(MASKS)
    p, out = powers(_B, SPAN + 1), []
    part = [h[i : i + n] * p[i + 1] for i in range(SPAN)]
    full = sum(part[1:], part[0])
    for m, mask in enumerate(MASKS):
        s = full
        for i, c in enumerate(mask):
            if c == "0":
                s = s - part[i]
        out.append(mix(s ^ np.uint64(m + 1)))
    return out


def _tokens(col, i=0, j=None):
    raw, off = text_buffers(col)
    return Words(raw, off, i, len(off) - 1 if j is None else j, ALNUM, LOWER)


class Block:
    """Test items ready for lookup: a bitmap, sorted hashes, and where each stands."""

    def __init__(self, ids: list[int], h: np.ndarray, off: np.ndarray, min_match: int, identity: float, min_short: int):
        self.ids, self.h, self.off = ids, h, off
        starts, row = window_rows(off, SPAN)
        long = np.diff(off)[row] >= min_match
        starts, row = starts[long], row[long]
        seeds = _seeds(h)
        key = np.concatenate([s[starts] for s in seeds]) if len(starts) else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.at = key[order], np.tile(starts.astype(np.int32), len(MASKS))[order]
        self.row = np.tile(row.astype(np.int32), len(MASKS))[order]
        bits = min(26, max(22, (8 * len(key)).bit_length()))
        self.drop = np.uint64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[self.key >> self.drop] = True
        # an item that may differ in e places is cut into e + 1 runs, one of which must be unchanged
        runs: dict[int, list[tuple[int, int, int]]] = {}
        self.need = np.maximum(min_short, np.ceil(identity * np.diff(off))).astype(np.int64)
        for k, n in enumerate(np.diff(off).tolist()):
            if 0 < n < min_match and self.need[k] <= n:
                cut = [n * i // (n - int(self.need[k]) + 1) for i in range(n - int(self.need[k]) + 2)]
                for x, y in zip(cut, cut[1:]):
                    if y > x:
                        runs.setdefault(y - x, []).append((int(windows(h[off[k] + x : off[k] + y], y - x)[0]), k, x))
        self.runs = {}
        for n, found in runs.items():
            found.sort()
            self.runs[n] = np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found]), np.array([f[2] for f in found])


def _short_hits(block: Block, w: Words):
    """(row, item, equal tokens, start in row) of items shorter than min_match, wherever a run of them stands."""
    for n, (keys, items, at) in block.runs.items():
        starts, row = window_rows(w.off, n)
        h = windows(w.h, n)[starts] if len(starts) else np.zeros(0, np.uint64)
        lo, hi = (np.searchsorted(keys, h, side=x) for x in ("left", "right"))
        met = np.flatnonzero(lo < hi)
        total = np.cumsum((hi - lo)[met])
        for part in np.split(met, np.flatnonzero(np.diff(total // 1_000_000)) + 1):
            many = (hi - lo)[part]
            k = np.repeat(part, many)
            e = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + lo[k]
            item, d, first = items[e], row[k], starts[k] - at[e]
            size = np.diff(block.off)[item]
            same = np.zeros(len(k), np.int64)
            for j in range(int(size.max(initial=0))):
                x = first + j
                ok = (j < size) & (x >= w.off[d]) & (x < w.off[d + 1])
                same[ok] += w.h[x[ok]] == block.h[block.off[item[ok]] + j]
            good = same >= block.need[item]
            yield from zip(d[good].tolist(), item[good].tolist(), same[good].tolist(), (first - w.off[d])[good].tolist())


def _verified(doc: np.ndarray, item: np.ndarray, shift: int, min_match: int, identity: float) -> tuple[int, int, int] | None:
    """Of the stretches of item[k] against doc[k + shift] with enough equal tokens and share, that with most equal tokens, then
    the shortest, then the last: (equal tokens, -length, start in doc)."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[a:b] == doc[a + shift : b + shift]
    equal = np.concatenate([[0], np.cumsum(same)])
    if equal[-1] < min_match:
        return None
    share = Fraction(identity).limit_denominator(1000)
    s = share.denominator * equal - share.numerator * np.arange(len(equal))
    first = np.searchsorted(-np.minimum.accumulate(s), -s, side="left")  # of the beginnings of good stretches that end here
    gain = equal - equal[first]
    most = int(gain.max())
    if most < min_match:
        return None
    ends = np.flatnonzero(gain == most)
    at = np.flatnonzero(same)[equal[first[ends]]]  # unequal tokens in front do not count
    k = int(np.lexsort((-ends, ends - at))[0])
    return most, -int(ends[k] - at[k]), a + shift + int(at[k])


def _alignments(block: Block, w: Words, at_once: int = 1_000_000):
    """(row, item, shift) of all hits, each alignment once."""
    starts, row = window_rows(w.off, SPAN)
    found = np.zeros((0, 3), np.int64)
    for s in _seeds(w.h) if len(starts) else []:
        s = s[starts]
        near = np.flatnonzero(block.map[s >> block.drop])
        lo, hi = (np.searchsorted(block.key, s[near], side=x) for x in ("left", "right"))
        many = hi - lo
        for part in np.split(np.arange(len(near)), np.flatnonzero(np.diff(np.cumsum(many) // at_once)) + 1):
            k = np.repeat(part, many[part])
            e = np.arange(len(k)) - np.repeat(np.cumsum(many[part]) - many[part], many[part]) + lo[k]
            d, item = row[near[k]], block.row[e].astype(np.int64)
            shift = (starts[near[k]] - w.off[d]) - (block.at[e] - block.off[item])
            found = np.unique(np.concatenate([found, np.stack([d, item, shift], axis=1)]), axis=0)
    yield from found.tolist()


def _hits(block: Block, min_match: int, identity: float):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, off = text_buffers(batch.column(1))
            for i, j in chunks(off):
                w = Words(raw, off, i, j, ALNUM, LOWER)
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for d, item, shift in _alignments(block, w):
                    got = _verified(w.h[w.off[d] : w.off[d + 1]], block.h[block.off[item] : block.off[item + 1]], shift, min_match, identity)
                    if got:
                        best[d, item] = max(best.get((d, item), got), got)
                for d, item, same, at in _short_hits(block, w):
                    got = same, -int(block.off[item + 1] - block.off[item]), max(at, 0)
                    best[d, item] = max(best.get((d, item), got), got)
                if best:
                    rows = [(ids[d + i], block.ids[item], n, -length, at) for (d, item), (n, length, at) in sorted(best.items())]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "n_match", "n_span", "at"])

    return run


def _blocks(items: DataFrame, *limits):
    """Blocks of whole items, each of bounded size, streamed from the items' partitions."""
    ids, parts, tokens = [], [], 0
    for r in items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        h = _tokens(pa.array([r["text"].lower()])).h
        ids.append(r["item_id"])
        parts.append(h)
        tokens += len(h)
        if tokens >= BLOCK_TOKENS:
            yield Block(ids, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), *limits)
            ids, parts, tokens = [], [], 0
    if ids:
        yield Block(ids, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), *limits)


def contaminated(docs: DataFrame, items: DataFrame, min_match: int = 13, identity: float = 0.7, min_short: int = 8) -> DataFrame:
    """(doc_id, item_id, n_match, n_span, at): the best verified overlap of each pair met.

    docs: doc_id, text; items: item_id, text. ``at`` is the stretch's first token in the document.
    Items are matched in blocks, so any number of them works; documents are never shuffled.
    """
    if min_match < LEAST_MATCH or identity < LEAST_SHARE:
        raise ValueError(f"the masks are for {LEAST_MATCH} equal tokens or more and a share of {LEAST_SHARE} or more")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text"))
    out = None
    for block in _blocks(items, min_match, identity, min_short):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            return _hits(shared.value, min_match, identity)(batches)

        one = map_batches(rows, run, "doc_id long, item_id long, n_match int, n_span int, at int")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, n_match int, n_span int, at int")


def decontaminate(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """docs without the rows whose doc_id has a verified overlap; a null doc_id stays."""
    bad = contaminated(docs, items, **limits).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
