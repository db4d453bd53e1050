"""Set-similarity join on word shingles with token-combination prefixes.

Documents with equal shingle sets form one class at once; the classes' representatives
are joined. Tokens (shingle hashes) have one global order: rare before frequent. A set of
n tokens needs ceil(0.8 n) of them in any partner, so it must meet a partner within its
first n - ceil(0.8 n) + 1 tokens. Frequent tokens would make long lists, so the prefix is
extended: tokens fall into classes, the rare one indexed by single tokens, the frequent
ones (cut into groups by hash) by pairs of tokens of a group. A group that shows g tokens
in the prefix adds g - 1 to the length that is needed, not g, and every pair of sets above
the threshold still shares a token or a pair. Pairs met are verified exactly.

What is done in place of all pairs of a list: every set is verified against the list's pivot,
the member with the smallest share of tokens that no other set holds, and linked sets are
united. Members that no partner of the list can match leave it: two sets of m and n tokens
need an overlap of 4/9 (m + n), and neither can overlap in more tokens than it has in common
with any other set. Lists that still hold several components are decided by differences from pivots (see :mod:`refine`): no pairs of a list are
listed, so groups of copies and families of variants cost comparisons in proportion to their size.

Before that, sets without a possible partner leave: of the first 2p tokens by hash order
(p: the plain prefix length) at least about p must occur in another set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import refine
from .common import LOWER, Words, chunks, discard, map_batches, mix, signed, text_buffers, window_rows, windows, written
from .components import components

#: Occurrences among the sets from which a token counts as frequent.
FREQUENT = 24
#: Frequent tokens that a group is meant to show in a prefix.
GROUP = 6

def need(n, p: int = 4, q: int = 5):
    """Least overlap of a set of n tokens with any partner: ceil(n * p / q)."""
    return -(-n * p // q)


def _sets(shingle: int, what: str):
    """Each text's distinct shingles, ascending by hash, as rows of doc_id, n, k1, k2 (hashes of the set)
    and tokens: none ("keys"), the first 2p - 1 ("head") or all of them ("all")."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            raw, off = text_buffers(batch.column(1))
            for i, j in chunks(off):
                w = Words(raw, off, i, j, fold=LOWER)
                n_words = np.diff(w.off)
                starts, row = window_rows(w.off, shingle)
                h = windows(w.h, shingle)[starts] if len(starts) else np.zeros(0, np.uint64)
                short = np.flatnonzero((n_words > 0) & (n_words < shingle))
                if len(short):
                    more = [mix(windows(w.h[w.off[d] : w.off[d + 1]], int(n_words[d])) ^ np.uint64(n_words[d]))[0] for d in short]
                    h, row = np.append(h, np.array(more, np.uint64)), np.append(row, short)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[first], row[first]
                at = np.searchsorted(row, np.arange(j - i + 1))
                sums = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(mix(h + np.uint64(1)), out=sums[0, 1:])
                np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
                k = sums[:, at[1:]] - sums[:, at[:-1]]
                n = np.diff(at)
                cols = [ids.slice(i, j - i), pa.array(n), pa.array(signed(k[0])), pa.array(signed(k[1]))]
                if what != "keys":
                    if what == "head":
                        front = np.maximum(2 * (n - need(n) + 1) - 1, 0)
                        nth = np.arange(len(h)) - np.repeat(at[:-1], n)
                        h = h[nth < np.repeat(front, n)]
                        at = np.concatenate([[0], np.cumsum(np.minimum(front, n))])
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signed(h))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "k1", "k2", "tokens"][: len(cols)])

    return run


def _level(n: np.ndarray) -> np.ndarray:
    """Size level: partners (sizes within 4/5) are at the same or neighbouring levels."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.25) + 1e-9).astype(np.int64)


def _pairs_at(level: int) -> int:
    """Groups that the frequent tokens of sets of a level are cut into."""
    return max(1, int(0.2 * 1.25**level / GROUP))


def _signatures(tokens: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Signatures of one set of n tokens under its own size level and the next one, from the tokens that other
    sets hold; those that none does come first in the order and take up their share of the prefix."""
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    goal = len(tokens) - need(n) + 1
    rare = int(np.searchsorted(counts, FREQUENT))
    base = int(_level(np.array([n]))[0])
    out = [tokens[: max(0, min(rare, goal))]]
    left = goal - rare
    for level in (base, base + 1) if left > 0 and n > 1 else ():
        common, tag = tokens[rare:], np.uint64(level + 1)
        g = (mix(common) % np.uint64(_pairs_at(level))).astype(np.int64)
        by = np.argsort(g, kind="stable")
        later = np.empty(len(g), bool)  # not the first of its group
        later[by] = np.concatenate([[False], g[by][1:] == g[by][:-1]])
        reach = int(np.searchsorted(np.cumsum(later), left)) + 1
        part, pg = common[:reach], g[:reach]
        by = np.lexsort((part, pg))
        part, pg = part[by], pg[by]
        for step in range(1, len(part)):
            same = pg[step:] == pg[:-step]
            if not same.any():
                break
            a, b = part[:-step][same], part[step:][same]
            out.append(mix(mix(a) + b * np.uint64(0x9E3779B97F4A7C15) + tag))
    return np.unique(np.concatenate(out))


def _signed_rows(batches):
    """(s, doc_id, k1, n, held) of sets of n tokens, given those that others hold, and how often."""
    for batch in batches:
        ids, k1, n = (batch.column(k).to_numpy() for k in (0, 1, 2))
        rows: list[tuple[np.ndarray, int]] = []
        size = 0

        def out(rows):
            many = [len(s) for s, _ in rows]
            k = np.repeat([k for _, k in rows], many)
            held = np.repeat([len(batch.column(3)[int(k)]) for _, k in rows], many)
            return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([s for s, _ in rows]))), *[pa.array(c) for c in (ids[k], k1[k], n[k], held)]], names=["s", "doc_id", "k1", "n", "held"])

        for d in range(len(ids)):
            tokens, counts = (batch.column(k)[d].values.to_numpy(zero_copy_only=False) for k in (3, 4))
            rows.append((_signatures(tokens.view(np.uint64), counts, int(n[d])), d))
            size += len(rows[-1][0])
            if size > 50_000:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)


def _pairs(batch):
    """Token arrays of each row's two sets."""
    for x, y in zip(batch.column("x"), batch.column("y")):
        yield tuple(v.values.to_numpy(zero_copy_only=False) for v in (x, y))


def _alike(p: int, q: int):
    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            inter = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in _pairs(batch)], np.int64)
            mask = pa.array(q * inter >= p * (n - inter), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, live: DataFrame, p: int, q: int) -> DataFrame:
    x = live.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("x"))
    y = live.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "x", "y")
    return map_batches(both, _alike(p, q), "a long, b long")


def _possible(p: int, q: int, *names: str) -> str:
    """Whether two sets, by names of their sizes and of their tokens held by others, can have similarity p/q."""
    na, ha, nb, hb = names
    return f"least({na}, {nb}) * {q} >= greatest({na}, {nb}) * {p} AND ({na} + {nb}) * {p} <= {p + q} * least({ha}, {hb})"


def links(docs: DataFrame, shingle: int = 5, p: int = 4, q: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep) for each row, rep being the least doc_id of an equal set, and links (a, b) of
    representatives that give the components of all links. Similarity p/q must be 4/5 or more."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keys = written(map_batches(rows, _sets(shingle, "keys"), "doc_id long, n long, k1 long, k2 long"), "keys")
    reps = keys.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    reps = written(reps, "reps")
    member = written(keys.join(reps, ["k1", "k2", "n"], "left").select("doc_id", "n", "rep"), "member")
    discard(keys)
    live = _live(rows, reps, shingle, p, q)
    discard(reps)
    live, sig = _lists(live, p, q)
    found = _star(sig, live, p, q)
    open_ = _open(sig, found, p, q)
    key = F.struct(F.col("doc_id").alias("d"), F.col("k1").alias("k")).alias("id")
    of = open_.groupBy("s").agg(F.min(F.struct("n", key, "root")).alias("v"))
    cells = open_.select("s", key, F.col("root").alias("r")).join(of, "s").where("id <> v.id").select(F.col("v.id").alias("pivot"), "id", "r", F.col("v.root").alias("rp"))
    rest = refine.links(cells, live.select(key, "n", F.col("tokens").alias("v")), p, q)
    rest = written(rest.select(F.col("a.d").alias("a"), F.col("b.d").alias("b")).distinct(), "rest")
    for x in (open_, sig, live):
        discard(x)
    # a doc_id of several rows with different sets is one document
    each = member.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    same = member.join(each.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).where("a < b")
    return member, found.unionByName(rest).unionByName(same)


def _live(rows: DataFrame, reps: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """(doc_id, k1, n, tokens) of one row for each set that may have a partner."""
    head = map_batches(rows.where("text IS NOT NULL AND doc_id IS NOT NULL"), _sets(shingle, "head"), "doc_id long, n long, k1 long, k2 long, tokens array<long>")
    # hashed twice: the tokens' table would be as large as their shuffle
    each = head.select("k1", F.explode("tokens").alias("t"))
    twice = each.groupBy("t").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("t")
    twice = written(twice, "twice")
    # tables that grow with the input are merged, never broadcast
    n_shared = each.join(twice.hint("merge"), "t", "left_semi").distinct().groupBy("k1").agg(F.count("*").alias("c"))
    # a partner may be as small as need(n), whose own head guarantees p(need(n)) shared tokens
    least = F.ceil(F.col("n") * p / q).cast("long")
    least = least - F.ceil(least * p / q).cast("long") + 1
    ids = written(reps.join(n_shared, "k1").where(F.col("c") >= least).select(F.col("rep").alias("doc_id"), "k1", "k2"), "possible")
    discard(twice)
    some = rows.where("text IS NOT NULL").join(ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    live = map_batches(some, _sets(shingle, "all"), "doc_id long, n long, k1 long, k2 long, tokens array<long>")
    live = live.join(ids.hint("merge"), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    live = written(live.select("doc_id", "k1", "n", "tokens"), "live")
    discard(ids)
    return live


def _lists(live: DataFrame, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """The sets that may have a partner, as (doc_id, k1, n, tokens), with only the tokens that others hold; and (s, doc_id, k1, n, held):
    the signatures that more than one set shows."""
    each = live.select("doc_id", "k1", F.explode("tokens").alias("t"))
    count = each.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    known = each.join(written(count, "counts").hint("merge"), "t").groupBy("doc_id", "k1").agg(F.sort_array(F.collect_list(F.struct("t", "c"))).alias("tc"))
    known = live.select("doc_id", "k1", "n").join(known, ["doc_id", "k1"]).where(F.size("tc") * q >= F.col("n") * p)
    known = written(known.select("doc_id", "k1", "n", F.col("tc.t").alias("tokens"), F.col("tc.c").alias("c")), "held")
    discard(live)
    all_ = written(map_batches(known.select("doc_id", "k1", "n", "tokens", "c"), _signed_rows, "s long, doc_id long, k1 long, n long, held long"), "signatures")
    lists = all_.groupBy("s").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("s")
    sig = written(all_.join(lists, "s", "left_semi"), "lists")
    discard(all_)
    return known, sig


def _star(members: DataFrame, live: DataFrame, p: int, q: int) -> DataFrame:
    """Verified links between each list's pivot, the member with the smallest share of tokens of its own, and its members."""
    pivot = F.min(F.struct((1 - F.col("held") / F.col("n")).alias("first"), "doc_id", "n", "held")).alias("v")
    pairs = members.join(members.groupBy("s").agg(pivot), "s").where("doc_id <> v.doc_id AND " + _possible(p, q, "n", "held", "v.n", "v.held"))
    pairs = written(pairs.select(F.least("doc_id", "v.doc_id").alias("a"), F.greatest("doc_id", "v.doc_id").alias("b")).distinct(), "star")
    found = written(_verified(pairs, live, p, q).distinct(), "links")
    discard(pairs)
    return found


def _open(sig: DataFrame, found: DataFrame, p: int, q: int) -> DataFrame:
    """The lists that still hold several components, as (s, doc_id, k1, n, held, root), without the members that no
    partner there can match."""
    comp = components(found)
    named = sig.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    of = named.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least")).where("lo < hi")
    able = f"(n + greatest(least, ceil(n * {p} / {q}))) * {p} <= {p + q} * held"
    some = written(named.join(of.select("s", "least"), "s").where(able).select("s", "doc_id", "k1", "n", "held", "root"), "able")
    of = some.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s")
    open_ = written(some.join(of, "s", "left_semi"), "open")
    for x in (comp, some):
        discard(x)
    return open_


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: component_id is the least doc_id reachable by links.

    Two documents link when their shingle sets have Jaccard similarity 0.8 or more. Null and
    wordless texts have the empty set and link with nothing; a null doc_id links with nothing and
    has a null component; repeated rows of one doc_id are one document, which has the links of all
    their texts (n_shingles is each row's own).
    """
    member, found = links(docs, shingle)
    comp = components(found)
    of = member.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    of = of.join(comp.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    out = member.select("doc_id", "n").join(of, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without the rows whose component holds a smaller doc_id; of repeated rows of one doc_id all
    stay, as do rows without doc_id. All columns stay."""
    gone = near_duplicates(docs, shingle).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
