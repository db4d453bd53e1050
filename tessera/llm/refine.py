"""Exact links inside groups of sets, by their differences from a pivot; DataFrame functions only.

A group is known by its pivot, and every member is compared with that: they link, or i tokens are shared. What a member's set and
the pivot's do not share is the member's difference, and two members differ from each other just where their differences do. So
members of m and n tokens (i and j of them shared with the pivot's k) link if and only if their differences share at least
k - i - j + (m + n) * p / (p + q) tokens: all further work is on differences, which are short, and no set is read again.

Groups of at most ``SMALL`` members are decided pair by pair, which is in proportion to them. In larger ones a linked pair either
shares tokens outside the pivot, at least (p * max(n, m) - s) / (p + q) of them (s of the other one, below): then only these tokens, a member's
own ones, are looked at; or it needs none of them, which only members can that lie close to the pivot and have partners smaller than it:
those members, again pair by pair if they are few, are told apart by their whole differences. Tokens that only one member, or members known to
be linked, hold are shared with nobody that matters; members that have too few others left are done with: most copies with edits of
their own. The rest show the first of theirs, rare ones of the group first, as many as leave fewer than
they must share, and two that link both show one of them. Members that show a token form a list; those of at most ``SMALL``
members are decided pair by pair, the others are the groups of the next round, under their smallest members. A pair whose
differences need share nothing must hold a set smaller than the pivot, which only a first pivot can have; those members form one
more list.

So a group of m members costs m - 1 comparisons with its pivot and at most ``SMALL`` cheap ones for each shown token, however many
variants it has. What ``ROUNDS`` pivots have not divided are sets that lie closely below the similarity to each other in ways of
their own; their pairs that sizes and differences allow are all compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import components


#: Members of a group that are compared pair by pair.
SMALL = 64
#: Pivots that a pair may meet before it is compared itself.
ROUNDS = 5


def links(cells: DataFrame, sets: DataFrame, p: int, q: int, tokens: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """(a, b): links that, with what ``r`` and ``rp`` tell, connect all members of a group that links connect.

    cells: pivot, id, r and rp, labels of components that id and pivot are known to belong to. sets: id, v, and n where the
    set has more tokens than ``tokens(v)`` gives (those that no other set holds). Similarity p/q. After the first comparisons the labels
    are united over all groups.
    """
    found = []
    cells = written(cells.groupBy("pivot", "id").agg(F.min("r").alias("r"), F.min("rp").alias("rp")), "cells")
    for k in range(ROUNDS):
        whole = written(_compared(cells, sets, p, q, tokens), "compared")
        discard(cells)
        known = whole.drop("diff")
        found.append(written(known.where("linked").select(F.col("pivot").alias("a"), F.col("id").alias("b")), "links"))
        if k == 0:
            known = _united(known)
        open_ = written(_open(known, p, q).join(whole.select("pivot", "id", "diff"), ["pivot", "id"]), "open")
        for x in (known, whole):
            discard(x)
        many = open_.where(F.col("c") > SMALL)
        close = _close(many)
        found.append(written(_paired(open_.where(F.col("c") <= SMALL).unionByName(close.where(F.col("c") <= SMALL)), p, q), "links"))
        last = k == ROUNDS - 1
        large = written(_large(many, close.where(F.col("c") > SMALL), p, q), "large")
        lists = written(_lists(large), "lists")
        pairs = written(_pairs(lists, p, q, last), "pairs")
        found.append(written(_alike(pairs, many, p, q), "links"))
        cells = written(_groups(lists), "cells") if not last else None
        for x in (open_, pairs, large, lists):
            discard(x)
        if last or cells.isEmpty():
            break
    discard(cells)
    return reduce(DataFrame.unionByName, found)


def _united(known: DataFrame) -> DataFrame:
    """``known`` with one label for all that its links connect, in whatever groups they are."""
    comp = components(known.where("linked"), "r", "rp")
    label = lambda r: comp.select(F.col("node").alias(r), F.col("root").alias(f"_{r}"))
    both = known.join(label("r"), "r", "left").join(label("rp"), "rp", "left")
    new = {r: F.coalesce(f"_{r}", r) for r in ("r", "rp")}
    out = written(both.withColumns(new).drop("_r", "_rp").select(*known.columns), "united")
    discard(comp)
    return out


def _compared(cells: DataFrame, sets: DataFrame, p: int, q: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """(pivot, id, r, rp, n, hp, s, w, linked, d, o, diff): diff, the d tokens of one of the two sets only, first o of the member's; with hp
    tokens of the pivot, h of the member and i of both, s is (p + q) * i - p * n and w is (p + q) * h - 2 * p * n."""
    own = ["n"] if "n" in sets.columns else []
    size = F.col("n") if own else F.size("x")
    pivots = sets.join(cells.select(F.col("pivot").alias("id")).distinct(), "id", "left_semi").withColumn("x", tokens(F.col("v")))
    pivots = pivots.select(F.col("id").alias("pivot"), size.cast("long").alias("np"), "x")
    both = cells.join(sets.select("id", "v", *own), "id").join(pivots, "pivot")
    both = both.select("pivot", "id", "r", "rp", "np", "x", *own, tokens(F.col("v")).alias("y"))
    n = F.col("n") if own else F.size("y")
    both = both.select("pivot", "id", "r", "rp", "np", n.cast("long").alias("n"), F.size("y").cast("long").alias("h"), F.size("x").cast("long").alias("hp"), F.array_except("y", "x").alias("out"), F.array_except("x", "y").alias("lack"))
    both = both.withColumn("i", F.col("h") - F.size("out"))
    s, w = (p + q) * F.col("i") - p * F.col("n"), (p + q) * F.col("h") - 2 * p * F.col("n")
    return both.select("pivot", "id", "r", "rp", "n", "hp", s.alias("s"), w.alias("w"), (s >= p * F.col("np")).alias("linked"), (F.size("out") + F.size("lack")).alias("d"), F.size("out").alias("o"), F.concat("out", "lack").alias("diff"))


def _open(known: DataFrame, p: int, q: int) -> DataFrame:
    """(pivot, id, n, r, rp, hp, s, o, need, own, c): the members of groups of several components that may have a partner there; c
    members of a group, need, the least number of tokens that a member's difference shares with a partner's, and own, how many of
    these lie outside the pivot at least."""
    joined = known.where("linked").select("pivot", "r", F.lit(True).alias("u")).distinct()
    named = known.join(joined, ["pivot", "r"], "left").withColumn("r", F.when(F.col("u"), F.col("rp")).otherwise(F.col("r")))
    stray = F.col("r") != F.col("rp")
    s1, s2 = F.max("s").alias("s1"), F.max(F.when(stray, F.col("s"))).alias("s2")
    # of two members that lie apart one at least is not in the pivot's component
    partner = F.when(stray, F.col("s1")).otherwise(F.col("s2"))
    of = named.groupBy("pivot").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), s1, s2, F.max("n").alias("n1"), F.max("w").alias("w1")).where("r0 < r1")
    by_pivot = (p + q) * F.col("hp") - F.col("s") - partner
    # and differences of much different sizes cannot be alike
    by_size = (p + q) * F.col("d") - F.col("w") - F.least("w1", (q - p) * F.least("n1", F.floor(F.col("n") * q / p)))
    some = named.join(of, "pivot").withColumn("need", F.ceil(F.greatest(by_pivot, by_size) / (p + q)))
    some = some.where(F.col("need") <= F.col("d")).select("pivot", "id", "n", "r", "rp", "hp", "s", "o", "need")
    of = some.groupBy("pivot").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), s1, s2, F.min("n").alias("n0"), F.count("*").alias("c")).where("r0 < r1")
    # what two members share of the pivot is at most what either does
    own = F.greatest(p * F.greatest("n0", F.ceil(F.col("n") * p / q)) - F.col("s"), p * F.col("n") - partner)
    return some.join(of, "pivot").select(*some.columns, F.ceil(own / (p + q)).alias("own"), "c")


def _close(many: DataFrame) -> DataFrame:
    """The members that may link without a common token outside the pivot; c of a group, of several components."""
    some = many.where("own <= 0")
    of = some.groupBy("pivot").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.count("*").alias("c")).where("r0 < r1")
    return some.drop("c").join(of.select("pivot", "c"), "pivot")


def _sides(x: DataFrame, y: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """Two sides of pairs: the first holds members outside the pivot's component only."""
    side = lambda x, c: x.select("pivot", *cols, *[F.col(k).alias(k + c) for k in x.columns if k not in ("pivot", *cols)])
    return side(x.where("r <> rp"), "a"), side(y, "b")


#: How many tokens two differences share.
_COMMON = "size(array_intersect(diffa, diffb))"


def _apart(p: int, q: int) -> str:
    """Whether two members lie in different components and have sizes that can link; each pair once."""
    return f"ra <> rb AND (rb = rpb OR ida < idb) AND least(na, nb) * {q} >= greatest(na, nb) * {p}"


def _near(p: int, q: int, shared: str) -> str:
    """Whether members link whose differences share so many tokens."""
    return f"{p + q} * hpa - sa - sb <= {p + q} * {shared}"


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"))


def _paired(open_: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): the links within groups, by all their pairs."""
    a, b = _sides(open_, open_)
    near = f"{_apart(p, q)} AND {_near(p, q, 'least(size(diffa), size(diffb))')} AND {_near(p, q, _COMMON)}"
    return _ends(a.join(b, "pivot").where(near)).distinct()


def _large(many: DataFrame, close: DataFrame, p: int, q: int) -> DataFrame:
    """(pivot, kind, id, n, r, rp, hp, s, far, need, shared): members by the tokens (kind 2: of theirs outside the pivot, 1: of their
    differences) that members of other components hold as well, rare ones first. Two that are not far go by their differences only."""
    cols = ["pivot", "id", "n", "r", "rp", "hp", "s", "far"]
    many, close = many.withColumn("far", F.col("own") > 0), close.withColumn("far", F.lit(False))
    of = many.where("far").groupBy("pivot").agg(F.min("n").alias("n2"), F.max("s").alias("s2"))
    by_far = F.ceil(F.greatest(p * F.greatest("n2", F.ceil(F.col("n") * p / q)) - F.col("s"), p * F.col("n") - F.col("s2")) / (p + q))
    own = F.when(F.col("far"), F.col("own")).otherwise(F.greatest(by_far, F.lit(1)))
    outside = many.join(of, "pivot").select(*cols, F.lit(2).alias("kind"), own.alias("need"), F.slice("diff", F.lit(1), F.col("o")).alias("v"))
    all_ = outside.unionByName(close.select(*cols, F.lit(1).alias("kind"), "need", F.col("diff").alias("v"))).where(F.col("need") <= F.size("v"))
    each = all_.select("pivot", "kind", "id", "r", "far", F.explode("v").alias("t"))
    count = each.groupBy("pivot", "kind", "t").agg(F.count("*").alias("c"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.expr("max(far OR kind < 2)").alias("seen")).where("r0 < r1 AND seen").drop("r0", "r1", "seen")
    shared = each.join(count, ["pivot", "kind", "t"]).groupBy("pivot", "kind", "id").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).getField("t").alias("shared"))
    out = all_.drop("v").join(shared, ["pivot", "kind", "id"], "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<long>")))
    return out.where(F.col("need") <= F.size("shared"))


def _lists(large: DataFrame) -> DataFrame:
    """(pivot, kind, t, id, n, r, rp, hp, s, far, h, m, v): the members that show a token, or (kind 0) that need share none; m of a
    list, of several components, and v, the smallest of them."""
    cols = ["pivot", "id", "n", "r", "rp", "hp", "s", "far"]
    show = F.slice("shared", F.lit(1), (F.size("shared") - F.greatest("need", F.lit(1)) + 1).cast("int"))
    some = large.where(F.size("shared") > 0).select(*cols, F.size("shared").alias("h"), "kind", F.explode(show).alias("t"))
    none = large.where("need <= 0").select(*cols, F.lit(0).alias("h"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("t"))
    both = some.unionByName(none)
    of = both.groupBy("pivot", "kind", "t").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.count("*").alias("m"), F.min(F.struct("n", "id", "r")).alias("v"), F.expr("max(far OR kind < 2)").alias("seen"))
    return both.join(of.where("r0 < r1 AND seen").drop("r0", "r1", "seen"), ["pivot", "kind", "t"])


def _groups(lists: DataFrame) -> DataFrame:
    """The cells of the next round: long lists under their smallest members."""
    some = lists.where((F.col("m") > SMALL) & (F.col("id") != F.col("v.id")))
    return some.groupBy(F.col("v.id").alias("pivot"), "id").agg(F.min("r").alias("r"), F.min("v.r").alias("rp"))


def _pairs(lists: DataFrame, p: int, q: int, all_: bool) -> DataFrame:
    """(pivot, ida, idb): pairs of short lists, or of all, in different components, that sizes and tokens allow."""
    some = lists.where(F.lit(all_) | (F.col("m") <= SMALL)).drop("m", "v")
    a, b = _sides(some, some, "kind", "t")
    own = f"kind = 2 AND (fara OR farb) AND greatest({p} * nb - sa, {p} * na - sb) <= {p + q} * least(ha, hb)"
    by = f"{_apart(p, q)} AND ({own} OR kind < 2 AND {_near(p, q, 'least(ha, hb)')})"
    return a.join(b, ["pivot", "kind", "t"]).where(by).select("pivot", "ida", "idb").distinct()


def _alike(pairs: DataFrame, many: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): the pairs that link."""
    side = lambda c: many.select("pivot", *[F.col(k).alias(f"{k}{c}") for k in ("id", "s", "hp", "diff")])
    both = pairs.join(side("a"), ["pivot", "ida"]).join(side("b"), ["pivot", "idb"])
    return _ends(both.where(_near(p, q, _COMMON))).distinct()
