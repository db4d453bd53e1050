"""Closures over edge tables: by depth, in one join a level, and whole ones by chains, in rounds that grow with the logarithm of a
chain's length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import discard, written

#: Positions of a chain that share a join key, so that a long chain is no key of its own.
BLOCK = 4096


def closure(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node, depth): nodes reachable from each root (itself at depth 0), each at its least depth.

    edges: src, dst. Each round joins only the newest nodes and leaves those already known; there are as many rounds as
    levels, so it suits shallow graphs and limited depths. :func:`reach` takes deep ones.
    """
    step = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    seen, k = step, 0
    while depth is None or k < depth:
        k += 1
        new = step.join(edges, step["node"] == edges["src"]).select("root", F.col("dst").alias("node"), F.lit(k).alias("depth")).distinct()
        step = written(new.join(seen.select("root", "node"), ["root", "node"], "left_anti"), "level")
        if step.isEmpty():
            break
        seen = seen.unionByName(step)
    return seen


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes as (node, chain, pos) and the edges between chains as (chain, pos, to_chain, to_pos).

    Every node names one successor (of the least ``rank`` if edges have that column, else the least node), every node
    accepts one of those that name it, and the accepted edges form chains. A chain is called by its last node, and pos is the
    distance to that. Positions are found by pointer doubling: each round a node takes over the pointer of the node it points
    to, so a chain of n nodes needs log2(n) rounds of one join. Nodes whose pointer has come to the end take no part any
    more, and no two others point to the same node, so no key of these joins is hot. A cycle never comes to an end; its nodes
    become chains of one.
    """
    first = F.struct("rank", "dst") if "rank" in edges.columns else F.struct("dst")
    pairs = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.min(first).alias("first")), "edges")
    named = pairs.where(pairs["src"] != pairs["dst"]).groupBy("src").agg(F.min("first").alias("first")).select("src", F.col("first.dst").alias("dst"))
    links = named.groupBy("dst").agg(F.max("src").alias("src"))
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    at = ends.join(links.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node", "left")
    done = F.col("next").isNull()
    at = written(at.select("node", F.coalesce("next", "node").alias("to"), F.when(done, 0).otherwise(1).cast("long").alias("pos"), done.alias("done")), "pointers")
    rounds, most = 0, at.count().bit_length() + 1
    while rounds < most and not (active := at.where("NOT done")).isEmpty():
        further = at.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("pos").alias("more"), F.col("done").alias("ended"))
        jumped = active.drop("done").join(further, "to").select("node", F.col("beyond").alias("to"), (F.col("pos") + F.col("more")).alias("pos"), F.col("ended").alias("done"))
        new = written(at.where("done").unionByName(jumped), "pointers")
        discard(at)
        at, rounds = new, rounds + 1
    nodes = at.select("node", F.when(F.col("done"), F.col("to")).otherwise(F.col("node")).alias("chain"), F.when(F.col("done"), F.col("pos")).otherwise(0).alias("pos"))
    nodes._rounds = rounds
    of = lambda p, c: nodes.select(F.col("node").alias(c), F.col("chain").alias(f"{p}chain"), F.col("pos").alias(f"{p}pos"))
    crossing = pairs.select("src", "dst").join(of("", "src"), "src").join(of("to_", "dst"), "dst")
    crossing = crossing.where((F.col("chain") != F.col("to_chain")) | (F.col("to_pos") > F.col("pos")))
    return nodes, written(crossing.groupBy("chain", "pos", "to_chain").agg(F.max("to_pos").alias("to_pos")), "crossing")


def _blocks(low, high):
    return F.explode(F.sequence(F.expr(f"{low} div {BLOCK}"), F.expr(f"{high} div {BLOCK}"))).alias("block")


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): the nodes that each root reaches, itself included, also if it has no edge.

    edges: src, dst, and rank where edges of a node have an order. What a root reaches of a chain is all from some
    place to the chain's end, so it is kept as one place for each (root, chain), however long the chain. A round takes the
    edges that leave newly reached stretches; there are as many rounds as chains lie behind one another, not levels.
    """
    nodes, crossing = chains(edges)
    crossing = crossing.withColumn("block", F.expr(f"pos div {BLOCK}"))
    start = roots.select("root").distinct().join(nodes, F.col("root") == F.col("node"))
    new = written(start.select("root", "chain", F.lit(-1).cast("long").alias("known"), "pos"), "reached")
    best = new.select("root", "chain", "pos")
    while True:
        stretch = new.select("root", "chain", "known", F.col("pos").alias("to"), _blocks("known + 1", "pos"))
        left = stretch.join(crossing, ["chain", "block"]).where("pos > known AND pos <= to").groupBy("root", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("pos"))
        had = best.withColumnRenamed("pos", "known")
        more = left.join(had, ["root", "chain"], "left").select("root", "chain", F.coalesce("known", F.lit(-1)).alias("known"), "pos").where("pos > known")
        new = written(more, "reached")
        if new.isEmpty():
            break
        best = written(best.unionByName(new.select("root", "chain", "pos")).groupBy("root", "chain").agg(F.max("pos").alias("pos")), "best")
    all_of = best.select("root", "chain", F.col("pos").alias("to"), _blocks("0L", "pos"))
    found = all_of.join(nodes.withColumn("block", F.expr(f"pos div {BLOCK}")), ["chain", "block"]).where("pos <= to").select("root", "node")
    alone = roots.select("root").distinct().join(nodes.select(F.col("node").alias("root")), "root", "left_anti")
    return found.unionByName(alone.select("root", F.col("root").alias("node")))
