"""Graph operators on edge tables: roots of chains, ancestors by distance, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def climbs(nodes: DataFrame) -> DataFrame:
    """node, root, depth of those nodes of (node, parent) whose parent is a node, too; on or below a cycle they are null. All others are roots themselves.

    Pointers are doubled. Roots never enter the rounds: what points to one is known from the start. Only what is still open is looked up again and written; a round that
    settles nothing leaves only cycles, as a chain has nodes at every distance from its root, so rounds grow with the logarithm of the longest chain, not of the table.
    """
    scratch = Scratch(nodes.sparkSession, "chains")
    live = scratch.table(nodes.where("parent IS NOT NULL").join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("up")))
    inner = live.select(F.col("node").alias("up"), F.lit(True).alias("inner"))
    now = scratch.table(live.join(inner, "up", "left").select("node", "up", F.col("inner").isNull().alias("done"), F.lit(1).cast("long").alias("depth")))
    settled, waiting = _doubled(now, scratch, F.col("depth") + F.col("depth2"), "depth")
    return settled.select("node", F.col("up").alias("root"), "depth").unionByName(waiting.select("node", F.lit(None).cast(now.schema["up"].dataType).alias("root"), F.lit(None).cast("long").alias("depth")))


def _doubled(now: DataFrame, scratch: Scratch, joined, column: str) -> tuple[DataFrame, DataFrame]:
    """What came to its end and what goes round, of (node, up, done: up is a root, ``column``: of the way up to there); joined says how two ways are put together."""
    settled, waiting = now.where("done"), now.where("NOT done")
    left, before = waiting.count(), None
    while left and left != before:
        up = settled.unionByName(waiting).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("done").alias("done2"), F.col(column).alias(f"{column}2"))
        step = scratch.table(waiting.join(up, "up").select("node", F.col("up2").alias("up"), F.col("done2").alias("done"), joined.alias(column)))
        settled, waiting = settled.unionByName(step.where("done")), step.where("NOT done")
        left, before = waiting.count(), left
    return settled, waiting


def chain_roots(nodes: DataFrame) -> DataFrame:
    """node, root, depth of (node, parent): pointers are doubled, so a chain of n takes log n rounds.

    A parent that is no node ends the chain. Nodes on or below a cycle get a null root.
    """
    found = climbs(nodes)
    roots = nodes.select("node").distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))
    return found.unionByName(roots)


def path_digests(nodes: DataFrame) -> DataFrame:
    """node, digests of (node, parent, labels): for each label a digest of those from the node to its root, null where one is null.

    Pointers are doubled and the digests of what they pass over composed, so equal ways have equal digests, whatever tables they stand in. A way that goes round or leaves the nodes has
    none (nulls). Rounds are those of ``climbs``.
    """
    scratch = Scratch(nodes.sparkSession, "paths")
    none = lambda of: F.transform(of, lambda x: F.lit(None).cast("string"))
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.sha2(F.concat(x, y), 256))
    above = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"), F.when(F.col("parent").isNull(), F.col("labels")).otherwise(none("labels")).alias("ends"))
    begun = scratch.table(nodes.join(above, "parent", "left").select("node", "parent", "labels", "ends", F.col("known").isNotNull().alias("live")))
    live = begun.where("live").withColumnRenamed("parent", "up")
    inner = live.select(F.col("node").alias("up"), F.lit(True).alias("inner"))
    # Where the parent is a root, its own label ends the way: none if it leaves the nodes.
    now = live.join(inner, "up", "left").select("node", "up", F.col("inner").isNull().alias("done"), F.when(F.col("inner"), F.col("labels")).otherwise(joined("labels", "ends")).alias("digests"))
    settled, waiting = _doubled(scratch.table(now), scratch, joined("digests", "digests2"), "digests")
    roots = begun.where("NOT live").select("node", F.when(F.col("parent").isNull(), F.col("labels")).otherwise(none("labels")).alias("digests"))
    return roots.unionByName(settled.select("node", "digests")).unionByName(waiting.select("node", none("digests").alias("digests")))


def ancestors(nodes: DataFrame) -> DataFrame:
    """node, ancestor, distance: the closure of (node, parent), doubling the distance each round; cycles end at themselves."""
    settled = Scratch(nodes.sparkSession, "ancestors").table
    step = settled(nodes.where("parent IS NOT NULL AND parent != node").select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")))
    closure, reach = step, 1
    while True:
        longer = closure.where(F.col("distance") == reach).select("node", F.col("ancestor").alias("via"), "distance")
        more = longer.join(closure.select(F.col("node").alias("via"), "ancestor", F.col("distance").alias("d")), "via").where("node != ancestor").select("node", "ancestor", (F.col("distance") + F.col("d")).alias("distance"))
        more = settled(more)
        if more.isEmpty():
            return closure
        closure = settled(closure.unionByName(more).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        reach *= 2


def branch(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """node, leaf, distance: what lies on the way from each leaf (node) to its root along (node, parent), itself included.

    Pointers of all nodes are doubled; from a leaf's way, known up to some distance, one join with them makes it twice as long, so
    a chain of n costs n rows a round and log n rounds, not its closure. A way stops where it would come back to its leaf.
    """
    settled = Scratch(nodes.sparkSession, "branch").table
    jump = settled(nodes.where("parent IS NOT NULL AND parent != node").select("node", F.col("parent").alias("up")))
    way = settled(leaves.select(F.col("node"), F.col("node").alias("leaf"), F.lit(0).cast("long").alias("distance")).distinct())
    reach = 1
    while not jump.isEmpty():
        more = way.join(jump, "node").where("up != leaf").select(F.col("up").alias("node"), "leaf", (F.col("distance") + reach).alias("distance"))
        longer = settled(way.unionByName(more).groupBy("node", "leaf").agg(F.min("distance").alias("distance")))
        if longer.count() == way.count():
            break
        way, reach = longer, reach * 2
        jump = settled(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").where("node != up2").select("node", F.col("up2").alias("up")))
    return way


def ways(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """``branch`` where no way goes round: nothing is met twice, so a round only writes what it adds, and nothing is grouped."""
    settled = Scratch(nodes.sparkSession, "ways").table
    jump = settled(nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("up")))
    way = settled(leaves.select(F.col("node"), F.col("node").alias("leaf"), F.lit(0).cast("long").alias("distance")).distinct())
    reach = 1
    while True:
        more = settled(way.join(jump, "node").select(F.col("up").alias("node"), "leaf", (F.col("distance") + reach).alias("distance")))
        if more.isEmpty():
            return way
        way, reach = way.unionByName(more), reach * 2
        jump = settled(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up")))


def _starred(pairs: DataFrame, scratch: Scratch, ties) -> DataFrame:
    """The ties of each pair u, v with m, the smallest of u and its neighbours; the minima are taken map-side first and written, so that Spark can split a hot u in the join."""
    least = scratch.table(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    tied = scratch.table(pairs.join(least, "u").select(F.explode(ties).alias("e")).select("e.*").where("u IS NOT NULL AND u != v").distinct())
    scratch.drop(least)
    return tied


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of (a long, b long), by alternating stars.

    Large star: each node's larger neighbours are tied to its smallest neighbour; small star: its smaller ones and itself
    are. Both keep what is connected, and the number of rounds grows with the logarithm of the size. Each round is a few
    tables in the shared folder; only a count and a sum of hashes come back to the driver, which stops when they stay.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    alone = edges.where("u = v").select(F.col("u").alias("node"))
    now, seen = scratch.table(edges.where("u != v").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ties = F.array(F.struct(F.when(F.col("v") > F.col("u"), F.col("v")).alias("u"), F.col("m").alias("v")), F.struct(F.when(F.col("m") < F.col("u"), F.col("u")).alias("u"), F.col("m").alias("v")))
        large = _starred(both, scratch, ties)
        ties = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        after = _starred(large, scratch, ties)
        scratch.drop(now, large)
        now = after
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return found.unionByName(alone.distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
