"""Connected components of an edge table by contraction in random order, each round settled in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, settle


def _rank(seed: int, node: Column) -> Column:
    """Nodes in an order that is another one each round, at first that of ids; ties of the hash go by id."""
    return F.struct((F.xxhash64(F.lit(seed), node) if seed else F.lit(0).cast("long")).alias("h"), node.alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, component): the smallest id that each linked node reaches.

    A round draws a random order (a hash of round and id), hangs each node on the first of its neighbours and itself, follows that pointer once more and joins what hangs together into one node. A node stays only if a node
    two pointers away leads to it; by the random order that is a fixed share of the nodes at most, in expectation, whatever the graph (about a quarter in a chain, of any order of ids), so rounds are logarithmic and all tables together a multiple of the first.
    Only the first round goes by ids instead: it joins any star about its smallest id at once, which is what buckets give, where random orders would take a round for each halving of its leaves. Each round costs the driver some broadcasts and jobs.
    Rounds end when no link is left; the pointers are then followed from the last round to the first, and each component named by its smallest id.
    Links of null are left out, repeated ones count once. An empty table gives an empty one.
    """
    links, tables, pointers = edges.where("a <> b").select("a", "b"), [], []
    while not links.isEmpty():
        seed = len(pointers)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_rank(seed, F.col("b"))).alias("p")).select(F.col("a").alias("node"), F.least(_rank(seed, F.col("a")), "p")["node"].alias("up"))
        up = settle(first)
        jump = settle(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up").select("node", F.col("upper").alias("next")))
        left = settle(
            links.join(jump.select(F.col("node").alias("a"), F.col("next").alias("x")), "a")
            .join(jump.select(F.col("node").alias("b"), F.col("next").alias("y")), "b")
            .where("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
            .distinct()
        )
        pointers.append(jump)
        forget(up, *tables)
        links, tables = left, [left]
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    root = pointers.pop()
    while pointers:
        earlier = pointers.pop()
        after = settle(earlier.join(root.select(F.col("node").alias("next"), F.col("next").alias("last")), "next", "left").select("node", F.coalesce("last", "next").alias("next")))
        forget(earlier, root)
        root = after
    names = root.groupBy("next").agg(F.min("node").alias("component"))
    out = settle(root.join(names, "next").select("node", "component"))
    forget(root, *tables)
    return out
