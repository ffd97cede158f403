"""Connected components of an edge table by alternating large-star and small-star.

Large-star joins every larger neighbour of a node to the node's least neighbour; small-star joins every smaller
neighbour, and the node itself, to the least one. Both steps keep connectivity; when the edges no longer change,
every node points to the least node of its component. A hub is a sum like any other key: the least neighbour is
aggregated before the shuffle, and the join that sends it back reads two written tables, so that adaptive
execution can split the hub's rows. Each step's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wattledger.llm.common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """edges (a, b) with a > b, each pair once."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    # from the view of the smaller end, every edge leads to a larger neighbour
    moved = edges.select(F.col("b").alias("a"), F.col("a").alias("far")).join(least, "a").select(F.col("far").alias("a"), F.col("m").alias("b"))
    out = _kept(moved.distinct(), scratch, "large")
    scratch.drop(least)
    return out


def _small_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    least = scratch.keep(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = _kept(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), scratch, "small")
    scratch.drop(least)
    return out


def _kept(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """The edges written, and their number and sum of hashes, observed while writing."""
    seen = Observation()
    out = scratch.keep(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")), name)
    return out, (seen.get["n"], seen.get["s"])


def star_rounds(edges: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """Edges (a, b), a > b, with the same components after ``most`` rounds of both steps, or until they stay as
    they are: then every a has one b, the least node of its component."""
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = _kept(pairs.distinct(), scratch, "edges")
    done = 0
    while before[0] and (most is None or done < most):
        large, middle = _large_star(now, scratch)
        # kept by large-star: no lower end has a smaller neighbour; with one lower end for each node, that is all
        if middle == before and large.select("a").distinct().count() == middle[0]:
            scratch.drop(large)
            break
        small, after = _small_star(large, scratch)
        scratch.drop(now, large)
        now, before, done = small, after, done + 1
    return now


def labels_of(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges from ``star_rounds``. Nodes with equal values are connected; after all
    rounds connected nodes have equal values."""
    up = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).distinct().join(up.select("node"), "node", "left_anti")
    return up.unionByName(roots.select("node", F.col("node").alias("component")))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node with an edge; component is the least node. ``edges``: columns a, b."""
    now = star_rounds(edges, scratch)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
