"""Embedding near-duplicates: exact cosine-threshold links by dual traversal of cover trees.

1. Equal vectors form one class (grouped by the vector itself); classes are aggregated before the shuffle.
2. Classes go to the nearest of at most ``CELLS`` centres, a net of a bounded sample; a cell above ``group_rows`` classes is
   dealt to several groups. A group becomes a cover tree of its unit vectors: the root covers all of them, every level
   halves the radius, a node's children are a net of its points that are further apart than the level's radius and include
   the node's own centre, and every node knows the radius that its points really have. Parts of up to ``SMALL``
   points are left as single points of their parent.
   Trees are written to the shared folder.
3. Pairs of cells, then pairs of their groups, are pruned by the distance of their centres and their covering radii.
   Each pair that is left (and every group with itself) is one walk through both trees, which its task reads from the
   shared folder. A pair of nodes further apart than the threshold distance and both radii is pruned; a pair whose
   farthest points are still within the threshold is linked as a whole; other pairs are replaced by pairs of children.
   Pairs of points are decided by their cosine in double precision.
4. A task returns one row per linked class: how many vectors it links to, and its representative in the task's
   own components. Rows are in proportion to the classes, however many pairs a group of near copies has. Counts are
   added, representatives joined by large-star and small-star.

Results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths do not link; equal vectors link (cosine 1); a repeated row counts once, rows of one id with
different vectors count as different vectors of the same id; a row with a null id is kept, has a null component
and links with nothing; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm.common import Blobs, Scratch
from wattledger.llm.components import connected_components
from wattledger.llm.vectors import blocks, matrix, usable

SLACK = 1e-7  # of bounds: a distance near zero is off by up to 3e-8, as the root of a rounding error
ROWS = 1024  # of a matrix of dot products at a time
CENTRES = 256  # candidates for centres whose dot products are taken at once
CELLS = 256  # centres that classes are dealt to
SAMPLE = 4096  # classes that the centres come from
WALKS = 4096  # tasks at most
SMALL = 8  # parts of so many points are single points of their parent: their own nodes cost more than they save
SINGLE = 1e-5  # above the error of a dot product of unit vectors in single precision


@dataclass
class Node:
    """Points a to b (in tree order), the first of them the centre: children with several points, and single points."""

    a: int
    b: int
    radius: float
    children: list[Node]
    single: np.ndarray


@dataclass
class CoverTree:
    order: np.ndarray  # position in the given rows
    unit: np.ndarray  # unit vectors in tree order
    short: np.ndarray  # the same in single precision
    root: Node


def _net(points: np.ndarray, least: float) -> list[np.ndarray]:
    """Parts of the points: each has the first point that no earlier part took, and what is within reach of it."""
    parts, left = [], np.arange(len(points))
    while len(left):
        dots = points[left] @ points[left[:CENTRES]].T
        free = np.ones(len(left), bool)
        for k in range(dots.shape[1]):
            if free[k]:
                near = free & (dots[:, k] >= least)
                near[k] = True
                free &= ~near
                parts.append(left[near])
        left = left[free]
    return parts


def build(unit: np.ndarray, leaf_rows: int = 1) -> CoverTree:
    order = np.arange(len(unit))

    def node(a: int, b: int, radius: float) -> Node:
        """Covers points a to b, the first of which is the centre, within ``radius``."""
        points = unit[order[a:b]]
        far = float(np.sqrt(np.maximum(0, 2 - 2 * (points @ points[0]))).max()) if b - a > 1 else 0.0
        if b - a <= leaf_rows or far == 0.0:
            return Node(a, b, far, [], np.arange(a, b))
        half = radius / 2
        while half >= far:  # levels at which the node is its own only child
            half /= 2
        parts = _net(points, 1 - half * half / 2)  # the dot product at the level's radius
        order[a:b] = order[a:b][np.concatenate(parts)]
        children, single, at = [], [], a
        for part in parts:
            if len(part) > leaf_rows:
                children.append(node(at, at + len(part), half))
            else:
                single += range(at, at + len(part))
            at += len(part)
        return Node(a, b, far, children, np.array(single, np.int64))

    root = node(0, len(unit), 2.0)
    unit = unit[order]
    return CoverTree(order, unit, unit.astype(np.float32), root)


class Forest:
    """Union-find over the rows of both trees, and the number of dot products taken."""

    def __init__(self, n: int):
        self.parent, self.products = list(range(n)), 0

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def dual(one: CoverTree, two: CoverTree, least: float, weight_one: np.ndarray, weight_two: np.ndarray) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Links between the trees' points: weights linked to each point, in tree order, and the joined points.

    The forest's rows are the points of the first tree, then, unless it is the same tree, those of the second.
    A tree walked with itself counts both directions, and no point with itself.
    """
    same = one is two
    t = float(np.sqrt(2 - 2 * least))
    sums_one, sums_two = np.zeros(len(one.unit), np.int64), np.zeros(len(two.unit), np.int64)
    total_one, total_two = np.concatenate([[0], np.cumsum(weight_one)]), np.concatenate([[0], np.cumsum(weight_two)])
    shift = 0 if same else len(one.unit)
    forest = Forest(len(one.unit) + (0 if same else len(two.unit)))

    def points(i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of single points that may link, decided in double precision."""
        good = np.einsum("ij,ij->i", one.unit[i], two.unit[j]) >= least
        if same:
            good &= i != j
        i, j = i[good], j[good]
        np.add.at(sums_one, i, weight_two[j])
        if not same:
            np.add.at(sums_two, j, weight_one[i])
        for x, y in zip(i.tolist(), j.tolist()):
            forest.join(x, shift + y)

    def whole(x: Node, y: Node) -> None:
        sums_one[x.a : x.b] += total_two[y.b] - total_two[y.a]
        if not same:
            sums_two[y.a : y.b] += total_one[x.b] - total_one[x.a]
        elif x.a == y.a:
            sums_one[x.a : x.b] -= weight_one[x.a : x.b]  # not with themselves
        for i in range(x.a, x.b):
            forest.join(x.a, i)
        for j in range(y.a, y.b):
            forest.join(x.a, shift + j)

    todo = [(one.root, two.root)]

    def wide(xs: list[Node], ys: list[Node]) -> None:
        """Pairs of nodes of which one at least has several points: prune, link as a whole, or go on."""
        if not xs or not ys:
            return
        forest.products += len(xs) * len(ys)
        dot = one.unit[[n.a for n in xs]] @ two.unit[[n.a for n in ys]].T
        radii = np.array([n.radius for n in xs])[:, None] + np.array([n.radius for n in ys])[None, :]
        reach = t + SLACK + radii
        for i, j in zip(*np.nonzero(dot >= 1 - reach * reach / 2)):
            if np.sqrt(max(0.0, 2 - 2 * dot[i, j])) + radii[i, j] <= t - SLACK:
                whole(xs[i], ys[j])
            else:
                todo.append((xs[i], ys[j]))

    while todo:
        x, y = todo.pop()
        # pairs of single points: their bound is the threshold itself
        for lo in range(0, len(x.single), ROWS):
            part = x.single[lo : lo + ROWS]
            forest.products += len(part) * len(y.single)
            i, j = np.nonzero(one.short[part] @ two.short[y.single].T >= least - SINGLE)
            if i.size:
                points(part[i], y.single[j])
        wide(x.children, y.children)
        if x.children and len(y.single):
            forest.products += _near(x.children, one, two, y.single, t, points)
        if y.children and len(x.single):
            forest.products += _near(y.children, two, one, x.single, t, lambda i, j: points(j, i))
    return sums_one, sums_two, forest


def _near(nodes: list[Node], tree: CoverTree, other: CoverTree, single: np.ndarray, t: float, found) -> int:
    """Walks nodes of a tree with single points of the other one; found gets the pairs of points that may link. The number
    of dot products taken."""
    products, todo = 0, [(nodes, single)]
    while todo:
        nodes, points = todo.pop()
        for lo in range(0, len(nodes), ROWS):
            part = nodes[lo : lo + ROWS]
            products += len(part) * len(points)
            reach = t + SLACK + np.array([n.radius for n in part])
            close = tree.short[[n.a for n in part]] @ other.short[points].T >= (1 - reach * reach / 2 - SINGLE)[:, None]
            for k in np.flatnonzero(close.any(axis=1)):
                node, near = part[k], points[close[k]]
                products += len(node.single) * len(near)
                i, j = np.nonzero(tree.short[node.single] @ other.short[near].T >= 1 - t * t / 2 - SINGLE)
                if i.size:
                    found(node.single[i], near[j])
                if node.children:
                    todo.append((node.children, near))
    return products


def _unit(vectors: pd.Series) -> np.ndarray:
    x = matrix(vectors)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres_of(unit: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` points, each the farthest one from those before it."""
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(most, len(unit)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, unit @ unit[far])
    return unit[chosen]


def _cells(classes: DataFrame, n_groups: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """classes (id, n, dim, v) with their cell and the distance to its centre; the centres of each length of vectors."""
    sample = classes.orderBy("hash", "id").limit(SAMPLE).select("dim", "v").toPandas()  # SAMPLE rows
    centres = {dim: centres_of(_unit(rows["v"]), min(CELLS, 2 * n_groups if n_groups > 1 else 1)) for dim, rows in sample.groupby("dim")}

    def run(frames):
        for pdf in frames:
            cell, far = np.zeros(len(pdf), np.int32), np.full(len(pdf), np.pi)
            for dim, at in pdf.groupby("dim").indices.items():
                if dim in centres:  # vectors of a length that the sample lacks are one cell without a bound
                    dots = _unit(pdf["v"].iloc[at]) @ centres[dim].T
                    cell[at], far[at] = dots.argmax(axis=1), np.sqrt(np.maximum(0, 2 - 2 * dots.max(axis=1)))
            yield pdf[["id", "n", "dim", "v"]].assign(cell=cell, far=far)

    kind = classes.schema["v"].dataType.simpleString()
    return classes.select("id", "n", "dim", "v").mapInPandas(run, f"id bigint, n bigint, dim int, v {kind}, cell int, far double"), centres


def _pairs_of_groups(groups: DataFrame, cells: DataFrame, centres: dict[int, np.ndarray], t: float) -> DataFrame:
    """dim, one, two: the names of the groups that may hold linked points of each other, one <= two.

    Cells (dim, cell, far: at most CELLS of a length) are compared on the driver, groups by an equi-join of the pairs of
    cells that are left.
    """
    spark = groups.sparkSession
    near = []
    for dim, rows in cells.toPandas().groupby("dim"):
        at = rows["cell"].to_numpy()
        reach = rows["far"].to_numpy()
        if dim in centres:
            apart = np.sqrt(np.maximum(0, 2 - 2 * centres[dim][at] @ centres[dim][at].T))
        else:
            apart = np.zeros((len(at), len(at)))
        i, j = np.nonzero(apart <= reach[:, None] + reach[None, :] + t + 2 * SLACK)
        near += [(int(dim), int(at[a]), int(at[b])) for a, b in zip(i, j)]
    pairs = spark.createDataFrame(near, "dim int, cell int, other int")
    right = groups.select("dim", F.col("cell").alias("other"), F.col("name").alias("two"), F.col("centre").alias("centre_two"), F.col("radius").alias("radius_two"))
    both = groups.join(pairs, ["dim", "cell"]).join(right, ["dim", "other"]).where(F.col("name") <= F.col("two"))
    dot = F.aggregate(F.zip_with("centre", "centre_two", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    close = apart <= F.col("radius") + F.col("radius_two") + F.lit(t + 2 * SLACK)
    return both.where(close | (F.col("name") == F.col("two"))).select("dim", F.col("name").alias("one"), "two")


def near_duplicates(
    spark: SparkSession, table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95, group_rows: int = 4096
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch, trees = Scratch(spark, "covertree"), Blobs(spark, "covertree-trees")
    v = F.col(vector)
    non_zero = F.exists(v, lambda x: x != 0)
    valid = usable(v) & non_zero & F.col(vec_id).isNotNull()
    rows = scratch.keep(
        table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(valid, v).alias("v"))
        .withColumn("hash", F.when(F.col("v").isNotNull(), F.xxhash64("v"))),
        "rows",
    )
    classes = scratch.keep(
        rows.where(F.col("v").isNotNull()).select("hash", "v", "vec_id").distinct()
        .groupBy("hash", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
        .withColumns({"dim": F.size("v"), "id": F.monotonically_increasing_id()}),
        "classes",
    )
    n_groups = blocks(classes.count(), group_rows)
    t = float(np.sqrt(2 - 2 * least))

    dealt_rows, centres = _cells(classes, n_groups)
    dealt_rows = scratch.keep(dealt_rows, "cells")
    cells = dealt_rows.groupBy("dim", "cell").agg(F.count("*").alias("size"), F.max("far").alias("far"))
    sizes = cells.select("dim", "cell", F.ceil(F.col("size") / group_rows).cast("int").alias("parts"))
    grouped = dealt_rows.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(_unit(pdf["v"]), SMALL)
        dim, cell, part = (int(pdf[c].iat[0]) for c in ("dim", "cell", "part"))
        name = f"{dim:08d}-{cell:04d}-{part:08d}"
        trees.put(name, pickle.dumps((tree, pdf["id"].to_numpy()[tree.order], pdf["n"].to_numpy()[tree.order])))
        return pd.DataFrame({"dim": [dim], "cell": [cell], "name": [name], "centre": [tree.unit[0].tolist()], "radius": [tree.root.radius]})

    planted = grouped.select("dim", "cell", "part", "id", "n", "v").groupBy("dim", "cell", "part")
    groups = scratch.keep(planted.applyInPandas(plant, "dim int, cell int, name string, centre array<double>, radius double"), "groups")
    pairs = scratch.keep(_pairs_of_groups(groups, cells.select("dim", "cell", "far"), centres, t), "pairs")

    def walk(batches):
        kept: dict[str, tuple] = {}

        def load(name: str) -> tuple:
            if name not in kept:
                if len(kept) > 1:
                    kept.clear()
                kept[name] = pickle.loads(trees.get(name))
            return kept[name]

        for batch in batches:
            for low, high in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
                one, nodes, n = load(low)
                two, nodes_two, n_two = load(high)
                sums, sums_two, forest = dual(one, two, least, n, n_two)
                if low != high:
                    nodes, sums = np.concatenate([nodes, nodes_two]), np.concatenate([sums, sums_two])
                at = np.flatnonzero(sums)
                root = nodes[[forest.find(i) for i in at.tolist()]] if len(at) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at], pa.int64()), pa.array(sums[at], pa.int64()), pa.array(root, pa.int64())], ["node", "links", "root"])

    # every pair is a task of its own as long as there are not too many of them; a row is a pair of names
    walks = pairs.repartition(max(1, min(WALKS, pairs.count())), F.xxhash64("one", "two"))
    found = scratch.keep(walks.mapInArrow(walk, "node bigint, links bigint, root bigint"), "found")
    scratch.drop(dealt_rows, pairs)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    labels = connected_components(edges, scratch)
    linked = labels.join(classes.select(F.col("id").alias("node"), "least_id"), "node")
    smallest = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_node = linked.join(smallest, "component").select("node", "component_id")
    full = classes.select("hash", "v", "least_id", "n", F.col("id").alias("node")).join(links, "node", "left").join(by_node, "node", "left").select(
        "hash", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")
    )
    full = scratch.keep(full, "full")
    scratch.drop(found)
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return rows.join(full, ["hash", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"),
    )
