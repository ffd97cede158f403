"""Exact top-k search by inner product with a KD-tree per shard.

The upper median splits come from a bounded sample and cut the table into cells, of which large ones are dealt to several
shards of about ``shard_rows`` vectors. A shard becomes a KD-tree: median splits along the widest side of the tight bounding
box, down to leaves of ``leaf_rows``. A box bounds the inner product of its points with a query from above, as do the
lengths of the query and of the box's longest point; the smaller bound counts. Trees, and lists of the shards' boxes, are
written to the shared folder. Queries come in blocks of ``query_rows``; one task takes a block through all shards, best bound
first, and the k-th score found so far decides which shards it reads and which leaves of a shard. A query's leaves
are visited best bound first until none can reach its k-th score; a leaf is compared with all queries that are at it.

Vectors are turned into integers floor(scale * x); scores are exact integers (sums beyond 2 ** 53 are computed
with Python's integers and held within the range of a long).

Results: vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take no
part; vectors of different lengths are not compared; an id with several rows counts once, with its least vector;
equal scores go to the smaller id; a query with fewer candidates gets them all; an empty table gives an empty
table; only the named columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm.common import Blobs, Scratch
from wattledger.llm.vectors import blocks, dealt, matrix, usable

EXACT = 2.0**53
LONG = 2**63 - 1


@dataclass
class KdTree:
    """Points in tree order; node k has children 2k + 1 and 2k + 2 unless it is a leaf."""

    ids: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    start: np.ndarray
    end: np.ndarray
    leaf: np.ndarray
    norm: np.ndarray  # of a node's longest point


def build(ids: np.ndarray, points: np.ndarray, leaf_rows: int) -> KdTree:
    order = np.arange(len(ids))
    spans: dict[int, tuple[int, int, bool]] = {}
    boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    todo = [(0, 0, len(ids))]
    while todo:
        node, a, b = todo.pop()
        part = points[order[a:b]]
        low, high = part.min(axis=0), part.max(axis=0)
        side = int(np.argmax(high - low))
        boxes[node] = low, high
        leaf = b - a <= leaf_rows or low[side] == high[side]
        spans[node] = a, b, leaf
        if not leaf:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, side], mid)]
            todo += [(2 * node + 1, a, a + mid), (2 * node + 2, a + mid, b)]
    names = sorted(spans)
    size = names[-1] + 1
    low, high = np.zeros((size, points.shape[1])), np.zeros((size, points.shape[1]))
    start, end, leaf = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    for n in names:
        (low[n], high[n]), (start[n], end[n], leaf[n]) = boxes[n], spans[n]
    points = points[order]
    norms = np.sqrt((points * points).sum(axis=1))
    norm = np.array([norms[a:b].max() if b > a else 0.0 for a, b in zip(start, end)])
    return KdTree(ids[order], points, low, high, start, end, leaf, norm)


def upper_splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Side and threshold of the nodes of a complete tree of medians; node k has children 2k + 1 and 2k + 2."""
    out: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for part in level:
            if len(part):
                side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                value = float(np.median(part[:, side]))
            else:
                side, value = 0, 0.0
            out.append((side, value))
            below += [part[part[:, side] < value], part[part[:, side] >= value]]
        level = below
    return out


def cells_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """The number of the cell below the splits for every point."""
    node = np.zeros(len(points), np.int64)
    sides, values = (np.array([s[k] for s in splits]) for k in (0, 1))
    while len(splits) and (inner := node < len(splits)).any():
        at = node[inner]
        node[inner] = 2 * at + 1 + (points[inner, sides[at].astype(int)] >= values[at])
    return node - len(splits)


class Best:
    """The k best (score, id) of one query, kept sorted; equal scores prefer smaller ids."""

    def __init__(self, own: int, k: int):
        self.own, self.k = own, k
        self.scores, self.ids = np.empty(0), np.empty(0, np.int64)

    @property
    def kth(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.kth) & (ids != self.own)
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


def bounds_of(queries: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries (rows) with the points of boxes (columns)."""
    box = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    length = np.sqrt((queries * queries).sum(axis=1))[:, None] * norm[None, :]
    return np.minimum(box, length * (1 + 1e-12) + 1e-6)  # the box is exact in integers, the lengths are rounded


def search(tree: KdTree, queries: np.ndarray, best: list[Best]) -> int:
    """Brings every query's list up to date with the tree's points; the number of leaves read, summed over queries."""
    leaves = np.flatnonzero(tree.leaf)
    bounds = bounds_of(queries, tree.low[leaves], tree.high[leaves], tree.norm[leaves])
    order = np.argsort(-bounds, axis=1, kind="stable")
    kth = np.array([b.kth for b in best], float)
    open_, read = np.arange(len(queries)), 0
    for step in range(len(leaves)):
        at = order[open_, step]
        reach = bounds[open_, at] >= kth[open_]  # an equal bound may still hold a smaller id
        open_, at = open_[reach], at[reach]
        if not len(open_):
            break
        read += len(open_)
        by_leaf = np.argsort(at, kind="stable")
        for group in np.split(by_leaf, np.flatnonzero(np.diff(at[by_leaf])) + 1):
            leaf = leaves[at[group[0]]]
            part = slice(tree.start[leaf], tree.end[leaf])
            asked = open_[group]
            scores = queries[asked] @ tree.points[part].T
            for k in np.flatnonzero(scores.max(axis=1) >= kth[asked]):
                best[asked[k]].offer(scores[k], tree.ids[part])
                kth[asked[k]] = best[asked[k]].kth
    return read


def _all_scores(tree: KdTree, queries: np.ndarray, best: list[Best]) -> None:
    """For components whose products leave the exact range of doubles."""
    points = [[int(x) for x in p] for p in tree.points]
    for q, found in zip(queries, best):
        q = [int(x) for x in q]
        rows = [(max(-LONG, min(LONG, sum(x * y for x, y in zip(p, q)))), int(i)) for p, i in zip(points, tree.ids) if i != found.own]
        rows += [(int(s), int(i)) for s, i in zip(found.scores, found.ids)]
        rows = sorted(rows, key=lambda r: (-r[0], r[1]))[: found.k]
        found.scores, found.ids = np.array([r[0] for r in rows], object), np.array([r[1] for r in rows], np.int64)


@dataclass
class Listed:
    """The shards of one list: names, boxes, lengths of their longest points."""

    names: list[str]
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray


def through_shards(lists: Iterator[Listed], load: Callable[[str], KdTree], queries: np.ndarray, best: list[Best]) -> tuple[int, int]:
    """Takes queries through all shards of all lists; the numbers of shards and of leaves read."""
    shards = leaves = 0
    for listed in lists:
        bounds = bounds_of(queries, listed.low, listed.high, listed.norm)
        for k in np.argsort(-bounds.max(axis=0), kind="stable"):
            kth = np.array([b.kth for b in best], float)
            reach = np.abs(queries).max() * max(np.abs(listed.low[k]).max(), np.abs(listed.high[k]).max()) * queries.shape[1]
            exact = reach < EXACT
            asked = np.flatnonzero(bounds[:, k] >= kth) if exact else np.arange(len(queries))
            if not len(asked):
                continue
            tree = load(listed.names[k])
            shards += 1
            leaves += (search if exact else _all_scores)(tree, queries[asked], [best[i] for i in asked]) or 0
    return shards, leaves


SAMPLE = 4096  # vectors that the upper splits come from
LISTED = 1024  # shards of a list


def top_k(
    spark: SparkSession, table: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10,
    scale: float = 1024.0, shard_rows: int = 8192, leaf_rows: int = 128, query_rows: int = 256,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query row against all other rows."""
    scratch, trees = Scratch(spark, "topk"), Blobs(spark, "topk-trees")
    rows = (
        table.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
        .groupBy(F.col(vec_id).cast("bigint").alias("id"))
        .agg(F.min(vector).alias("v"), F.max(is_query).alias("is_query"))
        .select("id", "is_query", F.size("v").alias("dim"), F.transform("v", lambda x: x.cast("double") * scale).alias("v"))
    )
    rows = scratch.keep(rows, "rows")
    count, asked = rows.agg(F.count("*"), F.count_if("is_query")).first()
    depth, n_blocks = (blocks(count, shard_rows) - 1).bit_length(), blocks(asked, query_rows)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("dim", "v").toPandas()  # SAMPLE rows
    depth = min(depth, 12)  # at most SAMPLE cells; larger cells have several shards
    splits = {int(dim): upper_splits(np.floor(matrix(part["v"])), depth) for dim, part in sample.groupby("dim")}

    def deal(frames):
        for pdf in frames:
            cell = np.zeros(len(pdf), np.int64)
            for dim, at in pdf.groupby("dim").indices.items():
                if dim in splits:
                    cell[at] = cells_of(np.floor(matrix(pdf["v"].iloc[at])), splits[dim])
            yield pdf.assign(cell=cell)

    celled = scratch.keep(rows.select("id", "dim", "v").mapInPandas(deal, "id bigint, dim int, v array<double>, cell bigint"), "cells")
    sizes = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    dealt_rows = celled.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(pdf["id"].to_numpy(), np.floor(matrix(pdf["v"])), leaf_rows)
        dim, cell, part = (int(pdf[c].iat[0]) for c in ("dim", "cell", "part"))
        name = f"{dim:08d}-{cell:06d}-{part:08d}"
        trees.put(name, pickle.dumps(tree))
        return pd.DataFrame({"dim": [dim], "name": [name], "low": [tree.low[0].tolist()], "high": [tree.high[0].tolist()], "norm": [tree.norm[0]]})

    shards = dealt_rows.groupBy("dim", "cell", "part").applyInPandas(plant, "dim int, name string, low array<double>, high array<double>, norm double")
    shards = scratch.keep(shards, "shards")
    scratch.drop(celled)
    n_lists = blocks(shards.count(), LISTED)

    def enlist(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        name = f"list-{int(pdf['dim'].iat[0]):08d}-{int(pdf['list'].iat[0]):06d}"
        trees.put(name, pickle.dumps(Listed(pdf["name"].tolist(), matrix(pdf["low"]), matrix(pdf["high"]), pdf["norm"].to_numpy())))
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "list": [name]})

    numbered = shards.withColumn("list", F.pmod(F.xxhash64("name"), F.lit(n_lists)).cast("int"))
    lists = scratch.keep(numbered.groupBy("dim", "list").applyInPandas(enlist, "dim int, list string"), "lists")
    names: dict[int, list[str]] = {}
    for dim, name in sorted(tuple(r) for r in lists.collect()):  # one name for LISTED shards
        names.setdefault(dim, []).append(name)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = np.floor(matrix(pdf["v"]))
        best = [Best(i, k) for i in pdf["id"]]
        found = (pickle.loads(trees.get(name)) for name in names.get(int(pdf["dim"].iat[0]), []))
        through_shards(found, lambda name: pickle.loads(trees.get(name)), asked, best)
        out = [(b.own, r, int(i), int(s)) for b in best for r, (s, i) in enumerate(zip(b.scores, b.ids), 1)]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    queries = dealt(rows.where("is_query"), "id", n_blocks, "block").select("dim", "block", "id", "v")
    return queries.groupBy("dim", "block").applyInPandas(answer, "query_id bigint, rank int, vec_id bigint, score bigint")
