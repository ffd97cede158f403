"""Near-duplicates, cover tree, top-k and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import corpus, documents
from wattledger.llm import covertree, minhash, topk
from wattledger.llm.common import Scratch
from wattledger.llm.components import connected_components


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    w = (text or "").encode().lower().split()
    k = min(size, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(130)],
        "chain": [(k, k + 1) for k in range(60)] + [(3, 3)],
        "star": [(0, k) for k in range(1, 90)] + [(0, 1)] * 5,
        "empty": [],
    }[shape]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()}
    linked = {n for e in edges if e[0] != e[1] for n in e}
    want = union_find(edges, {n for e in edges for n in e})
    assert got == {n: want[n] for n in linked}


def near(spark, texts, size=4, **more):
    rows = minhash.near_duplicates(spark, documents(spark, texts), shingle=size, **more).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in rows)


def near_brute(texts, size=4):
    sets = {i: shingles(t, size) for i, t in enumerate(texts)}
    edges = [
        (i, j) for i in sets for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    root = union_find(edges, sets)
    return sorted((False, i, len(sets[i]), root[i], root[i] == i) for i in sets)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    texts = corpus()
    assert near(spark, texts, size) == near_brute(texts, size)


def test_near_duplicates_in_small_blocks(spark):
    """A large group of drifting copies, with buckets split over many blocks."""
    rng = random.Random(2)
    base = corpus(9, 41)[40].split(" ")
    base = (base * 40)[:60]
    texts = []
    for k in range(70):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            copy[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(copy))
    assert near(spark, texts, block=8) == near_brute(texts)


def test_near_duplicates_edges(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, long), (8, long + " end"), (9, "x y z q"),
             (9, "x y z q"), (9, "other words of the same id"), (None, "a b"), (None, None), (10, "a b c"), (11, "other words of the same id")]
    got = near(spark, texts)
    by_id = {(g[1], g[2]): g[3:] for g in got if not g[0]}
    assert by_id[4, 1] == (4, True) and by_id[5, 1] == (4, False) and by_id[6, 1] == (6, True)
    assert by_id[1, 0] == (1, True) and by_id[2, 0] == (2, True) and by_id[3, 0] == (3, True)
    assert by_id[7, 29_997] == (7, True) and by_id[8, 29_998] == (7, False)
    assert by_id[9, 1] == (9, True) and by_id[9, 3] == (9, True) and by_id[11, 3] == (9, False)
    assert [g for g in got if g[0]] == [(True, 0, 0, None, True), (True, 0, 1, None, True)]
    assert len(got) == len(texts)
    assert near(spark, []) == []


def vectors(rng, n=150, dim=8):
    base = rng.normal(size=(n // 3, dim))
    out = [base[rng.integers(len(base))] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.3]) for _ in range(n)]
    return np.array(out).astype(np.float32)


def vector_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("v", F.lit("x"))


ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0, None] + [0.0] * 6, 1), (904, [float("nan")] * 8, 1),
       (905, [float("inf")] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (906, [1.0, 2.0], 1)]


@pytest.mark.parametrize("group_rows", [40, 4096])
def test_cover_tree(spark, group_rows):
    x = vectors(np.random.default_rng(4)).tolist()
    x[7], x[90] = x[3], [2 * v for v in x[3]]
    rows = [(i, v, 0) for i, v in enumerate(x)] + ODD + [(5, x[5], 0)]
    got = covertree.near_duplicates(spark, vector_table(spark, rows), group_rows=group_rows).collect()
    y = np.array(x)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    edges = [(i, j) for i in range(len(y)) for j in range(i) if y[i] @ y[j] >= 0.95]
    root = union_find(edges, range(len(y)))
    degree = np.bincount(np.array(edges).ravel(), minlength=len(y))
    want = [(i, int(degree[i]), root[i], root[i] == i) for i in [*range(len(y)), 5]]
    want += [(i, 0, i, True) for i in range(900, 907)] + [(None, 0, None, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_cover_tree_invariants():
    unit = vectors(np.random.default_rng(1), 300).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tree = covertree.build(unit, leaf_rows=4)

    def walk(node, radius):
        d = np.sqrt(np.maximum(0, 2 - 2 * tree.unit[node.a : node.b] @ tree.unit[node.a]))
        assert d.max() <= node.radius + 1e-7 and node.radius <= radius + 1e-7
        covered = [*node.single, *(k for c in node.children for k in range(c.a, c.b))]
        assert sorted(covered) == list(range(node.a, node.b))
        for child in node.children:
            walk(child, radius / 2)

    walk(tree.root, 2.0)
    assert sorted(tree.order) == list(range(300))


def clustered(n_clusters=60, size=40, dim=16, spread=0.02, seed=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, dim))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), size, axis=0)
    return (x + rng.normal(0, spread, x.shape)).astype(np.float32)


def test_cover_tree_prunes_clusters():
    """Copies form nodes of their own, and most pairs of points are never compared."""
    unit = clustered().astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tree = covertree.build(unit[np.random.default_rng(2).permutation(len(unit))])
    ones = np.ones(len(unit), np.int64)
    sums, _, forest = covertree.dual(tree, tree, 0.95, ones, ones)
    exact = (tree.unit @ tree.unit.T >= 0.95).sum(axis=1) - 1
    assert np.array_equal(sums, exact)
    assert forest.products < 0.1 * len(unit) ** 2

    def nodes(node):
        return 1 + sum(map(nodes, node.children))

    assert nodes(tree.root) > 60
    pair = covertree.build(np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]))
    assert [(c.b - c.a, c.radius) for c in pair.root.children] == [(2, 0.0)]  # two copies are a node


def test_groups_far_apart_are_never_walked(spark, monkeypatch):
    x = clustered()
    table = vector_table(spark, [(i, v, 0) for i, v in enumerate(x.tolist())])
    counted = []
    original = covertree._pairs_of_groups

    def spying(groups, *rest):
        pairs = original(groups, *rest)
        counted.append((groups.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(covertree, "_pairs_of_groups", spying)
    got = {r.vec_id: r.n_links for r in covertree.near_duplicates(spark, table, group_rows=60).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert got == dict(enumerate(((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()))
    (groups, pairs), = counted
    assert groups >= 40 and pairs < 0.25 * groups * (groups + 1) / 2


def test_cover_tree_of_nothing(spark):
    assert covertree.near_duplicates(spark, vector_table(spark, [])).collect() == []


@pytest.mark.parametrize("shard_rows", [30, 8192])
def test_top_k(spark, shard_rows):
    x = vectors(np.random.default_rng(8)).tolist()
    x[20] = x[21]
    rows = [(i, v, 0) for i, v in enumerate(x)] + ODD + [(5, x[5], 0)]
    got = topk.top_k(spark, vector_table(spark, rows), F.col("vec_id") % 10 == 0, shard_rows=shard_rows, leaf_rows=4, query_rows=4).collect()
    z = np.floor(1024 * np.array(x, np.float64)).astype(np.int64)
    want = []
    for q in range(0, len(z), 10):
        scores = z @ z[q]
        order = sorted((i for i in range(len(z)) if i != q), key=lambda i: (-scores[i], i))[:10]
        want += [(q, r, i, int(scores[i])) for r, i in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == want


def test_shards_and_leaves_that_cannot_reach_are_not_read():
    x = np.floor(1024 * clustered(64, 60, 8, 0.05) * np.random.default_rng(1).choice([1.0, 4.0], 3840)[:, None])
    splits = topk.upper_splits(x[::7], 5)
    cell = topk.cells_of(x, splits)
    assert len(np.unique(cell)) == 32 and np.bincount(cell).max() < 400
    trees = {str(c): topk.build(np.flatnonzero(cell == c), x[cell == c], 16) for c in range(32)}
    listed = topk.Listed(list(trees), *(np.stack([getattr(t, n)[0] for t in trees.values()]) for n in ("low", "high", "norm")))
    asked = x[::100]
    loaded, leaves, every = 0, 0, sum(int(t.leaf.sum()) for t in trees.values())
    for i, q in zip(range(0, len(x), 100), asked):  # one query at a time: what a query needs
        best = [topk.Best(i, 10)]
        read = topk.through_shards(iter([listed]), trees.__getitem__, q[None, :], best)
        loaded, leaves = loaded + read[0], leaves + read[1]
        scores = x @ q
        order = sorted((k for k in range(len(x)) if k != i), key=lambda k: (-scores[k], k))[:10]
        assert best[0].ids.tolist() == order
    assert loaded < 0.4 * 32 * len(asked) and leaves < 0.2 * every * len(asked)


def test_top_k_prunes_and_handles_large_values(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.01, size=(200, 2)) for c in (-50, 0, 50)])
    tree = topk.build(np.arange(600), points, 16)
    best = [topk.Best(-1, 3)]
    read = topk.search(tree, np.array([[1.0, 1.0]]), best)
    assert read < 8 and tree.leaf.sum() > 30 and list(best[0].ids) == list(np.argsort(-points.sum(axis=1))[:3])
    rows = [(0, [1e30, 1.0], 0), (1, [1e30, 2.0], 0), (2, [1.0, 1.0], 0)]
    got = sorted(map(tuple, topk.top_k(spark, vector_table(spark, rows), F.col("vec_id") == 0).collect()))
    assert [g[2] for g in got] == [1, 2] and got[0][3] == 2**63 - 1
    assert topk.top_k(spark, vector_table(spark, []), F.lit(True)).collect() == []
