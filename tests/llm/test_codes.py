"""Product codes against rounds that compare everything, and their edges."""

import numpy as np
import pytest

from wattledger.llm import codes


def lloyd(rows, parts, entries, rounds, scale=256):
    """rows: vec_id, vector; codes and squared distances per row, and codebooks, without any shortcut."""
    x = np.floor(scale * np.array([v for _, v in rows], float)).astype(np.int64).reshape(len(rows), parts, -1)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].ravel().tolist()))
    books = x[order[:entries]].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        if k < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    mine = x[code[:, p] == e, p]
                    if len(mine):
                        books[p, e] = mine.sum(axis=0) // len(mine)
    return code, d.min(axis=2), books


def run(spark, rows, **given):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS code", "'y' AS v")
    return codes.compress(spark, frame.repartition(3), **given)


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_equals_full_rounds(spark, rounds):
    rng = np.random.default_rng(rounds)
    vectors = np.round(rng.normal(size=(300, 8)), 1).astype(np.float32)  # rounded: many ties
    rows = [(int(i) * 3, [float(c) for c in v], int(i) % 4) for i, v in enumerate(vectors)]
    rows += [(rows[5][0], rows[5][1], None), (None, rows[7][1], 1)]
    out, books = run(spark, rows, parts=4, entries=16, rounds=rounds)
    code, error, table = lloyd([r[:2] for r in rows], 4, 16, rounds)
    assert np.array_equal(books.entries, table)
    expected = sorted(map(str, [(r[0], c.tolist(), e.tolist()) for r, c, e in zip(rows, code, error)]))
    got = [(r["vec_id"], list(np.frombuffer(r["code"], ">u2")), r["distance"]) for r in out.collect()]
    assert sorted(str((i, [int(c) for c in k], d)) for i, k, d in got) == expected


def test_stored_distances_are_used(spark):
    """A round where one entry moved compares only that one, and ties keep the lower index."""
    table = np.array([[[0], [10], [20]]])
    x = np.array([[[4]], [[5]], [[14]], [[19]]])
    code, distance = codes.Codebooks(table, np.ones((1, 3), bool)).assign(x, None, None)
    assert code.ravel().tolist() == [0, 0, 1, 2]
    moved = codes.Codebooks(np.array([[[0], [6], [20]]]), np.array([[False, True, False]]))
    again = moved.assign(x, code, distance)
    fresh = moved.assign(x, None, None)
    assert np.array_equal(again[0], fresh[0]) and np.array_equal(again[1], fresh[1])
    seen = []
    original = codes.Codebooks.nearest
    moved.nearest = lambda rows, part, among: seen.append((len(rows), len(among))) or original(moved, rows, part, among)
    moved.assign(x, code, distance)
    assert seen == [(1, 3), (3, 1)]  # the row whose entry moved sees all three, the others only the moved one


def test_edges(spark):
    good = [(1, [0.5, -0.5], 1), (2, [0.5, -0.5], None), (2, [0.5, -0.5], None), (None, [1e30, 0.25], 2)]
    bad = [(5, None, 1), (6, [], 1), (7, [float("nan"), 0.0], 1), (8, [float("inf"), 0.0], 1), (9, [None, 0.0], 1), (10, [0.1], 1)]
    out, books = run(spark, good + bad, parts=2, entries=64)
    rows = codes.digests(out, books).collect()
    assert sorted((str(r["vec_id"]) for r in rows)) == ["1", "2", "2", "None"]
    assert books.entries.shape == (2, 4, 1) and books.entries.max() == codes.LARGEST
    assert {r["code"] for r in rows if r["vec_id"] in (1, 2)} == {"0000"}
    assert all(r["label_error"] == 0 for r in rows)


def test_labels_are_summed_with_nulls_together(spark):
    rows = [(i, [i / 7, -i / 3], None if i % 3 == 0 else i % 2) for i in range(40)]
    got = codes.digests(*run(spark, rows, parts=2, entries=4)).collect()
    label = {r[0]: r[2] for r in rows}
    sums = {}
    for r in got:
        sums[label[r["vec_id"]]] = sums.get(label[r["vec_id"]], 0) + r["error"]
    assert all(r["label_error"] == sums[label[r["vec_id"]]] for r in got) and len(sums) == 3


def test_decoding_gives_the_error(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=4)], 1) for i in range(50)]
    out, books = run(spark, rows, parts=2, entries=8)
    for r in out.collect():
        code = np.frombuffer(r["code"], ">u2").astype(int)[None]
        x = np.floor(256 * np.array(rows[r["vec_id"]][1], np.float32).astype(float))
        assert ((books.decode(code)[0] - x) ** 2).sum() == sum(r["distance"])


def test_empty_table(spark):
    assert codes.digests(*run(spark, [])).collect() == []
