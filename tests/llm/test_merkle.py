"""The manifest against a tree built in plain Python, and its edges."""

import hashlib
import random
import zlib

import pytest

from tests.llm.data import DOCS, documents
from wattledger.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fan=3):
    """All levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + fan])) for i in range(0, len(last), fan)])
    return levels


def siblings(levels, i, fan=3):
    out = []
    for level in levels[:-1]:
        first = i - i % fan
        out.append((level[first:i], level[i + 1 : first + fan]))
        i //= fan
    return out


def expected(rows):
    """rows: doc_id, source, lang, n_chars, text; sorted results of all rows."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        plain = leaf((doc_id, source, lang, n_chars, text))
        touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        other = leaf((doc_id, source, lang, n_chars, text.replace("\n", ""))) if touched else plain
        groups.setdefault(source, []).append(((doc_id is not None, doc_id or 0, plain), doc_id, plain, other))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort()
        trees[source] = tree([m[2] for m in groups[source]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for place, source in enumerate(order):
        for i, (_, doc_id, plain, other) in enumerate(groups[source]):
            path = siblings(trees[source], i) + siblings(top, place)
            node = other
            for left, right in path:
                node = h("".join([*left, node, *right]))
            proof = h("".join(x for left, right in path for x in [*left, *right]))
            out.append((doc_id, plain, trees[source][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(spark, rows, levels):
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("node", "pos", "size", "block", "path", "root", "members"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    out = merkle.verify(merkle.manifest(spark, frame, levels=levels))
    return sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_whole_manifest_equals_a_plain_tree(spark, levels):
    rng = random.Random(levels)
    rows = []
    for i in range(300):
        source = rng.choice(["hot"] * 6 + ["a", "b", "é", "Z", "", None, f"s{i % 9}"])
        text = rng.choice([None, "", "one line", f"two\nlines {i}", "\n", "ü\nß" * 50])
        rows.append((i * 7, text, rng.choice([None, "en"]), source, rng.choice([None, 5])))
    rows += [(None, "no\nid", None, "hot", 3)] * 2 + [rows[0]] * 4  # null ids and repeated rows
    assert got(spark, rows, levels) == expected(rows)


def test_one_row_is_its_own_root(spark):
    rows = [(4, "x", None, None, None)]
    assert got(spark, rows, 4) == expected(rows)
    assert got(spark, rows, 4)[0][1] == got(spark, rows, 4)[0][3]


def test_empty_table(spark):
    assert got(spark, [], 4) == []


def test_very_long_text(spark):
    rows = [(i, "word\n" * 200_000, "en", "s", 1) for i in range(4)]
    assert got(spark, rows, 2) == expected(rows)


def test_only_named_columns_are_read(spark):
    frame = documents(spark, ["a\nb", "c"])
    out = merkle.verify(merkle.manifest(spark, frame, columns=("doc_id", "text")))
    assert out.count() == 2 and out.select("root").distinct().count() == 1
