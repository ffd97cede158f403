"""Merkle manifest of a table: one tree per group, and a tree over the groups' roots.

A leaf is the hash of a row's fields, each ``-`` if null, else its length in bytes, ``:`` and the value. Leaves ascend
by key within their group. While a group has several nodes, every ``fan`` consecutive ones become the hash of their
concatenated hex strings; the last run may be shorter. The groups' roots, in the order of the groups (null first), are
reduced to the table's root in the same way.

1. Rows are dealt by range of (group, key) and sorted; counts of the rows of each partition and group give every leaf
   its place in its group, so that a large group is never in one task.
2. ``fan ** levels`` consecutive leaves are an aligned block: one row, which holds every level as one string of hex
   digits. Fixed-width substrings of a level are hashed into the next one. Tops of blocks are packed into blocks again
   until every group has one node; the groups' roots then go the same way.
3. Downwards, each block takes the sibling segments that lie above it, and its members add their own: the substrings
   beside theirs, one pair (left, right) for each level. The proof is the hash of all of them; folding a leaf with them
   gives back the root, or another one if the leaf was changed.

The tampered form of a row (every row whose key's crc32 is even) is its text without line breaks.

Results: a null field is hashed as ``-``; an empty text as ``0:``; a lone leaf is its group's root, and a lone group's
root is the table's; null keys come first in their group and are never tampered with; equal keys are ordered by leaf, so
that repeated rows have a defined set of results; very long texts are hashed whole; an empty table gives an empty
manifest. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattledger.llm.common import Scratch

HEX = 64  # hex digits of a node


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def leaves_of(docs: DataFrame, columns: Sequence[str], group: str, key: str, text: str) -> DataFrame:
    """named, grp (the group, '' if it has no name), key, leaf, tampered (null where equal to the leaf)."""
    bare = F.replace(F.col(text), F.lit("\n"), F.lit(""))
    touched = (F.crc32(F.col(key).cast("string")) % 2 == 0) & (F.instr(text, "\n") > 0)
    changed = leaf_of([bare if c == text else F.col(c) for c in columns])
    return docs.select(
        F.col(group).isNotNull().alias("named"),
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"),
        F.col(key).alias("key"),
        leaf_of([F.col(c) for c in columns]).alias("node"),
        F.when(touched, changed).alias("tampered"),
    )


def placed(scratch: Scratch, nodes: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Adds pos, the place of a row among its keys in the given order, and size, the number of such rows.

    Also gives the kept table that the rows are read from.
    """
    at = nodes.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    at = scratch.keep(at.withColumn("at", F.monotonically_increasing_id()), "placed")
    parts = at.withColumn("part", F.shiftright("at", 33))  # partition number above the row's number in it
    runs = parts.groupBy(*keys, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*keys, "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    pos = (F.col("at") + F.col("shift")).alias("pos")
    return parts.join(runs, [*keys, "part"]).select(*nodes.columns, pos, "size"), at


def _grows(j: int) -> Column:
    """Whether level j of a block is hashed once more: several nodes are left in the group."""
    return F.col("many") | (F.length(f"l{j}") > HEX)


def _parents(level: str, fan: int) -> Column:
    """The level above: the hash of every substring of ``fan`` nodes."""
    runs = F.sequence(F.lit(0), F.expr(f"cast((length({level}) div {HEX} - 1) div {fan} as int)"))
    width = fan * HEX
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(F.col(level), i * width + 1, F.lit(width)), 256)), "")


def blocks_of(nodes: DataFrame, keys: list[str], carried: list[str], fan: int, levels: int) -> DataFrame:
    """keys, block, size, many, members (the carried columns in order), l0 .. l<levels>: the levels as strings."""
    width = fan**levels
    member = F.struct("pos", "node", *carried)
    out = nodes.groupBy(*keys, F.expr(f"pos div {width}").alias("block")).agg(
        F.sort_array(F.collect_list(member)).alias("members"),  # width rows at most
        F.max("size").alias("size"),
    )
    kept = F.transform("members", lambda m: F.struct(*(m[c].alias(c) for c in carried), F.lit(0).alias("none")))
    out = out.select(
        *keys, "block", "size", (F.col("size") > width).alias("many"), kept.alias("members"),
        F.array_join(F.col("members")["node"], "").alias("l0"),
    )
    for j in range(levels):
        out = out.withColumn(f"l{j + 1}", F.when(_grows(j), _parents(f"l{j}", fan)).otherwise(F.col(f"l{j}")))
    return out


def _segments(i: Column, fan: int, levels: int) -> Column:
    """The parts of the levels beside the node above member i, one pair for each level that is hashed."""
    pairs = []
    for j in range(levels):
        at = F.floor(i / fan**j).cast("int")  # node of this level
        first = at - at % fan  # first of its run
        left = F.substring(F.col(f"l{j}"), first * HEX + 1, (at - first) * HEX)
        right = F.substring(F.col(f"l{j}"), (at + 1) * HEX + 1, (first + fan - 1 - at) * HEX)
        pairs.append(F.when(_grows(j), F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*pairs))


class Forest:
    """The blocks of all rounds, and the tops: one node per group."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, keys: list[str], carried: list[str], fan: int, levels: int):
        self.keys, self.fan, self.levels, self.rounds = keys, fan, levels, []
        width = fan**levels
        largest = nodes.agg(F.max("size")).first()[0] or 0  # one number
        while True:
            blocks = scratch.keep(blocks_of(nodes, keys, carried, fan, levels), "blocks")
            self.rounds.append((blocks, carried))
            size = F.ceil(F.col("size") / width).alias("size")
            nodes = blocks.select(*keys, F.col("block").alias("pos"), F.col(f"l{levels}").alias("node"), size)
            if largest <= width:
                break
            largest, carried = -(-largest // width), []
        self.tops = nodes.select(*keys, "node")

    def members(self, above: DataFrame) -> DataFrame:
        """Every node of the first round with its carried columns, ``node`` and ``path``.

        ``above`` has a path for each group, and other columns that are handed down.
        """
        above = above.withColumn("block", F.lit(0).cast("bigint"))
        handed = [c for c in above.columns if c not in (*self.keys, "block", "path")]
        for blocks, carried in reversed(self.rounds):
            # the rows of a block are made after the join: blocks are shuffled, not their members' paths
            joined = blocks.join(above, [*self.keys, "block"])
            names = [c for c in joined.columns if c != "members"]
            rows = joined.select(*names, F.posexplode("members").alias("i", "member"))
            node = F.substring(F.col("l0"), F.col("i") * HEX + 1, F.lit(HEX)).alias("node")
            path = F.concat(_segments(F.col("i"), self.fan, self.levels), F.col("path")).alias("path")
            pos = (F.col("block") * self.fan**self.levels + F.col("i")).alias("block")
            above = rows.select(*self.keys, pos, *(F.col("member")[c].alias(c) for c in carried), node, path, *handed)
            if not carried:
                above = above.drop("node")
        return above.drop("block")


def manifest(
    spark: SparkSession, docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "source", key: str = "doc_id", text: str = "text", fan: int = 3, levels: int = 4,
) -> DataFrame:
    """key (under its name), leaf, subroot, root, path (sibling segments, left and right, from the leaf up), tampered
    (the leaf of the tampered row, else the leaf) of every row."""
    scratch = Scratch(spark, "merkle")
    leaves = scratch.keep(leaves_of(docs, columns, group, key, text), "leaves")
    by = ["named", "grp"]
    places, kept = placed(scratch, leaves, by, ["key", "node"])
    groups = Forest(scratch, places, by, ["key", "tampered"], fan, levels)
    scratch.drop(leaves, kept)
    tops = scratch.keep(groups.tops, "subroots")
    places, kept = placed(scratch, tops, [], by)
    table = Forest(scratch, places, [], by, fan, levels)
    scratch.drop(tops, kept)
    root = table.tops.select(F.col("node").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    subroots = scratch.keep(table.members(root).withColumnRenamed("node", "subroot"), "paths")
    rows = groups.members(subroots)
    return rows.select(
        F.col("key").alias(key), F.col("node").alias("leaf"), "subroot", "root", "path",
        F.coalesce("tampered", "node").alias("tampered"),
    )


def verify(rows: DataFrame) -> DataFrame:
    """Adds proof_sha256, folded_root (from the tampered leaf) and verified to a manifest, in place of its path."""
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.col("tampered"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    out = rows.withColumns({"proof_sha256": F.sha2(beside, 256), "folded_root": folded})
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("path", "tampered")
