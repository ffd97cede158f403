"""MinHash near-duplicates: universal hash minima, banding, signature verification, connected components.

1. Every text becomes a set of word shingles (64-bit hashes). Equal sets form one class, named by a hash of the set;
   classes are aggregated before the shuffle, so that groups of exact copies never meet again.
2. A signature has ``bands * rows`` universal hash minima. Classes that agree in all rows of a band share a bucket.
   With 40 bands of 5 rows two sets of similarity 0.8 share no bucket with a probability of 1.2e-7.
3. Every member of a bucket is paired with the bucket's least member: rows in proportion to the members. Pairs
   whose signatures agree too little are dropped (the bound is six standard deviations below the threshold, so a
   link is lost with a probability below 1e-8), the rest is confirmed on the full sets. Confirmed links are joined
   to components.
4. Buckets whose members are not all in one component yet are compared in full: their members are dealt to blocks
   and carry their sets (as 32-bit hashes); a task compares the sets of two blocks and returns, for each member and
   component that it reaches, one pair. Pairs that share an earlier bucket are left to that one; links inside one
   component change nothing and are not looked for. The pairs returned are confirmed on the full sets too.
5. Alternating large-star and small-star gives the components.

Results: null and empty texts have an empty set and link with nothing; a text with fewer words than a shingle is
one shingle; very long texts are hashed in pieces but whole; repeated rows are members of the same class, and rows
of one id with different texts belong to different classes; a row with a null id is kept, has a null component and
links with nothing; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm.common import Scratch
from wattledger.llm.components import connected_components, labels_of, star_rounds

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
POWER_SPAN = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text after lower-casing A-Z; words are what six white-space bytes separate."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U64)
    data = np.frombuffer(b"".join(words), np.uint8).astype(U64) + U64(1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    # position within its word of every byte picks the power, so a word hashes alike anywhere
    place = np.arange(data.size) - np.repeat(starts, lengths)
    data *= _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(data, starts) + lengths.astype(U64))


_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if _POWERS.size < n:
        steps = np.full(max(n, 256), BASE)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = mix(np.multiply.accumulate(steps))
    return _POWERS


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = word_hashes(text or "")
    n = words.size
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        k = min(size, n)
        out = np.full(n - k + 1, U64(k))
        for j in range(k):
            out = mix(out * BASE + words[j : n - k + 1 + j])
    return np.unique(out)


class Hasher:
    """``bands * rows`` universal hash functions h(x) = a x + b on 32-bit words."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)
        self.weights = rng.integers(0, 1 << 63, rows, np.uint64) * U64(2) + U64(1)
        self.salt = mix(np.arange(1, bands + 1, dtype=U64))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> U64(32)).astype(np.uint32)
        out = np.full(self.a.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, x.size, 512):  # pieces that stay in the cache
            np.minimum(out, (self.a[:, None] * x[None, i : i + 512] + self.b[:, None]).min(axis=1), out=out)
        return out

    def buckets(self, minima: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((minima.reshape(self.bands, self.rows).astype(U64) * self.weights).sum(axis=1) + self.salt)


def set_hash(shingles: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    with np.errstate(over="ignore"):
        total = np.array([mix(shingles).sum(dtype=U64) + U64(shingles.size)])
        return int(mix(total).view(np.int64)[0])


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set), sketch (one byte of each minimum), buckets of every row."""

    def run(batches):
        hasher = Hasher(bands, rows)
        for batch in batches:
            counts, nodes, sketches, buckets = [], [], [], []
            for value in batch.column(1):
                shingles = shingle_set(value.as_py(), size)
                counts.append(shingles.size)
                if shingles.size:
                    minima = hasher.minima(shingles)
                    nodes.append(set_hash(shingles))
                    sketches.append((minima & np.uint32(255)).astype(np.uint8).tobytes())
                    buckets.append(hasher.buckets(minima).view(np.int64))
                else:
                    nodes.append(None)
                    sketches.append(None)
                    buckets.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(sketches, pa.binary()),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "node", "sketch", "buckets"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint, sketch binary, buckets array<bigint>")


def _texts_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node, text of the classes that occur in pairs (a, b), now and then with more than one text of the same set.

    Rows that repeat an id and its text meet once, on the join's partitioning; an id's rows whose text is of another
    class are left out.
    """
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = classes.select("node", F.col("least_id").alias("doc_id")).join(nodes, "node")
    found = docs.join(wanted, "doc_id").dropDuplicates(["doc_id", "node", "text"]).select("node", "text")

    def run(batches):
        for batch in batches:
            same = [set_hash(shingle_set(t.as_py(), size)) == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield batch.filter(pa.array(same, pa.bool_()))

    return found.mapInArrow(run, "node bigint, text string")


def least_agreement(percent: int, functions: int) -> int:
    """The number of agreeing minima that a linked pair falls short of with a probability below 1e-8."""
    p = percent / 100
    return int(functions * p - 6 * (functions * p * (1 - p)) ** 0.5)


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of equal bytes of two sketches."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series((x == y).sum(axis=1).astype(np.int32))


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts: node, text."""

    def run(batches):
        for batch in batches:
            keep, last, one = [], None, None
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:  # pairs of one node tend to follow each other
                    last, one = b, shingle_set(y.as_py(), size)
                two = shingle_set(x.as_py(), size)
                common = int(np.isin(two, one, assume_unique=True).sum()) if two.size and one.size else 0
                keep.append(common > 0 and 100 * common >= percent * (one.size + two.size - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint").distinct()


def _agreeing(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    left = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    both = left.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    agree = F.pandas_udf(agreement, "int")
    return both.where(agree("sa", "sb") >= least).select("a", "b")


def _short_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node, words: the upper halves of the shingles' hashes, sorted."""

    def run(batches):
        for batch in batches:
            sets = [(shingle_set(t.as_py(), size) >> U64(32)).astype(np.uint32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "words"])

    return _texts_of(nodes, classes, docs, size).mapInArrow(run, "node bigint, words binary").dropDuplicates(["node"])


def _reached(x: pd.DataFrame, y: pd.DataFrame, band: int, percent: int, same: bool) -> list[tuple[int, int]]:
    """One linked pair for every member of x and component of y that it links to, as far as components differ."""
    nx, ny, cx, cy = (c.to_numpy().copy() for c in (x["node"], y["node"], x["component"], y["component"]))
    if len(cx) == 0 or len(cy) == 0 or (cx == cx[0]).all() and (cy == cx[0]).all():
        return []
    bx, by = (np.stack(c.to_list())[:, :band] for c in (x["buckets"], y["buckets"]))
    sets_x, sets_y = ([np.frombuffer(w, np.uint32) for w in c] for c in (x["words"], y["words"]))
    names = np.unique(np.concatenate(sets_x))
    marked = np.zeros(names.size + 1, np.int32)
    places = []  # where y's words stand among x's; the last place is for words that x does not have
    for words in sets_y:
        at = np.minimum(np.searchsorted(names, words), names.size - 1)
        places.append(np.where(names[at] == words, at, names.size))
    size_y = np.array([len(w) for w in sets_y])
    out = []
    for k in range(len(nx)):
        wanted = cy != cx[k]
        if same:
            wanted &= ny > nx[k]
        if band:
            wanted[wanted] = ~(by[wanted] == bx[k]).any(axis=1)
        # sets of too different sizes cannot be similar enough
        n = len(sets_x[k])
        hits = np.flatnonzero(wanted & (100 * np.minimum(size_y, n) >= percent * np.maximum(size_y, n)))
        if not hits.size:
            continue
        own = np.searchsorted(names, sets_x[k])
        marked[own] = 1
        starts = np.cumsum(size_y[hits]) - size_y[hits]
        common = np.add.reduceat(marked[np.concatenate([places[i] for i in hits])], starts)
        marked[own] = 0
        for i in hits[100 * common >= percent * (n + size_y[hits] - common)]:
            if cy[i] != cx[k]:
                out.append((int(max(nx[k], ny[i])), int(min(nx[k], ny[i]))))
                old, new = cy[i], cx[k]
                cx[cx == old] = new
                cy[cy == old] = new
    return out


def _blocks_compared(members: DataFrame, sets: DataFrame, block: int, percent: int) -> DataFrame:
    """Linked pairs (a, b) of different components of members (bucket, n, band, node, component); n: rows of the bucket.

    A bucket of n members has ceil(n / block) blocks; every pair of its blocks is one group of at most two blocks. Members
    are dealt by node before each is copied to its blocks, so the copies of a large bucket are made by many tasks. The
    sets (node, buckets, words) join last, so that they are shuffled to the groups and no further.
    """
    dealt = members.withColumn("n_blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")).repartition(F.xxhash64("bucket", "node"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    cells = dealt.select("*", other).select(
        "bucket", "band", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "component"
    ).join(sets, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high, band = pdf["low"].iat[0], pdf["high"].iat[0], int(pdf["band"].iat[0])
        if low == high:
            found = _reached(pdf, pdf, band, percent, True)
        else:
            found = _reached(pdf[pdf["mine"] == low], pdf[pdf["mine"] == high], band, percent, False)
        return pd.DataFrame(found, columns=["a", "b"])

    return cells.groupBy("bucket", "low", "high").applyInPandas(compare, "a bigint, b bigint").distinct()


def near_duplicates(
    spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
    bands: int = 40, rows: int = 5, block: int = 512,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = scratch.keep(_signatures(docs, shingle, bands, rows), "signed")
    # sketch and buckets follow from the set, so any row's will do
    with_signatures = signed
    classes = scratch.keep(
        signed.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("node")
        .agg(F.min("doc_id").alias("least_id"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets")),
        "classes",
    )
    signed = scratch.keep(signed.select("doc_id", "n_shingles", "node"), "rows")
    scratch.drop(with_signatures)
    sketches = classes.select("node", "sketch")

    spread = classes.select("node", F.posexplode("buckets").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    shared = scratch.keep(shared, "shared")
    members = scratch.keep(spread.join(shared, "bucket"), "members")  # bucket, node, band, n, least
    scratch.drop(shared)

    need = least_agreement(percent, bands * rows)
    stars = members.where(F.col("node") > F.col("least")).select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    agreed = scratch.keep(_agreeing(stars, sketches, need), "agreed")
    links = scratch.keep(_confirm(agreed, _texts_of(agreed, classes, docs, shingle), shingle, percent), "links")
    # two rounds join most of what is linked; what they leave apart is compared again, so nothing depends on it
    joined_links = star_rounds(links, scratch, most=2)
    labels = labels_of(joined_links)

    component = F.coalesce("component", "node").alias("component")
    joined = members.where("n > 2").join(labels, "node", "left").select("bucket", "n", "band", "node", component)
    joined = scratch.keep(joined, "joined")
    split = joined.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_members = scratch.keep(joined.join(split.select("bucket"), "bucket"), "open")
    sets = _short_sets(open_members.select(F.col("node").alias("a"), F.col("node").alias("b")), classes, docs, shingle)
    sets = sets.join(classes.select("node", "buckets"), "node")
    rest = scratch.keep(_blocks_compared(open_members, sets, block, percent).join(agreed, ["a", "b"], "left_anti"), "rest")
    more = scratch.keep(_confirm(rest, _texts_of(rest, classes, docs, shingle), shingle, percent), "more")

    scratch.drop(rest, open_members, joined, members, agreed)
    final = connected_components(joined_links.unionByName(more), scratch)
    linked = final.join(classes.select("node", "least_id"), "node")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_class = linked.join(least, "component").select("node", "component_id")
    by_class = classes.select("node", "least_id").join(by_class, "node", "left").select(
        "node", F.coalesce("component_id", "least_id").alias("component_id")
    )
    by_class = scratch.keep(by_class, "by_class")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return signed.select("doc_id", "n_shingles", "node").join(by_class, "node", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")
    )
