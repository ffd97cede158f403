"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few numbers (lengths, shares of character kinds, repetition). Their values are binned at the
quantiles of the training sample; cyclic boosting of shallow trees, one feature at a time, adds up to one lookup
table per feature, then to one table for each of the pairs that explain most of what is left. A score is the
logistic function of the sum of the tables' entries: additions of whole columns.

The model is fitted on a bounded sample of labelled training documents (``per_class`` of each class, weighted to
the true proportions); every document is scored.

Results: null and empty texts have all numbers zero and get the score of those bins; very long texts are read
whole; repeated rows are scored alike; of a labelled id with several texts the first in order is learned from; with labels of one class only, or none, every score is the share of that
class (0.5 without labels); a null id is not held out; an empty table gives an empty table; other columns are
not inputs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm.common import remainder, sample_labelled, with_column

FEATURES = [
    "log_words", "word_length", "distinct_share", "repeat_share", "short_share", "long_share", "upper_share", "digit_share",
    "symbol_share", "exclaim_share", "stop_share", "line_length", "repeated_lines", "top_word_share", "pair_share", "space_share",
]


def _kinds() -> np.ndarray:
    """One row per kind of byte: upper, digit, symbol, exclamation, sentence mark, white space."""
    out = np.zeros((256, 6))
    out[ord("A") : ord("Z") + 1, 0] = 1
    out[ord("0") : ord("9") + 1, 1] = 1
    for b in b"#$%&*+/<=>@\\^_`|~{}[]":
        out[b, 2] = 1
    out[ord("!"), 3] = 1
    for b in b".?!":
        out[b, 4] = 1
    for b in b" \t\n\r\v\f":
        out[b, 5] = 1
    return out


KINDS = _kinds()


def numbers_of(text: str | None) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ KINDS
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in text.split("\n") if line]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    size = len(data)
    return [
        log1p(n),
        float(lengths.mean()),
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        float((lengths <= 3).mean()),
        float((lengths >= 15).mean()),
        kinds[0] / size,
        kinds[1] / size,
        kinds[2] / size,
        kinds[3] / size,
        kinds[4] / n,
        log1p(n / len(lines)),
        1.0 - len(set(lines)) / len(lines),
        max(counts.values()) / n,
        pairs,
        kinds[5] / size,
    ]


@dataclass
class Gam:
    """Bin edges, a table per feature, a table per pair of features."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> bin of the pair tables
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for k, table in enumerate(self.tables):
            out += table[bins[:, k]]
        for i, j, table in self.pairs:
            out += table[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(self.bins(x)))) if len(x) else np.empty(0)


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of depth two over the bins."""
    out = np.zeros(len(g))
    _, cut = _best_cut(g, h)
    for lo, hi in ((0, cut), (cut, len(g))):
        if hi > lo:
            gain, inner = _best_cut(g[lo:hi], h[lo:hi])
            parts = ((lo, lo + inner), (lo + inner, hi)) if gain > 1e-6 else ((lo, hi),)
            for a, b in parts:
                out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best four quadrants of a two-dimensional histogram: gain and values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def gain(a, b):
        return a**2 / (b + 1)

    top_g, left_g, all_g = cg[:-1, -1:], cg[-1:, :-1], cg[-1, -1]
    top_h, left_h, all_h = ch[:-1, -1:], ch[-1:, :-1], ch[-1, -1]
    q = cg[:-1, :-1], ch[:-1, :-1]
    total = (
        gain(*q) + gain(top_g - q[0], top_h - q[1]) + gain(left_g - q[0], left_h - q[1])
        + gain(all_g - top_g - left_g + q[0], all_h - top_h - left_h + q[1]) - gain(all_g, all_h)
    )
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float(total[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.2, n_bins: int = 32) -> Gam:
    """Boost the tables of all features in turn, then those of the pairs with the largest gain."""
    share = float((w * y).sum() / w.sum()) if len(y) else 0.5
    edges = []
    for k in range(len(FEATURES)):
        cuts = np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1]) if len(x) else np.empty(0)
        edges.append(np.unique(cuts))
    floor = min(max(share, 1e-3), 1 - 1e-3)
    gam = Gam(edges, float(np.log(floor / (1 - floor))), [np.zeros(len(e) + 1) for e in edges])
    gam.coarse = [np.arange(len(e) + 1) * 8 // (len(e) + 1) for e in edges]
    if not len(y) or share in (0.0, 1.0):
        return gam
    bins = gam.bins(x)
    margin = np.full(len(y), gam.intercept)

    def gradient():
        p = 1 / (1 + np.exp(-margin))
        return w * (y - p), w * p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(gam.tables):
            g, h = gradient()
            step = rate * _tree(np.bincount(bins[:, k], g, len(table)), np.bincount(bins[:, k], h, len(table)))
            table += step
            margin += step[bins[:, k]]
    cells = [gam.coarse[k][bins[:, k]] for k in range(len(FEATURES))]
    g, h = gradient()
    ranked = []
    for i in range(len(FEATURES)):
        for j in range(i):
            cell = cells[i] * 8 + cells[j]
            gain, _ = _pair_tree(np.bincount(cell, g, 64).reshape(8, 8), np.bincount(cell, h, 64).reshape(8, 8))
            ranked.append((gain, i, j))
    gam.pairs = [(i, j, np.zeros((8, 8))) for _, i, j in sorted(ranked, reverse=True)[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in gam.pairs:
            g, h = gradient()
            cell = cells[i] * 8 + cells[j]
            _, step = _pair_tree(np.bincount(cell, g, 64).reshape(8, 8), np.bincount(cell, h, 64).reshape(8, 8))
            table += rate * step
            margin += rate * step[cells[i], cells[j]]
    return gam


def train(documents: DataFrame, labels: DataFrame, train_rows, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_class: int = 6000) -> Gam:
    """Fit on a bounded sample of labelled rows; their numbers are computed by tasks."""
    chosen = sample_labelled(labels, label, per_class, train_rows)
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # at most 2 * per_class rows of an id, a class and a weight; of an id with several texts the first in order counts
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("w").alias("w"))

    def run(batches):
        for batch in batches:
            numbers = [numbers_of(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "w"])

    # a fixed number of small rows; sorted, so that sums do not depend on the order of tasks
    rows = sorted(tuple(r) for r in sample.select("text", "y", "w").mapInArrow(run, "x array<double>, y int, w double").collect())
    x = np.array([r[0] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float))


def with_scores(docs: DataFrame, gam: Gam, name: str, text: str = "text") -> DataFrame:
    """All columns of docs and the score under ``name``. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(gam)  # a few thousand numbers
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            x = np.array([numbers_of(t.as_py()) for t in batch.column(at)], float).reshape(batch.num_rows, len(FEATURES))
            scores = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, with_column(docs, name, "double"))


def score_documents(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; training rows are those whose crc32 modulo 3 is not 1."""
    gam = train(documents, labels, remainder("doc_id", 3) != 1)
    scored = with_scores(documents.select("doc_id", "text"), gam, "score")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
