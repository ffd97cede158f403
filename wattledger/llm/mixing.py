"""Mixing with soft membership to target weights.

1. A table classifier, learned from the labelled table, gives every text its posterior probability of each domain: a few
   numbers of the text are binned at the quantiles of a bounded sample of labelled rows, among them how strongly its
   words speak for each domain (a lexicon of at most ``LEXICON`` words of the sample). The posterior is the product of the
   domain's share and its bin frequencies (naive Bayes on lookup tables), flattened by one exponent that makes the
   sample's labels likeliest.
2. Rates of documents are fitted by projected-gradient least squares: among the rates r at or above their bounds for
   which the expected tokens of every domain, sum of r * tokens * posterior, match its target, the ones nearest to one
   (squares weighted by tokens). They have the form r = max(bound, 1 - posterior . x): a gradient step from one, put back
   to the bound. x, one number per domain, is found by gradient steps in the metric of the documents above their bound;
   a pass over the table tries several step lengths at once and returns their sums, nothing else is exchanged. It
   converges in a few passes. If no rates meet the targets the result is the least-squares answer, and its gap is told.
3. A document is taken floor(r) times and once more with probability r - floor(r), decided by a hash of its id.

Targets are shares of a total: the one for which the ``anchor`` domain keeps its expected tokens, or without an
anchor the least one for which no domain has to shrink. Rates are bounded by ``least_rate`` from below; documents whose
posterior of the domain ``keep`` is ``KEPT`` or more are bounded by one, so that none of them is dropped.

Results: null and empty texts have no tokens and the posterior of all numbers zero; very long texts are read whole;
repeated rows get equal rates; without labels every domain is equally likely; labels of a domain without a target
take no part; a document labelled more than once takes the first domain by name, and of an id with several texts the
first text counts; null ids count as one id; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm.common import Scratch, with_column
from wattledger.llm.quality import KINDS

N_NUMBERS = 9
LEXICON = 4096  # words
KEPT = 0.95  # posterior of the domain to keep from which no document is dropped
WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def numbers_of(text: str | None, lexicon: Mapping[str, np.ndarray] | None = None, domains: int = 0) -> tuple[int, list[float]]:
    """Number of words, and the numbers that the tables bin: counts and shares, then what the lexicon says for each domain."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return 0, [0.0] * (N_NUMBERS + domains)
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digit, symbol, exclaim, stop, _ = counts @ KINDS
    size = len(data)
    spoken = [0.0] * domains
    if lexicon:
        for word in lexicon.keys() & words_of(text):
            spoken = [max(a, b) for a, b in zip(spoken, lexicon[word])]
    return n, [
        log1p(n), size / n, len(set(words)) / n, upper / size, digit / size, symbol / size, exclaim / size, stop / n,
        log1p(n / (1 + counts[10])), *spoken,
    ]


def lexicon_of(sample: DataFrame, domains: list[str]) -> dict[str, list[float]]:
    """The words of the sample (text, domain) that are most times as frequent among the texts of one domain as among the
    others', with the logarithms of these ratios (in halves, zero where there is nothing to say)."""

    def run(batches):
        for batch in batches:
            found = [(w, d) for t, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in words_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["word", "domain"])

    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}  # one row per domain
    total = sum(sizes.values())
    words = sample.select("text", "domain").mapInArrow(run, "word string, domain string")
    words = words.groupBy("word").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("domain") == name, 1)).alias(f"c{k}") for k, name in enumerate(domains)))
    ratios = []
    for k, name in enumerate(domains):
        c, size = F.col(f"c{k}"), sizes.get(name, 0)
        # the lower end of the ratio: a word in a few texts says little
        ratio = F.log((F.greatest(c - F.sqrt(c), F.lit(0.0)) + 0.01) / (size + 1)) - F.log((F.col("n") - c + 1) / (total - size + 1))
        ratios.append(F.when(c >= 3, F.floor(2 * F.greatest(ratio, F.lit(0.0))) / 2).otherwise(F.lit(0.0)))
    scored = words.select("word", "n", F.array(*ratios).alias("ratios")).withColumn("most", F.array_max("ratios")).where("most >= 1")
    best = scored.orderBy(F.col("most").desc(), F.col("n").desc(), "word").limit(LEXICON)
    return {r["word"]: list(r["ratios"]) for r in best.collect()}  # LEXICON rows


@dataclass
class Tables:
    """Bin edges, log prior, log frequency of every bin in every domain, exponent, lexicon; then the fitted rates: x, the
    bounds, and the gap between expected and wanted tokens as a share of all wanted ones."""

    domains: list[str]
    edges: list[np.ndarray]
    prior: np.ndarray
    tables: list[np.ndarray]
    power: float = 1.0
    lexicon: dict[str, list[float]] = field(default_factory=dict)
    x: np.ndarray | None = None
    least_rate: float = 0.0
    keep: int | None = None
    gap: float = 0.0
    passes: int = 0

    def numbers(self, text: str | None) -> tuple[int, list[float]]:
        return numbers_of(text, self.lexicon, len(self.domains))

    def evidence(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.domains)))
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, k], side="right")]
        return out

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = self.prior + self.power * self.evidence(x)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def bounds(self, p: np.ndarray) -> np.ndarray:
        bound = np.full(len(p), self.least_rate)
        if self.keep is not None and len(p):
            bound[p[:, self.keep] >= KEPT] = 1.0
        return bound

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(self.bounds(p), 1 - p @ self.x) if self.x is not None else np.ones(len(p))


def fit_tables(domains: list[str], x: np.ndarray, y: np.ndarray, w: np.ndarray, n_bins: int = 16) -> Tables:
    d = len(domains)
    n = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.empty(0) for k in range(n)]
    for k in range(N_NUMBERS, n):  # most texts have no word of the lexicon: every strength is a bin
        edges[k] = np.unique(x[:, k])[1:][:64]
    share = np.bincount(y, w, d) + 1.0
    tables = []
    for k in range(n):
        cells = np.full((len(edges[k]) + 1, d), 1.0 / (len(edges[k]) + 1))
        np.add.at(cells, (np.searchsorted(edges[k], x[:, k], side="right"), y), w)
        tables.append(np.log(cells / cells.sum(axis=0)))
    out = Tables(domains, edges, np.log(share / share.sum()), tables)
    if len(y):
        losses = []
        for power in np.linspace(0.05, 1.0, 20):
            out.power = float(power)
            losses.append((-(w * np.log(out.posterior(x)[np.arange(len(y)), y] + 1e-12)).sum(), out.power))
        out.power = min(losses)[1]
    return out


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_rows: int = 8000, doc_id: str = "doc_id", text: str = "text") -> Tables:
    """Tables from at most ``sample_rows`` labelled rows (doc_id, domain), chosen by a hash of the id."""
    rows = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scratch = Scratch(docs.sparkSession, "mixing-sample")
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("domain").alias("domain"))
    sample = scratch.keep(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))), "sample")  # sample_rows at most
    # one half of the sample gives the lexicon, the other the tables, so that these know how far words can be trusted
    lexicon = lexicon_of(sample.where("half = 0"), domains)

    def run(batches):
        for batch in batches:
            x = [numbers_of(t.as_py(), lexicon, len(domains))[1] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "domain"])

    got = sorted(tuple(r) for r in sample.where("half = 1").select("text", "domain").mapInArrow(run, "x array<double>, domain string").collect())
    scratch.drop(sample)
    x = np.array([r[0] for r in got], float).reshape(len(got), N_NUMBERS + len(domains))
    y = np.array([domains.index(r[1]) for r in got], np.int64)
    out = fit_tables(domains, x, y, np.ones(len(y)))
    out.lexicon = lexicon
    return out


def posteriors(docs: DataFrame, tables: Tables, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens, p (one probability per domain) of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # LEXICON words and a few hundred numbers

    def run(batches):
        for batch in batches:
            got = [shared.value.numbers(t.as_py()) for t in batch.column(1)]
            p = shared.value.posterior(np.array([g[1] for g in got], float).reshape(len(got), N_NUMBERS + len(shared.value.domains)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "tokens", "p"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, tokens bigint, p array<double>")


def _sums(rows: DataFrame, tables: Tables, tried: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For every x tried: half the squared distance of its rates from one, the expected tokens per domain, and the cells of
    sum of tokens * posterior * posterior^T over documents above their bound. One pass over the table."""
    d = len(tables.domains)
    width = 1 + d + d * d
    shared = rows.sparkSession.sparkContext.broadcast((tables, tried))

    def run(batches):
        tables, tried = shared.value
        out = np.zeros((len(tried), width))
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            t = np.asarray(batch.column(0)).astype(float)
            bound = tables.bounds(p)
            for cells, x in zip(out, tried):
                free = 1 - p @ x
                r = np.maximum(bound, free)
                cells[0] += 0.5 * (t * (r - 1) ** 2).sum()
                cells[1 : d + 1] += (t * r) @ p
                above = free > bound
                cells[d + 1 :] += ((p[above] * t[above, None]).T @ p[above]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["cell", "value"])

    summed = rows.select("tokens", "p").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(len(tried) * width)
    for cell, value in summed.collect():  # one row per cell
        out[cell] = value
    return [(c[0], c[1 : d + 1], c[d + 1 :].reshape(d, d)) for c in out.reshape(-1, width)]


LENGTHS = 0.5 ** np.array([0, 1, 2, 3, 5, 8, 12])  # step lengths tried in one pass
RIDGE = 1e-11  # of the tokens: keeps x finite where no rates meet the targets


def fit_rates(
    rows: DataFrame, tables: Tables, targets: Mapping[str, float], least_rate: float, anchor: str | None = None, keep: str | None = None, most_passes: int = 60, tolerance: float = 1e-9
) -> Tables:
    """Adds x and the gap that it leaves to the tables."""
    d = len(tables.domains)
    tables.least_rate, tables.keep = least_rate, None if keep is None else tables.domains.index(keep)
    weights = np.array([targets[k] for k in tables.domains], float)
    weights = weights / weights.sum()
    zero = np.zeros(d)
    (value, now, m), = _sums(rows, tables, [zero])
    tables.x, tables.passes = zero, 1
    if now.sum() == 0:
        return tables
    totals = now[weights > 0] / weights[weights > 0]
    wanted = weights * (totals.max() if anchor is None else now[tables.domains.index(anchor)] / weights[tables.domains.index(anchor)])
    ridge = RIDGE * now.sum()
    height = lambda x, value, now: value + x @ (now - wanted) - 0.5 * ridge * x @ x  # what the steps raise
    while tables.passes < most_passes:
        gap = now - wanted - ridge * tables.x
        if np.abs(gap).max() <= tolerance * wanted.sum():
            break
        # documents at their bound do not answer to x; without any above, the metric is that of all tokens
        step = np.linalg.solve(m + (ridge + 1e-12 * np.trace(m) + (0 if m.any() else now.sum())) * np.eye(d), gap)
        tried = [tables.x + length * step for length in LENGTHS]
        sums = _sums(rows, tables, tried)
        tables.passes += 1
        heights = [height(x, *found[:2]) for x, found in zip(tried, sums)]
        best = int(np.argmax(heights))
        if heights[best] <= height(tables.x, value, now) * (1 + 1e-15):
            break  # the sums' last bits are reached
        tables.x, (value, now, m) = tried[best], sums[best]
    tables.gap = float(np.abs(now - wanted).max() / wanted.sum())
    tables.x = np.round(tables.x, 12)  # sums may differ in their last bits
    return tables


def told(tables: Tables, tolerance: float = 1e-6) -> Tables:
    """Says so where the targets are missed by more than the tolerance."""
    if tables.gap > tolerance:
        warnings.warn(f"mixing targets are out of reach: the nearest totals are off by {tables.gap:.2e} of the tokens", stacklevel=3)
    return tables


def copies_of(ids: Column, rate: Column, seed: int) -> Column:
    """How often a document is taken."""
    draw = (F.xxhash64(ids, F.lit(seed)).cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("double") / F.lit(2.0**64)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def mix(
    spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], least_rate: float = 0.0, anchor: str | None = None,
    keep: str | None = None, doc_id: str = "doc_id", text: str = "text", seed: int = 11,
) -> DataFrame:
    """doc_id, tokens, p, rate, copies and gap (the same in all rows) of every row; ``labelled``: doc_id, domain."""
    tables = train(docs, labelled, sorted(targets), doc_id=doc_id, text=text)
    rows = Scratch(spark, "mixing").keep(posteriors(docs, tables, doc_id, text), "rows")
    tables = told(fit_rates(rows, tables, targets, least_rate, anchor, keep))
    shared = spark.sparkContext.broadcast(tables)

    def run(batches):
        d = len(shared.value.domains)
        for batch in batches:
            p = np.asarray(batch.column(2).values).reshape(-1, d) if batch.num_rows else np.empty((0, d))
            rates = np.round(shared.value.rates(p), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates, pa.float64())], names=[*batch.schema.names, "rate"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    rated = rows.mapInArrow(run, f"doc_id {kind}, tokens bigint, p array<double>, rate double")
    return rated.withColumns({"copies": copies_of(F.col("doc_id"), F.col("rate"), seed), "gap": F.lit(tables.gap)})


def apply_mix(
    spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], least_rate: float = 0.0, anchor: str | None = None,
    keep: str | None = None, doc_id: str = "doc_id", text: str = "text", seed: int = 11,
) -> DataFrame:
    """The rows of docs, each as often as its rate says, with the columns of docs. Rates are found without a shuffle
    of texts: the last pass computes them from the texts again."""
    tables = train(docs, labelled, sorted(targets), doc_id=doc_id, text=text)
    scratch = Scratch(spark, "mixing")
    rows = scratch.keep(posteriors(docs, tables, doc_id, text), "rows")
    tables = told(fit_rates(rows, tables, targets, least_rate, anchor, keep))
    scratch.drop(rows)
    shared = spark.sparkContext.broadcast(tables)
    at = docs.columns.index(text)
    name = "rate"
    while name in docs.columns:
        name += "_"

    def run(batches):
        for batch in batches:
            x = [shared.value.numbers(t.as_py())[1] for t in batch.column(at)]
            p = shared.value.posterior(np.array(x, float).reshape(len(x), N_NUMBERS + len(shared.value.domains)))
            rates = np.round(shared.value.rates(p), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates, pa.float64())], names=[*batch.schema.names, name])

    rated = docs.mapInArrow(run, with_column(docs, name, "double"))
    times = F.array_repeat(F.lit(0), copies_of(F.col(doc_id), F.col(name), seed))
    return rated.select(*docs.columns, F.explode(times).alias("again_" + name)).select(*docs.columns)
