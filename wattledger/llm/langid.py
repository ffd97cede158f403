"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams of one to three symbols (blended spectrum) that occur in both,
over the geometric mean of their own numbers of n-grams: presence counts, frequency does not. Symbols are the letters
of the landmark texts without case, one symbol for all other letters and one for everything else; n-grams without a
letter are left out.

1. Landmarks and sample are learning texts, chosen by a hash of the text and dealt evenly over the languages:
   ``landmarks`` and ``sample_rows`` of them bound what is fitted, whatever the table's size.
2. Nystroem: with K the kernel among landmarks and k(x) that of a text with them, the features are K^(-1/2) k(x).
   One ridge regression per language, against the rest, on the sample's features.
3. A batch of texts is a matrix of presences. Its product with the landmarks' presences gives the kernel rows, and the
   product of these with the coefficients the scores: one matrix product after the other, in tasks, without a shuffle.

The language of the largest regression value is predicted (ties: the first in alphabetical order); the score is that
value, held within 0 and 1.

Results: null texts and texts without a letter are ``und`` with score 0, as is every text when there is nothing to learn
from; very long texts are read whole, in stretches; repeated texts count once in the sample and are predicted alike; a
null id is not held out, but nothing is learned from it; an empty table gives an empty table. Only text, language and
id are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StringType, StructField, StructType

from wattledger.llm.common import Scratch, release_memory, remainder

BITS = 7  # per symbol
OTHER = 2**BITS - 1  # letters that no landmark has
STRETCH = 1 << 18  # characters looked at together
ROWS = 64  # texts of one matrix
STARTS = (0, 2**BITS, 2**BITS + 2 ** (2 * BITS))  # where n-grams of 1, 2 and 3 symbols begin
GRAMS = STARTS[2] + 2 ** (3 * BITS)
UNDECIDED = "und"


def alphabet_of(texts: list[str]) -> str:
    """The most frequent letters, without case."""
    counts = Counter(c for t in texts for c in t.lower() if c.isalpha())
    return "".join(sorted(sorted(counts, key=lambda c: (-counts[c], c))[: OTHER - 1]))


def symbols_of(alphabet: str) -> np.ndarray:
    """The symbol of every code point: 0 for what is no letter."""
    known = {c: k + 1 for k, c in enumerate(alphabet)}
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            out[i] = known.get(c.lower(), OTHER)
    return out


class Spectrum:
    """The n-grams of texts, as numbers."""

    def __init__(self, alphabet: str):
        self.symbols = symbols_of(alphabet)
        self.last = np.zeros(GRAMS, np.int32)

    def codes(self, text: str) -> Iterator[np.ndarray]:
        """The n-grams with a letter, repeated as in the text; long texts in stretches, which share their ends."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.zeros(len(points) + 2, np.uint8)  # a text begins and ends like a word
        symbols[1:-1] = self.symbols[points]
        for begin in range(0, max(1, len(points)), STRETCH):
            s = symbols[begin : begin + STRETCH + 2].astype(np.int32)
            pairs = s[:-1] << BITS | s[1:]
            triples = pairs[:-1] << BITS | s[2:]
            yield np.concatenate([s[s > 0] + STARTS[0], pairs[pairs > 0] + STARTS[1], triples[triples > 0] + STARTS[2]])

    def distinct(self, codes: np.ndarray) -> int:
        """Every n-gram is counted at the last place where it stands."""
        places = np.arange(len(codes), dtype=np.int32)
        self.last[codes] = places
        return int(np.count_nonzero(self.last[codes] == places))

    def grams(self, text: str) -> np.ndarray:
        return np.unique(np.concatenate([np.unique(c) for c in self.codes(text)]))


@dataclass
class Model:
    """known: the landmarks' n-grams; presence: which landmark has which; norms: the landmarks' numbers of n-grams."""

    alphabet: str
    known: np.ndarray
    presence: np.ndarray
    norms: np.ndarray
    languages: list[str]
    weights: np.ndarray | None = None


class Scorer:
    """Kernel rows and scores of texts; made once per task."""

    def __init__(self, model: Model):
        self.model, self.spectrum = model, Spectrum(model.alphabet)
        self.column = np.full(GRAMS, len(model.known), np.int32)  # n-grams that no landmark has share a last column
        self.column[model.known] = np.arange(len(model.known), dtype=np.int32)
        self.presence = model.presence.astype(np.float32)
        self.rows = np.zeros((ROWS, len(model.known) + 1), np.float32)

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel with every landmark, and numbers of n-grams, of at most ROWS texts."""
        rows = self.rows[: len(texts)]
        rows[:] = 0
        sizes = np.zeros(len(texts))
        for row, (k, text) in zip(rows, enumerate(texts)):
            if len(text) <= STRETCH:
                (codes,) = self.spectrum.codes(text)
                sizes[k] = self.spectrum.distinct(codes)
                row[self.column[codes]] = 1
                continue
            seen = np.zeros(GRAMS, bool)
            for codes in self.spectrum.codes(text):
                seen[codes] = True
                row[self.column[codes]] = 1
            sizes[k] = np.count_nonzero(seen)
        shared = (rows[:, :-1] @ self.presence).astype(float)
        return shared / np.sqrt(np.maximum(sizes[:, None], 1) * self.model.norms), sizes

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        k, sizes = self.kernel(texts)
        scores = np.round(k @ self.model.weights, 9)
        best = scores.argmax(axis=1)
        held = np.clip(scores[np.arange(len(texts)), best], 0, 1)
        names = [self.model.languages[b] if n else UNDECIDED for b, n in zip(best, sizes)]
        return names, [float(h) if n else 0.0 for h, n in zip(held, sizes)]


def landmarks_of(texts: list[str], languages: list[str]) -> Model:
    alphabet = alphabet_of(texts)
    spectrum = Spectrum(alphabet)
    grams = [spectrum.grams(t) for t in texts]
    known = np.unique(np.concatenate(grams))
    presence = np.zeros((len(known), len(texts)), bool)
    for k, g in enumerate(grams):
        presence[np.searchsorted(known, g), k] = True
    return Model(alphabet, known, presence, np.maximum(presence.sum(axis=0), 1.0), languages)


def fit(model: Model, kernel: np.ndarray, y: np.ndarray, ridge: float) -> None:
    """Adds the coefficients of one regression per language: kernel row -> value."""
    p = model.presence.astype(np.float32)
    k = (p.T @ p).astype(float) / np.sqrt(np.outer(model.norms, model.norms))
    value, vector = np.linalg.eigh(k)
    keep = value > 1e-9 * value.max()
    root = (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T
    features = kernel @ root
    targets = np.eye(len(model.languages))[y]
    normal = features.T @ features + ridge * len(y) * np.eye(features.shape[1])
    model.weights = root @ np.linalg.solve(normal, features.T @ targets)


ARROW = {StringType(): pa.string(), DoubleType(): pa.float64(), ArrayType(DoubleType()): pa.list_(pa.float64())}


def _with_rows(docs: DataFrame, text: str, results: Callable, fields: dict[str, DataType]) -> DataFrame:
    """docs with the columns that the function made by ``results`` gives for lists of at most ROWS texts."""
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, *(StructField(name, kind) for name, kind in fields.items())])

    def run(batches):
        given = results()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            parts = [given(texts[b : b + ROWS]) for b in range(0, len(texts), ROWS)]
            made = [pa.array([v for p in parts for v in p[k]], ARROW[kind]) for k, kind in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *fields])
        release_memory()

    return docs.mapInArrow(run, schema)


def train(
    spark: SparkSession, docs: DataFrame, learn: Column, landmarks: int = 192, sample_rows: int = 4096, ridge: float = 1e-4,
    text: str = "text", lang: str = "lang",
) -> Model | None:
    """The model from at most ``sample_rows`` texts of the rows that ``learn`` marks; None if there are none."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    ranked = rows.select("lang", "key").distinct()
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("n") <= sample_rows)
    scratch = Scratch(spark, "langid")
    chosen = scratch.keep(ranked.orderBy("n", "lang").limit(sample_rows), "chosen")
    # sample_rows rows at most; equal texts of a language are one
    sample = rows.join(F.broadcast(chosen), ["lang", "key"]).dropDuplicates(["lang", "key"])
    sample = scratch.keep(sample.select("n", "lang", "text"), "sample")
    marks = sample.orderBy("n", "lang").limit(landmarks).collect()  # the landmarks
    if not marks:
        return None
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # sample_rows at most
    model = landmarks_of([r["text"] for r in marks], languages)
    shared = spark.sparkContext.broadcast(model)

    def results():
        scorer = Scorer(shared.value)
        return lambda texts: (scorer.kernel(texts)[0].tolist(),)

    kernels = _with_rows(sample, "text", results, {"kernel": ArrayType(DoubleType())}).select("n", "lang", "kernel")
    got = sorted(tuple(r) for r in kernels.collect())  # sample_rows rows of one number per landmark
    scratch.drop(chosen, sample)
    fit(model, np.array([r[2] for r in got]), np.array([languages.index(r[1]) for r in got]), ridge)
    return model


def with_language(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score. No shuffle."""
    if model is None:
        return docs.withColumns({names[0]: F.lit(UNDECIDED), names[1]: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the landmarks' n-grams

    def results():
        return Scorer(shared.value).predict

    return _with_rows(docs, text, results, {names[0]: StringType(), names[1]: DoubleType()})


def identify(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out."""
    model = train(spark, docs, remainder(doc_id, 3) != 1, text=text, lang=lang)
    held = F.coalesce(remainder(doc_id, 3) == 1, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(doc_id).alias("doc_id"), held, F.col(text).alias("text"))
    return with_language(rows, model).drop("text")
