"""Toxicity: noisy-channel deobfuscation, then a lexicon score of the restored text.

1. Letter trigrams are counted over all texts (one pass, counts added per task) and give a smoothed character
   language model.
2. A disguised token (digits or symbols for letters, letters set apart by marks of any kind, letters repeated) and a
   stretch of parts of up to three characters set apart by white space is a lattice of readings: a character may be a
   letter, stand for one at a price, or be dropped at a price if it is no letter or digit or repeats its neighbour.
   Viterbi decoding under the language model, over all pairs of letters, gives the likeliest reading for each pair of last
   letters; the ``keep`` best of them count. Where marks or spaces set parts apart, words may start and end at any part, so
   scoring looks up every stretch of parts ("a m o r o n", "you-mo-ron"). Tokens above ``WINDOW`` characters are
   decoded in windows of whole parts that overlap by half; a part without marks is decoded whole, however long.
   Scoring decodes only what may hide a word of the lexicon: letters are put into classes that no reading leaves, repetition
   and marks are removed, and the first four classes of a lexicon word whose bound is ``HIDDEN_SHARE`` or more must be there.
3. Words and word beginnings of restored texts are counted per class over a bounded sample of labelled training
   documents (``per_class`` of each class; equal texts count once). Features whose share of toxic documents has a lower confidence bound
   above ``least_share`` form the lexicon: at the given bound a word in no clean text needs ``LEAST_SUPPORT`` toxic ones or
   a few more, whatever the size of the sample.
4. A text's score is a logistic function of its three strongest tokens and its length. Its weights are fitted on one
   half of the sample with a lexicon of the other half, so that chance words do not count for more than they are worth.

Results: null and empty texts have no tokens and get the score of that; very long texts are read whole; repeated rows are scored
alike; of a labelled id with several texts the first in order is learned from; without labels of both classes every score is the same and below 0.01; a null id is not held out; an empty table gives
an empty table; other columns are not inputs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm.common import release_memory, remainder, sample_labelled, with_column

LETTERS = "abcdefghijklmnopqrstuvwxyz"
A = len(LETTERS) + 1  # 0 is everything else
LEAST_SHARE = 0.3
LEAST_ODDS = log(LEAST_SHARE / (1 - LEAST_SHARE))
LOWEST_MARGIN = -5.0  # of every text where the labels do not have both classes
# Readings of characters that stand for letters, in the order of their use.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "%": "o",
}
SUBSTITUTION, DROP = 1.0, 0.7  # prices in nats
APART = re.compile(r"(?<!\S)\S{1,3}(?:\s+\S{1,3})+(?!\S)")
RUN = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"([^\W\d_])\1(?:\1|([^\W\d_])\2)")  # three in a row, or two pairs side by side
LONG_RUN = re.compile(r"(.)\1{3,}")
BREAK = re.compile(r"[\W_]+")
CONTRACTED = re.compile(r"[^\W\d_]+['`\u2019](?:ll|re|ve|s|t|d|m)")  # he'll is not hell
ENDINGS = set(",.;:?")
WINDOW = 96
LEAST_SUPPORT = 3  # toxic texts
HIDDEN_SHARE = 0.6  # lower bound of the share of toxic texts from which a word is looked for behind disguises
EDGES = ".,;:!?\"'()[]{}<>&#*%$|~_-+=/\\`^"


def _letter_codes() -> np.ndarray:
    """Code point -> 0..26; accents are dropped."""
    table = np.zeros(0x250, np.int32)
    for point in range(0x250):
        base = unicodedata.normalize("NFKD", chr(point).lower())[:1]
        table[point] = LETTERS.find({"ß": "s", "æ": "a", "ø": "o", "œ": "o"}.get(base, base)) + 1 if base else 0
    return table


CODES = _letter_codes()


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < CODES.size, CODES[np.minimum(points, CODES.size - 1)], 0)


class Fold(dict):
    """For ``str.translate``: every letter becomes the letter of its class, everything else but line breaks goes.

    Letters that one character may stand for are one class.
    """

    def __init__(self, read_symbols: bool):
        together = {c: c for c in LETTERS}
        for letters in READINGS.values():
            for other in letters[1:]:
                together[other] = together[letters[0]]
        super().__init__({point: together[LETTERS[CODES[point] - 1]] for point in range(CODES.size) if CODES[point]})
        self |= {ord(c): together[letters[0]] for c, letters in READINGS.items() if c.isalnum() or read_symbols}
        self[10] = "\n"

    def __missing__(self, point: int) -> None:
        return None


FOLDS = Fold(True), Fold(False)  # symbols read as letters; symbols dropped
SYMBOLS = re.compile("[" + re.escape("".join(c for c in READINGS if not c.isalnum())) + "]")
REPEATED = re.compile(r"(.)\1+")


def skeletons(text: str) -> list[str]:
    """The classes of a text's letters, without repetition: with symbols read, and with symbols dropped if it has any."""
    return [REPEATED.sub(r"\1", text.translate(fold)) for fold in (FOLDS if SYMBOLS.search(text) else FOLDS[:1])]


class Hints:
    """Whether a text may hide a word of the lexicon: a test that is sometimes wrongly true, never wrongly false as long as
    all its symbols are letters, or all are marks, where the first four classes stand. Nothing goes on across a line break."""

    def __init__(self, features):
        self.words: dict[str, set[str]] = defaultdict(set)
        self.short: set[str] = set()
        for feature in features:
            word = skeletons(feature.removeprefix("="))[0]
            if len(word) < 4:
                self.short.add(word)
            else:
                self.words[word[:4]].add(word)
        self.short.discard("")
        self.any_short = re.compile("|".join(sorted(self.short))) if self.short else None

    def any(self, text: str, whole: bool = False) -> bool:
        """``whole``: all classes of a word must be there, not the first four only."""
        for s in skeletons(text):
            if self.any_short and self.any_short.search(s):
                return True
            for i in range(len(s) - 3):
                found = self.words.get(s[i : i + 4])
                if found and (not whole or any(s.startswith(w, i) for w in found)):
                    return True
        return False


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Letter trigrams of all texts; the table has 27 ** 3 cells whatever the input."""

    def run(batches):
        total = np.zeros(A**3, np.int64)
        for batch in batches:
            for value in batch.column(0):
                c = np.concatenate([[0, 0], codes_of(value.as_py()), [0]])
                cell = (c[:-2] * A + c[1:-1]) * A + c[2:]
                total += np.bincount(cell[(c[1:-1] > 0) | (c[2:] > 0)], minlength=A**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    summed = texts.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(A**3, np.int64)
    for cell, n in summed.collect():  # at most 27 ** 3 rows
        out[cell] = n
    return out


def language_model(counts: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """log P(third | first two), each order smoothed by the next lower one."""
    tri = counts.reshape(A, A, A).astype(float)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1.0) / (uni.sum() + A)
    p2 = (bi + weight * p1) / (bi.sum(axis=1, keepdims=True) + weight)
    return np.log((tri + weight * p2[None]) / (tri.sum(axis=2, keepdims=True) + weight))


class Restorer:
    """Readings of disguised tokens."""

    def __init__(self, model: np.ndarray, keep: int = 4):
        self.model, self.keep = model.tolist(), keep

    @staticmethod
    def disguised(token: str) -> bool:
        """Whether a token, without marks at its edges, may hide letters."""
        if token.isalpha():
            return bool(DOUBLED.search(token))
        letters = sum(c.isalpha() for c in token)
        swapped = sum(c in READINGS for c in token)
        if not letters + swapped:
            return False
        marks = sum(not c.isalnum() for c in token)
        return (swapped > 0 and letters > 0) or (marks > 0 and letters >= 3 and not CONTRACTED.fullmatch(token)) or bool(RUN.search(token))

    @staticmethod
    def windows(token: str) -> list[str]:
        """The token, or overlapping windows of whole parts; a stretch of half a window is whole in one of them."""
        if len(token) <= WINDOW:
            return [token]
        parts = [p for p in BREAK.split(LONG_RUN.sub(r"\1\1\1", token)) if p]
        out, i, j = [], 0, 0
        while j < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(parts[j]) <= WINDOW):
                size += len(parts[j]) + 1
                j += 1
            out.append(".".join(parts[i:j]))
            size = 0
            while i < j and size < WINDOW // 2:
                size += len(parts[i]) + 1
                i += 1
        return list(dict.fromkeys(out))

    def readings(self, token: str) -> list[list[str]]:
        """The likeliest letters behind a token's parts, best first, for one window after the other."""
        return [r.split(".") for window in self.windows(token) for r in self._readings(window)]

    def _readings(self, token: str) -> list[str]:
        """Letters, with a dot where marks were dropped."""
        if not any(c in READINGS for c in token) and not any(a == b for a, b in zip(token, token[1:])):  # nothing to choose
            codes = ((c, int(CODES[ord(c)]) if ord(c) < CODES.size else 0) for c in token)
            found = "".join(LETTERS[code - 1] if code else "" if c.isalnum() else "." for c, code in codes)
            return [found] if len(found) - found.count(".") > 2 else []
        model, before = self.model, ""
        states: dict[tuple[int, int], float] = {(0, 0): 0.0}
        steps: list[dict] = []  # state -> the state before and what was written
        for c in token:
            options: list[tuple[int, float]] = []
            code = int(CODES[ord(c)]) if ord(c) < CODES.size else 0
            if code:
                options.append((code, 0.0))
            options += [(LETTERS.index(x) + 1, SUBSTITUTION) for x in READINGS.get(c, "")]
            mark = not c.isalnum()
            after: dict[tuple[int, int], float] = {}
            back: dict = {}
            for state, score in states.items():
                a, b = state
                if (mark or c == before or not options) and after.get(state, -1e300) < score - DROP:
                    after[state] = score - DROP
                    back[state] = (state, "." if mark else "")
                for code, price in options:
                    new = score - price + model[a][b][code]
                    if after.get((b, code), -1e300) < new:
                        after[b, code] = new
                        back[b, code] = (state, LETTERS[code - 1])
            steps.append(back)
            states, before = after, c
        ends = sorted(((score + model[a][b][0], (a, b)) for (a, b), score in states.items()), reverse=True)
        out: list[str] = []
        for _, state in ends[: self.keep]:
            written = []
            for back in reversed(steps):
                state, letter = back[state]
                written.append(letter)
            text = "".join(reversed(written))
            if len(text) - text.count(".") > 2:
                out.append(text)
        return list(dict.fromkeys(out))


def features_of(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f"={word}", *(word[:k] for k in range(4, min(len(word), 9)))]


def words_behind(token: str, restorer: Restorer, hints: Hints | None = None) -> tuple[list[str], list[list[str]]]:
    """A lower-case token without marks at its edges and what it may hide, as words and as parts of words."""
    bare = token.strip(EDGES)
    inner = token.strip(".,;:?\"'()[]{}&#*%~_-=/\\`^")
    hidden = []
    if inner and Restorer.disguised(inner) and (hints is None or hints.any(inner)):
        hidden = restorer.readings(inner)
    return [*([bare] if bare else []), *dict.fromkeys("".join(parts) for parts in hidden)], hidden


def features_within(parts: list[str], longest: int, beginnings: bool = True) -> Iterator[str]:
    """Features of all words that start and end between parts; their beginnings too, unless told otherwise."""
    parts = [p for p in parts if p]
    for i in range(len(parts) if len(parts) > 1 else 0):
        word = ""
        for part in parts[i:]:
            word += part
            if len(word) > 2:
                yield f"={word}"
            if len(word) > longest:
                break
        if beginnings:
            yield from (word[:k] for k in range(4, min(len(word), 9)))


def tokens_of(text: str) -> set[str]:
    return set(text.lower().split())


def doubled_tokens(low: str) -> set[str]:
    """The tokens with a letter three times or two doubled letters side by side."""
    out: set[str] = set()
    for m in DOUBLED.finditer(low):
        begin = max(low.rfind(" ", 0, m.start()), low.rfind("\n", 0, m.start())) + 1
        ends = [e for e in (low.find(" ", m.end()), low.find("\n", m.end())) if e >= 0]
        out.update(low[begin : min(ends, default=len(low))].split())  # other white space may be inside
    return out


def stretches_of(low: str) -> set[str]:
    """Parts of one to three characters set apart by white space, joined by dots."""
    return {".".join(m.split()) for m in APART.findall(low)}


def lexicon(
    sample: DataFrame, model: np.ndarray, least_share: float = LEAST_SHARE, support: int = LEAST_SUPPORT, z: float = 2.0
) -> dict[str, float]:
    """Features of the sample (text, y, w) that mark toxic texts, with the lower bounds of their shares."""

    def run(batches):
        restorer = Restorer(model)
        cache: dict[str, tuple[str, ...]] = {}
        total: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0])

        def counted() -> pa.RecordBatch:
            rows = list(total.items())
            total.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f for f, _ in rows], pa.string()),
                    *(pa.array([c[k] for _, c in rows], pa.float64()) for k in (0, 1)),
                    pa.array([c[2] for _, c in rows], pa.int64()),
                ],
                ["feature", "clean", "toxic", "n"],
            )

        for batch in batches:
            for value, y, w in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found: set[str] = set()
                for token in tokens_of(value.as_py()):
                    got = cache.get(token)
                    if got is None:
                        got = tuple(f for word in words_behind(token, restorer)[0] for f in features_of(word))
                        if len(cache) >= 30_000:
                            cache.clear()
                        cache[token] = got
                    found.update(got)
                for f in found:
                    cell = total[f]
                    cell[y] += w
                    cell[2] += y
                if len(total) > 200_000:  # partial counts; the sum follows the shuffle anyway
                    yield counted()
        yield counted()

    p = F.col("toxic") / (F.col("clean") + F.col("toxic"))
    size = F.col("n") * (F.col("clean") + F.col("toxic")) / F.col("toxic")
    bound = (p + z * z / (2 * size) - z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))) / (1 + z * z / size)
    summed = (
        sample.select("text", "y", "w").mapInArrow(run, "feature string, clean double, toxic double, n bigint")
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        .where(F.col("n") >= support).where(bound > least_share)
    )
    found = summed.collect()  # features of the bounded sample that the bound lets pass
    return _pruned([tuple(r) for r in found], least_share, support, z)


def _bound(clean: float, toxic: float, n: int, z: float) -> float:
    """Wilson's lower bound of the share of toxic texts, n of them seen."""
    p, size = toxic / (clean + toxic), n * (clean + toxic) / toxic
    return (p + z * z / (2 * size) - z * sqrt(p * (1 - p) / size + z * z / (4 * size * size))) / (1 + z * z / size)


def _pruned(rows: list[tuple[str, float, float, int]], least_share: float, support: int, z: float) -> dict[str, float]:
    """Features by falling bound; a beginning counts only for what no stronger longer feature explains."""
    ranked = sorted(((_bound(c, t, n, z), f, c, t, n) for f, c, t, n in rows), reverse=True)
    out: dict[str, float] = {}
    explained: dict[str, tuple[int, float, float]] = {}  # beginning -> counts of the best longer feature taken
    for bound, feature, clean, toxic, n in ranked:
        if bound <= least_share:
            break
        more, seen_clean, seen_toxic = explained.get(feature, (0, 0.0, 0.0))
        if more:
            n, clean, toxic = n - more, max(0.0, clean - seen_clean), toxic - seen_toxic
            if n < support or toxic <= 0 or (bound := _bound(clean, toxic, n, z)) <= least_share:
                continue
        out[feature] = bound
        word = feature.removeprefix("=")
        for k in range(4, len(word) + (feature != word)):
            if n > explained.get(word[:k], (0, 0.0, 0.0))[0]:
                explained[word[:k]] = n, clean, toxic
    return out


class Strengths(dict):
    """Token -> log odds of the best of its readings' features, above those of ``least_share``; keeps at most ``limit`` tokens."""

    def __init__(self, shares: dict[str, float], model: np.ndarray, limit: int = 150_000):
        self.shares, self.restorer, self.limit = shares, Restorer(model), limit
        self.longest = max([9, *(len(f) for f in shares)])
        strong = [f for f, share in shares.items() if share >= HIDDEN_SHARE]
        self.hints = Hints(strong)
        # words set apart are looked up whole, so only whole words of the lexicon can be found there
        self.whole = Hints(f for f in strong if f.startswith("="))
        self.starts = {f.removeprefix("=")[:4] for f in shares}

    def _strength(self, best: float) -> float:
        return log(best / (1 - best)) - LEAST_ODDS if best else 0.0

    def _best(self, word: str) -> float:
        if word[:4] not in self.starts:  # no feature of the word is in the lexicon
            return 0.0
        return max(self.shares.get(f, 0.0) for f in features_of(word))

    def __missing__(self, token: str) -> float:
        words, hidden = words_behind(token, self.restorer, self.hints)
        best = max(map(self._best, words), default=0.0)
        for parts in hidden:
            for f in features_within(parts, self.longest):
                best = max(best, self.shares.get(f, 0.0))
        if len(self) >= self.limit:
            self.clear()
        value = self[token] = self._strength(best)
        return value

    def plain(self, tokens: set[str], low: str) -> list[float]:
        """Strengths of tokens. Most are words whose first four letters begin no feature and that can hide nothing."""
        starts, shares, doubled, out = self.starts, self.shares, doubled_tokens(low), []
        for token in tokens:
            word = token[:-1] if token[-1] in ENDINGS else token
            if token in doubled or not word.isalpha():
                if value := self[token]:
                    out.append(value)
            elif word[:4] in starts:
                best = shares.get("=" + word, 0.0)
                for k in range(4, min(len(word), 9)):
                    if (share := shares.get(word[:k], 0.0)) > best:
                        best = share
                if best:
                    out.append(self._strength(best))
        return out

    def apart(self, low: str) -> list[float]:
        """Strengths of what stretches of short parts hide. Beginnings count only where all parts are single letters, as
        neighbouring short words would otherwise begin many a word."""
        stretches = stretches_of(low)
        if not stretches or not self.hints.any("\n".join(stretches), whole=True):
            return []
        out = []
        for stretch in stretches:
            letters = all(len(p.strip(EDGES)) <= 1 for p in stretch.split("."))
            if not (self.hints if letters else self.whole).any(stretch, whole=True):
                continue
            best = 0.0
            for parts in self.restorer.readings(stretch):
                for f in features_within(parts, self.longest, beginnings=letters):
                    best = max(best, self.shares.get(f, 0.0))
            if best:
                out.append(self._strength(best))
        return out

    def numbers(self, text: str | None) -> list[float]:
        """1, the three largest strengths, the logarithm of the number of different tokens."""
        low = (text or "").lower()
        tokens = set(low.split())
        top = sorted([*self.plain(tokens, low), *self.apart(low)], reverse=True)[:3]
        return [1.0, *top, *[0.0] * (3 - len(top)), log(1 + len(tokens))]


def fit_weights(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    out = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)]) + 1e-6 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - penalty @ out)
        out = out + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return out


def _sample_numbers(sample: DataFrame, shares: dict[str, float], model: np.ndarray) -> tuple[np.ndarray, ...]:
    def run(batches):
        strengths = Strengths(shares, model)
        for batch in batches:
            x = [strengths.numbers(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "w"])

    # at most 2 * per_class short rows; sorted, so that sums do not depend on the order of tasks
    rows = sorted(tuple(r) for r in sample.select("text", "y", "w").mapInArrow(run, "x array<double>, y int, w double").collect())
    x = np.array([r[0] for r in rows], float).reshape(len(rows), 5)
    return x, np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)


@dataclass
class Model:
    """Lexicon, letter model and the weights of the score."""

    shares: dict[str, float]
    letters: np.ndarray
    weights: np.ndarray

    def scores(self, numbers: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(numbers @ self.weights, -30, 30)))


def train(
    documents: DataFrame, labels: DataFrame, train_rows, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    per_class: int = 8000,
) -> Model:
    """The letter model's counts cover every document; lexicon and weights a bounded labelled sample."""
    letters = language_model(trigram_counts(documents, text))
    chosen = sample_labelled(labels, label, per_class, train_rows)
    texts = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # at most 2 * per_class rows of an id, a class and a weight
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("w").alias("w"))
    sample = sample.dropDuplicates(["text", "y"])  # copies of a text say nothing new about its words
    sample = sample.select("text", "y", "w", (F.xxhash64("text") % 2 == 0).alias("half")).persist()
    try:
        numbers = _sample_numbers(sample.where(~F.col("half")), lexicon(sample.where("half"), letters), letters)
        x, y, w = numbers
        weights = fit_weights(x, y, w) if 0 < y.sum() < len(y) else np.array([LOWEST_MARGIN, 0.0, 0.0, 0.0, 0.0])
        return Model(lexicon(sample, letters), letters, weights)
    finally:
        sample.unpersist()


def with_scores(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """All columns of docs and the score under ``name``. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lexicon, 27 ** 3 numbers, five weights
    at = docs.columns.index(text)

    def run(batches):
        model = shared.value
        strengths = Strengths(model.shares, model.letters)
        for batch in batches:
            x = np.array([strengths.numbers(t.as_py()) for t in batch.column(at)], float).reshape(batch.num_rows, 5)
            scores = pa.array(model.scores(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])
        release_memory()

    return docs.mapInArrow(run, with_column(docs, name, "double"))


def score_documents(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; training rows are those whose crc32 modulo 5 is not 0."""
    model = train(documents, labels, remainder("doc_id", 5) != 0)
    scored = with_scores(documents.select("doc_id", "text"), model, "score")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
