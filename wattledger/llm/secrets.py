"""Secret scans: fixed patterns, and password guess costs of values in a credential context.

The guess cost of a value is the least product of segment guesses over all its segmentations into dictionary
words, dates, repeats, keyboard walks and brute-force characters, found by dynamic programming. A value in a
credential context that no cheap segmentation explains is a secret (kind ``guess``): its cost is ``least_cost`` or more, or
at least ``BRUTE_SHARE`` of what brute force alone needs, so that short random values count too. Words and their ranks come
from a public vocabulary file, ordered by the rank of their merges. A value of letters only that is no sequence of ``PHRASE`` such
words, but whose letters follow each other as those of words do, is taken for a word that the file lacks, not a secret.

Credential contexts are a name whose parts (at ``_``, ``-``, ``.``, digits and changes of case) hold a credential word, before
``:``, ``=``, ``=>`` or ``is``; a command-line option or an element of such a name; the password of a URL; a bearer or basic
token. ``author`` and ``opinion`` hold none. A value that lies in a base span is not reported a second time.

Results: null and empty texts have no spans; very long texts are scanned whole, and a value's cost takes time in
proportion to its length; repeated rows are scanned alike; an empty table gives an empty table; only the named
columns are read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int, str, int]  # start, end, kind, order of the kind

KINDS = ["assign", "access", "hex", "guess"]
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")  # a text without any of them has no match
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
# Words that announce a credential as a part of a name, and those that do so at the end of a part.
NAME_WORDS = {
    "pass", "pwd", "password", "passwd", "passphrase", "passcode", "secret", "token", "key", "apikey", "auth", "cred", "creds", "credential",
    "credentials", "bearer", "login", "pin", "secrets", "tokens", "keys", "passwords",
}
NAME_ENDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "accesskey", "secretkey", "privatekey", "authkey", "credential", "userpass", "dbpass")
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "bearer", "basic", "login", "pin", "://")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HOLDS = r"(?=[A-Za-z0-9_.-]*?(?:pass|pwd|secret|token|key|auth|cred|bearer|login|pin))"  # tried once for each name
VALUE = r"""([^\s"'<>,;]{6,})"""
CONTEXT = re.compile(
    rf"""(?<![A-Za-z0-9_.-]){HOLDS}([A-Za-z0-9_.-]++)["']?(?:[ \t]*(?::=|=>|[:=])[ \t]*|[ \t]+is[ \t]+)["']?{VALUE}""", re.IGNORECASE
)
OPTION = re.compile(rf"""(?<!\S)--?{HOLDS}([A-Za-z0-9_.-]++)[ \t]+["']?{VALUE}""", re.IGNORECASE)
ELEMENT = re.compile(rf"<{HOLDS}([A-Za-z0-9_.-]++)>[ \t]*{VALUE}[ \t]*</", re.IGNORECASE)
USER_INFO = re.compile(r"://[^\s/:@?#]{1,256}:([^\s/@]{6,})@")
SCHEME = re.compile(r"(?<![A-Za-z0-9])(?:bearer|basic)[ \t]+([A-Za-z0-9+/_.~=-]{6,})", re.IGNORECASE)
IS = re.compile(r"[ \t]is[ \t]")
BRUTE_SHARE = 0.95
PHRASE = 4  # so many words one after the other are a pass phrase, not a word
KEY_ROWS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "qwertzuiop", "azertyuiop"]
DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?"
    r"|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:(?:19|20)\d\d|\d\d)"
)
LEET = str.maketrans("01345$@7!", "oleassati")


def word_ranks(vocabulary: bytes, least: int = 3) -> dict[str, int]:
    """Whole words of a vocabulary file, ranked in its order; at most as many as the file has."""
    vocab = json.loads(vocabulary)["model"]["vocab"]
    words = [t[:-4] for t, _ in sorted(vocab.items(), key=lambda kv: kv[1]) if t.endswith("</w>")]
    return {w: rank for rank, w in enumerate((w for w in words if len(w) >= least and w.isalpha()), 1)}


def _neighbours() -> set[str]:
    out = set()
    for row in KEY_ROWS:
        out |= {a + b for a, b in zip(row, row[1:])} | {b + a for a, b in zip(row, row[1:])}
    return out


def is_credential_name(name: str) -> bool:
    parts = [p.lower() for p in PARTS.findall(name)]
    return any(p in NAME_WORDS or p.endswith(NAME_ENDS) for p in parts) or "apikey" in "".join(parts)


class Letters:
    """Whether letters follow each other as in the words of a vocabulary: pairs of neighbours, counted over its words."""

    LONGEST = 20

    def __init__(self, words):
        counts = np.ones((27, 27))
        for word in words:
            at = self._codes(word)
            np.add.at(counts, (at[:-1], at[1:]), 1)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))
        scores = sorted(self.score(w) for w in words if len(w) >= 6)
        self.least = scores[len(scores) // 50] if scores else 0.0  # all but one in fifty of the long words

    @staticmethod
    def _codes(word: str) -> np.ndarray:
        plain = unicodedata.normalize("NFKD", word.lower().replace("ß", "ss").replace("ł", "l").replace("ø", "o"))
        return np.array([0, *(ord(c) - 96 for c in plain if "a" <= c <= "z"), 0])

    def score(self, word: str) -> float:
        """Mean logarithm of the chance of a letter after its neighbour."""
        at = self._codes(word)
        return float(self.log[at[:-1], at[1:]].mean())

    def like_a_word(self, value: str) -> bool:
        """Letters only, but for hyphens inside and marks after them, in one case (a capital may begin a part)."""
        parts = value.rstrip(".,;:!?)").replace("'", "-").replace("\u2019", "-").split("-")
        if not all(p.isalpha() and len(p) <= self.LONGEST and (p.islower() or p.isupper() or p[1:].islower() or len(p) == 1) for p in parts):
            return False
        return all(self.score(p) >= self.least for p in parts if len(p) > 2)


class GuessCost:
    """log10 of the guesses that the cheapest segmentation of a value needs."""

    LONGEST_WORD = 20

    def __init__(self, ranks: dict[str, int]):
        self.ranks, self.near = ranks, _neighbours()

    def cost(self, value: str) -> float:
        return self.segments(value)[0]

    @staticmethod
    def alphabet(c: str) -> float:
        """log10 of the size of a brute-force character's class."""
        if c.isdigit():
            return 1.0
        if c.isalpha():
            return log10(26) if c.isascii() else 2.0
        return log10(33)

    def brute(self, value: str) -> float:
        """log10 of the guesses of brute force alone."""
        return sum(self.alphabet(c) + (log10(2) if o != c else 0.0) for o, c in zip(value, value.lower()))

    def segments(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """The least cost and its segments (start, end, kind)."""
        n = len(value)
        low = value.lower()
        plain = low.translate(LEET)
        dates = {}
        for i in range(n):
            if low[i].isdigit() and (m := DATE.match(low, i)):
                dates.setdefault(i, []).append(m.end())
        repeat_end, walk_end = [n] * n, [n] * n
        for i in range(n - 2, -1, -1):
            repeat_end[i] = repeat_end[i + 1] if low[i] == low[i + 1] else i + 1
            walk_end[i] = walk_end[i + 1] if low[i : i + 2] in self.near else i + 1
        best = [0.0] + [float("inf")] * n
        back: list[tuple[int, str]] = [(0, "")] * (n + 1)

        def offer(i: int, j: int, kind: str, cost: float) -> None:
            if best[i] + cost < best[j]:
                best[j], back[j] = best[i] + cost, (i, kind)

        for i in range(n):
            c = low[i]
            # a capital letter doubles the guesses of its segment; a brute-force character has two cases
            offer(i, i + 1, "brute", self.alphabet(c) + (log10(2) if value[i] != c else 0.0))
            if (j := repeat_end[i]) - i >= 3:
                offer(i, j, "repeat", self.alphabet(c) + log10(j - i))
            if (j := walk_end[i]) - i >= 3:
                offer(i, j, "walk", log10(4 * len(KEY_ROWS) * 12) + log10(j - i))
            for j in dates.get(i, ()):
                offer(i, j, "date", log10(365 * 120) if j - i > 4 else log10(120))
            if plain[i].isalpha():
                for j in range(i + 3, min(n, i + self.LONGEST_WORD) + 1):
                    rank = self.ranks.get(low[i:j])
                    swaps = 0
                    if rank is None and (rank := self.ranks.get(plain[i:j])) is not None:
                        swaps = sum(a != b for a, b in zip(low[i:j], plain[i:j]))
                    if rank is not None:
                        capitals = sum(a != b for a, b in zip(value[i:j], low[i:j]))
                        offer(i, j, "word", log10(rank + 1) + log10(2) * (min(capitals, 2) + swaps))
        out, j = [], n
        while j:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
        return best[n], out[::-1]


class Scanner:
    def __init__(self, vocabulary: bytes, least_cost: float):
        ranks = word_ranks(vocabulary)
        self.guess, self.letters = GuessCost(ranks), Letters([w for w in ranks if w.isascii()])
        self.least_cost = least_cost

    def base(self, text: str) -> list[Span]:
        spans: list[Span] = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            spans += [(*m.span(), "assign", 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            spans += [(*m.span(), "access", 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        spans += [(*m.span(), "hex", 2) for m in HEX.finditer(text)]
        spans.sort(key=lambda s: (s[0], s[3]))
        return spans

    def added(self, text: str) -> list[Span]:
        """Values in a credential context that cost ``10 ** least_cost`` guesses, or nearly all that brute force needs."""
        low = text.lower()
        if not any(w in low for w in CONTEXT_WORDS):
            return []
        found = []
        for pattern, named, sign in ((CONTEXT, True, ""), (OPTION, True, "-"), (ELEMENT, True, "</"), (USER_INFO, False, "://"), (SCHEME, False, "")):
            if sign not in low or (pattern is CONTEXT and not (":" in low or "=" in low or IS.search(low))):
                continue
            for m in pattern.finditer(text):
                if (not named or is_credential_name(m[1])) and self.secret(m[2] if named else m[1]):
                    found.append(m.span(2 if named else 1))
        return [(start, end, "guess", 3) for start, end in sorted(set(found))]

    def secret(self, value: str) -> bool:
        cost, segments = self.guess.segments(value)
        if cost < self.least_cost and cost < BRUTE_SHARE * self.guess.brute(value):
            return False
        phrase = len(segments) >= PHRASE and all(kind == "word" for *_, kind in segments)
        return phrase or not self.letters.like_a_word(value)

    def scan(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans; an added one that lies in a base span says nothing new."""
        base = self.base(text)
        added, k, reach = [], 0, -1
        for span in self.added(text):
            while k < len(base) and base[k][0] <= span[0]:
                reach = max(reach, base[k][1])
                k += 1
            if span[1] > reach:
                added.append(span)
        return base, sorted(base + added, key=lambda s: (s[0], s[3]))


_SCANNERS: dict[tuple[int, float], Scanner] = {}


def _scanner(vocabulary: bytes, least_cost: float) -> Scanner:
    key = hash(vocabulary), least_cost
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(vocabulary, least_cost)
    return _SCANNERS[key]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every stretch covered by spans replaced by the kind of its first span."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        start, end, kind, _ = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def find_secrets(
    docs: DataFrame, vocabulary: bytes, doc_id: str = "doc_id", text: str = "text", least_cost: float = 10.0
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary file, a few MB

    def run(batches):
        scanner = _scanner(shared.value, least_cost)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for value in batch.column(1):
                base, every = scanner.scan(value.as_py())
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[3] == k for s in every))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame, vocabulary: bytes, text: str = "text", least_cost: float = 10.0) -> DataFrame:
    """The same rows and columns with every secret replaced by its kind in brackets; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary file, a few MB
    at = docs.columns.index(text)

    def run(batches):
        scanner = _scanner(shared.value, least_cost)
        for batch in batches:
            texts = [None if t is None else redacted(t, scanner.scan(t)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
