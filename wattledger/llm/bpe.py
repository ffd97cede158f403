"""BPE encoding and decoding with a public vocabulary file.

A word is a doubly linked list of symbols. A heap holds the rank of every adjacent pair; the pair of least
rank, leftmost first, is merged, its two neighbours are pushed, and entries whose symbols have changed
meanwhile are skipped. Decoding concatenates the vocabulary's strings.

Results: null text counts as empty; empty text has no tokens and empty decoded text; very long texts are
encoded whole, word by word, in time linear in their words and special tokens; repeated rows are encoded alike; an empty table gives an empty table. Only the
two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm.common import release_memory

# Fixed values of the file format: the white space of its patterns, and its letters, numbers and lower-case letters beyond
# those of Unicode 15.1 (first and last code point; the distance to the lower-case letter).
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNICODE = "15.1"
MORE_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
MORE_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
]
MORE_LOWER = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]
LOWER = {i: i + distance for first, last, distance in MORE_LOWER for i in range(first, last + 1)}
BMP = 0x10000  # code points below have a table in a character class; those from here on are tried one by one
ASCII_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^{SPACE}a-z0-9]+")  # of lower-case ASCII


def _class(kind: str, more: list[tuple[int, int]], end: int) -> str:
    """Ranges of the code points of a general category below ``end``, as a part of a character class."""
    ranges = []
    for i in range(end):
        if unicodedata.category(chr(i))[0] == kind:
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*ranges, *more] if a < end)


def word_pattern(end: int) -> re.Pattern:
    """The words of lower-case texts of code points below ``end``."""
    letter, number = _class("L", MORE_LETTERS, end), _class("N", MORE_NUMBERS, end)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+")


END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character of each byte: itself where printable in Latin-1, else from U+0100 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = [""] * 256
    for b in keep:
        out[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if b not in set(keep)):
        out[b] = chr(256 + k)
    return out


class WordBpe:
    """Encoder and decoder; ``limit`` bounds the bytes of the words kept as already encoded."""

    def __init__(self, data: bytes, limit: int = 48 << 20):
        spec = json.loads(data)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        # key of a pair of ids -> (rank, id of the merged symbol)
        self.merges = {
            self.vocab[a] << 24 | self.vocab[b]: (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.spelled = {str(i): t for i, t in self.tokens.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        symbols = byte_symbols()
        self.inner = [self.vocab[c] for c in symbols]
        self.final = [self.vocab[c + END] for c in symbols]
        self.word, self.bmp_word = word_pattern(0x110000), word_pattern(BMP)
        self.known = _Known(self, limit)

    def merge(self, word: str) -> list[int]:
        """The ids of one word."""
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []  # rank and position in one number
        for i in range(n - 1):
            if found := merges.get(ids[i] << 24 | ids[i + 1]):
                heap.append(found[0] << 32 | i)
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j = right[i]
            if ids[i] < 0 or j < 0:
                continue
            found = merges.get(ids[i] << 24 | ids[j])
            if found is None or found[0] != entry >> 32:
                continue  # stale: a symbol of the pair was merged before
            ids[i] = found[1]
            ids[j] = -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if found := merges.get(ids[i] << 24 | ids[k]):
                    heappush(heap, found[0] << 32 | i)
            if (h := left[i]) >= 0 and (found := merges.get(ids[h] << 24 | ids[i])):
                heappush(heap, found[0] << 32 | h)
        return [i for i in ids if i >= 0]

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if text.isascii():
            return ASCII_WORD.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # the lower-case form of a letter does not depend on its neighbours here, as that of a sigma does in lower()
        low = text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)
        if len(low.encode("utf-16-le", "surrogatepass")) > 2 * len(low):
            return self.word.findall(low.translate(LOWER))
        if any(chr(i) in low for i in LOWER if i < BMP):
            low = low.translate(LOWER)
        return self.bmp_word.findall(low)

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special tokens; whether each part is one."""
        if self.split_special is None or not any(s in text for s in self.special):
            yield text, False
            return
        for k, part in enumerate(self.split_special.split(text)):
            if part:
                yield part, bool(k % 2)

    def spell(self, text: str) -> str:
        """The ids of a text in decimal, joined by one space; a word already met is not merged again."""
        out: list[str] = []
        for part, is_special in self.segments(text):
            if is_special:
                out.append(str(self.special[part]))
            else:
                out.extend(map(self.known.__getitem__, self.words(part)))
        return " ".join(out)

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.spell(text).split()))

    def decode(self, ids: list[int], joiner: str = " ") -> str:
        """The vocabulary's strings, concatenated with the joiner that a file without a decoder asks for."""
        return joiner.join(self.tokens[i] for i in ids if i in self.tokens)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids as text, decoded text."""
        ids = self.spell(text)
        found = ids.split()
        return len(found), ids, " ".join(map(self.spelled.__getitem__, found))


class _Known(dict):
    """Words and their ids as text, in bounded memory: when the younger half is full it becomes the older, so that words in
    use stay. They are kept from task to task."""

    def __init__(self, bpe: WordBpe, limit: int):
        self.bpe, self.half, self.used, self.old = bpe, limit // 2, 0, {}

    def __missing__(self, word: str) -> str:
        ids = self.old.get(word)
        if ids is None:
            ids = " ".join(map(str, self.bpe.merge(word)))
        if len(word) <= 64:
            self.used += 220 + 2 * len(word) + len(ids)  # two strings and their places in two tables
            if self.used > self.half:
                self.old, self.used = dict(self), 0
                self.clear()
            self[word] = ids
        return ids


_LOADED: dict[int, WordBpe] = {}


@contextmanager
def loaded(data: bytes) -> Iterator[WordBpe]:
    """One encoder per worker process and file, with the words that it knows."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(data)
    try:
        yield _LOADED[key]
    finally:
        release_memory()


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def encode(docs: DataFrame, vocabulary: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary file, a few MB

    def run(batches):
        with loaded(shared.value) as bpe:
            for batch in batches:
                ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return _texts(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def encode_digest(
    docs: DataFrame, vocabulary: bytes, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, and if asked for the ids themselves."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary file, a few MB

    def run(batches):
        with loaded(shared.value) as bpe:
            for batch in batches:
                counts, spelled, words, ids = [], [], [], []
                for value in batch.column(1):
                    n, i, w = bpe.digest(value.as_py())
                    counts.append(n)
                    spelled.append(hashlib.sha256(i.encode()).hexdigest())
                    words.append(hashlib.sha256(w.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        ids.append(np.array(i.split(), np.int32))
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(spelled, pa.string()), pa.array(words, pa.string())]
                columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _texts(docs, doc_id, text).mapInArrow(run, schema)
