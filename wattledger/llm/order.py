"""Training order: token ids in fixed-stride binary shards, sequences permuted by a keyed Feistel network.

All texts, in the order of files and rows and each followed by an end token, form one stream of token ids that is
cut into sequences of ``length`` ids; only the last one is filled up with the end token. A balanced Feistel network
over the next even power of two, walked along its cycle until the value is below the number of sequences, gives
every sequence a slot of its own. Slot s is record s % ``per_shard`` of shard s // ``per_shard``; every record has
``length`` little-endian 16-bit ids (32-bit if the vocabulary asks for it), so a reader finds slot s by arithmetic
and resumes anywhere.

The stream is never sorted or collected: a first pass counts the ids of every input split (file and start of
block), their running sums are a small table, and a second pass over the same splits knows where each of its rows
begins. It fails if the splits have changed meanwhile. Where the pattern allows it, both passes cut texts at single
spaces and encode the distinct words of some MB of text once. Fragments of sequences are shuffled to their shard; a
shard's task fills one array of fixed size and writes one file under a temporary name, then renames it, so that a
repeated task replaces its own file.

Results: null and empty texts are an end token; very long texts run over many sequences; repeated rows are encoded
each; an empty table gives no sequences and no shards; only the named columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm.common import Scratch

ROUNDS = 6
M32 = np.uint64(0xFFFFFFFF)


class Feistel:
    """A bijection of 0..n-1 that depends on a key."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        digest = hashlib.blake2b(key.to_bytes(16, "little", signed=True), digest_size=8 * ROUNDS).digest()
        self.keys = np.frombuffer(digest, np.uint64)

    def _f(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._f(left, key), left
            else:
                left, right = right, left ^ self._f(right, key)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


_ENCODERS: dict[int, object] = {}


def encoder(ranks: bytes, pattern: str):
    import tiktoken

    key = hash((ranks, pattern))
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


@functools.lru_cache(maxsize=2)
def sizes_of(ranks: bytes) -> np.ndarray:
    """The number of bytes of every token."""
    pairs = [(int(b), len(base64.b64decode(a))) for a, b in map(bytes.split, ranks.splitlines())]
    out = np.zeros(max(k for k, _ in pairs) + 1, np.int64)
    for k, n in pairs:
        out[k] = n
    return out


SPACE = r"[\x{09}-\x{0d}\x{20}\x{85}\p{Z}]"
ODD = rf" {SPACE}|{SPACE} |\A | \z"  # a space that is not between two other characters
SLICE = 8 << 20  # bytes of text whose words are looked at together


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    part = (np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) - 1) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for first, end in zip(cuts, cuts[1:]):
        if end > first:
            yield texts.slice(first, end - first)


def token_ids(encoding, sizes: np.ndarray, texts: pa.Array, apart: bool) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]]:
    """For a slice of the texts at a time: ids, start and length of the runs of them that the texts consist of, and the text
    (its place in the slice) of each run.

    Special tokens in a text are ordinary text. With ``apart`` texts whose spaces all stand between other characters are
    cut there, and every distinct word of the slice is encoded once.
    """
    for part in _slices(texts.fill_null("")):
        rows = len(part)
        whole = np.ones(rows, bool)
        if apart:
            whole = pc.or_(pc.match_substring_regex(part, ODD), pc.greater(pc.binary_length(part), SLICE)).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", part), " ")
        places = split.offsets.to_numpy()
        words = split.values.slice(places[0], places[-1] - places[0])
        n_words, at_first = np.diff(places), places[:-1] - places[0]
        firsts = pc.if_else(pa.array(whole), part, words.take(pa.array(at_first)))
        later = np.ones(len(words), bool)
        later[at_first] = False
        found = words.filter(pa.array(later)).dictionary_encode()
        distinct = found.dictionary
        lone = [np.array(encoding.encode_ordinary(text), np.int64) for text in firsts.to_pylist()]
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")[0].as_py()
        joined = np.array(encoding.encode_ordinary(" " + text if len(distinct) else ""), np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes[joined])])
        want = np.concatenate([[0], np.cumsum(pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
        cuts = np.searchsorted(ends, want)
        if not np.array_equal(ends[cuts], want):
            raise ValueError("a token crosses the space between two words; texts can't be taken apart with this pattern")
        counts = np.concatenate([np.diff(cuts), np.array([ids.size for ids in lone], np.int64)])
        pool = np.concatenate([joined, *lone])
        which = np.empty(len(words), np.int32)
        which[later] = found.indices.to_numpy(zero_copy_only=False)
        which[at_first] = len(distinct) + np.arange(rows)
        starts = np.cumsum(counts) - counts
        yield pool, (starts[which], counts[which]), np.repeat(np.arange(rows, dtype=np.int32), n_words)


def count_tokens(*arguments) -> np.ndarray:
    """The number of ids of each text."""
    found = [np.bincount(row, lengths).astype(np.int64) for _, (_, lengths), row in token_ids(*arguments)]
    return np.concatenate([np.zeros(0, np.int64), *found])


def token_bytes(kind: type, *arguments) -> Iterator[bytes]:
    """The ids of each text in the shards' format."""
    width = np.dtype(kind).itemsize
    for pool, (starts, lengths), row in token_ids(*arguments):
        after = np.cumsum(lengths)
        place = np.int32 if after[-1] < 1 << 31 else np.int64
        data = pool.astype(kind)[np.repeat((starts - (after - lengths)).astype(place), lengths) + np.arange(after[-1], dtype=place)].tobytes()
        begin = 0
        for end in (after[np.flatnonzero(np.diff(row, append=-1))] * width).tolist():
            yield data[begin:end]
            begin = end


def write_file(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{hashlib.sha1(np.random.default_rng().bytes(16)).hexdigest()}"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, f"{path}/{name}")


def read_record(folder: str, slot: int, per_shard: int, length: int, kind=np.uint16) -> np.ndarray:
    """The ids in a slot, by one positioned read."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    stride = length * np.dtype(kind).itemsize
    with store.open_input_file(f"{path}/shard-{slot // per_shard:08d}.bin") as file:
        return np.frombuffer(file.read_at(stride, slot % per_shard * stride), kind)


def materialise(
    spark: SparkSession, docs: DataFrame, ranks: bytes, pattern: str, end: int, folder: str | None = None, doc_id: str = "doc_id",
    text: str = "text", length: int = 2048, per_shard: int = 1024, key: int = 20_250_101, apart: bool = False,
) -> DataFrame:
    """Writes the shards; sequence, slot, shard, record, n_tokens, first_doc_id, sha256 of every sequence.

    ``docs`` is a table read from files. ``folder`` defaults to a new one below ``spark.checkpoint.dir``.
    ``apart`` is for patterns without lookbehind that never match across a space between two other characters: the distinct
    words of some texts at a time are then encoded once. A token across such a space is an error.
    """
    scratch = Scratch(spark, "order")
    folder = folder or f"{scratch.root}/shards"
    kind = np.uint16 if end < 1 << 16 else np.uint32
    width, end_bytes = np.dtype(kind).itemsize, kind(end).tobytes()
    shared = spark.sparkContext.broadcast((ranks, pattern))  # the vocabulary file, a few MB
    rows = docs.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
    )

    def count(batches):
        encoding, sizes = encoder(*shared.value), sizes_of(shared.value[0])
        totals: dict[tuple[str, int], int] = {}
        for batch in batches:
            counts = count_tokens(encoding, sizes, batch.column(3), apart).tolist()
            for file, start, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), counts, strict=True):
                totals[file, start] = totals.get((file, start), 0) + n + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in totals]), pa.array([s for _, s in totals], pa.int64()), pa.array(totals.values(), pa.int64())],
            ["file", "start", "n"],
        ) if totals else pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["file", "start", "n"])

    # one row per split of the input, as the driver's own list of splits
    splits = sorted(tuple(r) for r in rows.mapInArrow(count, "file string, start bigint, n bigint").collect())
    base, total = {}, 0
    for file, start, n in splits:
        base[file, start] = (total, n)
        total += n
    n_sequences = -(-total // length)
    places = spark.sparkContext.broadcast(base)

    def fragments(batches):
        encoding, sizes, order = encoder(*shared.value), sizes_of(shared.value[0]), Feistel(n_sequences, key)
        split, at, left = None, 0, 0
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            encoded = token_bytes(kind, encoding, sizes, batch.column(3), apart)
            for file, start, one, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), encoded, strict=True):
                if (file, start) != split:
                    if left:
                        raise ValueError(f"the split {split} has changed between two passes")
                    split = file, start
                    if split not in places.value:
                        raise ValueError(f"the split {split} was not there in the first pass")
                    at, left = places.value[split]
                ids += end_bytes
                done, size = 0, len(ids) // width
                while done < size:
                    take = min(size - done, length - at % length)
                    out[0].append(at // length)
                    out[1].append(at % length)
                    out[2].append(one)
                    out[3].append(ids[done * width : (done + take) * width])
                    done, at, left = done + take, at + take, left - take
            sequences = np.array(out[0], np.int64)
            slots = order.slot(sequences) if sequences.size else sequences
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((slots // per_shard).astype(np.int32)), pa.array((slots % per_shard).astype(np.int32)), pa.array(sequences),
                    pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()),
                ],
                ["shard", "record", "sequence", "at", "doc_id", "ids"],
            )
        if left:
            raise ValueError(f"the split {split} has changed between two passes")

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["shard"].iat[0])
        records = min(per_shard, n_sequences - number * per_shard)
        block = np.full((records, length), end, kind)
        for record, at, ids in zip(pdf["record"], pdf["at"], pdf["ids"]):
            part = np.frombuffer(ids, kind)
            block[record, at : at + part.size] = part
        write_file(folder, f"shard-{number:08d}.bin", block.tobytes())
        pdf["size"] = pdf["ids"].map(len) // np.dtype(kind).itemsize
        first = pdf.sort_values(["record", "at"], kind="stable").groupby("record", as_index=False).agg(
            sequence=("sequence", "first"), first_doc_id=("doc_id", "first"), n_tokens=("size", "sum")
        )
        first["shard"], first["slot"] = number, first["record"] + number * per_shard
        first["sha256"] = [hashlib.sha256(block[r].tobytes()).hexdigest() for r in first["record"]]
        return first[["sequence", "slot", "shard", "record", "n_tokens", "first_doc_id", "sha256"]]

    cut = rows.mapInArrow(fragments, "shard int, record int, sequence bigint, at int, doc_id bigint, ids binary")
    schema = "sequence bigint, slot bigint, shard int, record int, n_tokens bigint, first_doc_id bigint, sha256 string"
    return cut.groupBy("shard").applyInPandas(shard, schema)
