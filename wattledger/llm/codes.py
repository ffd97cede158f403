"""Vector code compression: product codes by active-entry Lloyd rounds over integers.

1. Components become floor(scale * x); a vector is cut into equal consecutive parts. Every part position has a codebook,
   whose entries start as that part of the vectors of least id.
2. A round assigns every part to its codebook's nearest entry and then replaces each entry by the floor of its parts'
   mean. Rows carry their codes and exact squared distances from round to round. A part whose assigned entry has not
   moved since compares only the entries that have, against its stored distance; all other parts compare every entry.
   Ties go to the lower index, also between a stored and a moved entry.
3. Sums per entry are made in the tasks; the driver sees one number per cell of the codebooks, whatever the rows.

Every round's rows are written to the shared folder and read again.

Results: null and empty vectors and vectors with a null or non-finite component are dropped, as are vectors of another
length than that of the least id's first vector whose length the parts divide; components beyond 2^28 in size are taken
as that; repeated rows and ids get equal codes (the first codebook takes rows by id, nulls last, then by vector, so
that a repeated row may fill several entries, of which the lowest is used); with fewer rows than entries the codebooks
are shorter; rows with a null id or label take part; an empty table gives an empty table. Only the named columns are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm.common import Scratch
from wattledger.llm.vectors import usable

LARGEST = 2**28  # squared differences of a part's components stay within 64 bits
ROWS = 2048  # rows compared at once


@dataclass
class Codebooks:
    """entries: part, entry, position within the part; moved: which entries the last update changed."""

    entries: np.ndarray
    moved: np.ndarray

    def nearest(self, x: np.ndarray, part: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest of the nearest given entries, and its squared distance, for every row of x."""
        book = self.entries[part, among]
        distance = np.zeros((len(x), len(book)), np.int64)
        for k in range(x.shape[1]):
            distance += (x[:, k, None] - book[None, :, k]) ** 2
        at = distance.argmin(axis=1)
        return among[at], distance[np.arange(len(x)), at]

    def assign(self, x: np.ndarray, code: np.ndarray | None, distance: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances of rows (row, part, position), from those of the round before, if any."""
        n, parts, _ = x.shape
        everything = np.arange(self.entries.shape[1])
        out, least = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
        for p in range(parts):
            if code is None:
                out[:, p], least[:, p] = self.nearest(x[:, p], p, everything)
                continue
            out[:, p], least[:, p] = code[:, p], distance[:, p]
            active = np.flatnonzero(self.moved[p])
            lost = self.moved[p][code[:, p]]  # the assigned entry has moved: the stored distance no longer holds
            if lost.any():
                out[lost, p], least[lost, p] = self.nearest(x[lost, p], p, everything)
            if len(active) and not lost.all():
                stay = np.flatnonzero(~lost)
                entry, d = self.nearest(x[stay, p], p, active)
                better = (d < least[stay, p]) | ((d == least[stay, p]) & (entry < out[stay, p]))
                out[stay[better], p], least[stay[better], p] = entry[better], d[better]
        return out, least

    def updated(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        return Codebooks(new, (new != self.entries).any(axis=2))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: np.ndarray) -> np.ndarray:
        """The vectors that codes (row, part) stand for, as integers."""
        parts = np.arange(code.shape[1])
        return self.entries[parts[None, :], code].reshape(len(code), -1)


def _vectors(column: pa.Array, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def _rounds(books: Codebooks, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts = books.entries.shape[0]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                rows = batch.slice(begin, ROWS)
                code = distance = None
                if not first:
                    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), ">u2").reshape(-1, parts).astype(np.int64)
                    distance = rows.column("distance").flatten().to_numpy().reshape(-1, parts)
                code, distance = books.assign(_vectors(rows.column("v"), parts), code, distance)
                packed = [c.tobytes() for c in code.astype(">u2")]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("vec_id", "label", "v")), pa.array(packed, pa.binary()), pa.array(list(distance), pa.list_(pa.int64()))],
                    ["vec_id", "label", "v", "code", "distance"],
                )

    return run


def _sums(rows: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the assigned parts' components, and numbers of them, per entry."""
    parts, entries, width = books.entries.shape

    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), ">u2").reshape(-1, parts).astype(np.int64)
            x = _vectors(batch.column("v"), parts)
            for p in range(parts):
                np.add.at(total[p, :, :width], code[:, p], x[:, p])
                total[p, :, width] += np.bincount(code[:, p], minlength=entries)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.ravel()[cells], pa.int64())], ["cell", "value"])

    summed = rows.select("code", "v").mapInArrow(run, "cell bigint, value bigint").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for cell, value in summed.collect():  # at most one row per cell of the codebooks
        total[cell] = value
    total = total.reshape(parts, entries, width + 1)
    return total[..., :width], total[..., width]


def integers(vectors: DataFrame, scale: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, v (integers) of the usable rows."""
    x = F.col(vector)
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale).cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST))).cast("int"))
    return vectors.where(usable(x)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


def compress(
    spark: SparkSession, vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code (two bytes per part), distance (squared, per part), and the final codebooks."""
    scratch = Scratch(spark, "codes")
    rows = integers(vectors, scale, vec_id, vector, label)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = rows.where(F.size("v") % parts == 0).orderBy(*order).limit(1).collect()
    length = len(first[0]["v"]) if first else parts
    rows = scratch.keep(rows.where(F.size("v") == length), "rows")
    start = [r["v"] for r in rows.orderBy(*order).select("v").limit(entries).collect()]  # as many rows as entries
    table = np.array(start, np.int64).reshape(len(start), parts, length // parts).transpose(1, 0, 2)
    books = Codebooks(table, np.ones(table.shape[:2], bool))
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    schema = f"vec_id {ids}, label {labels}, v array<int>, code binary, distance array<bigint>"
    for k in range(rounds + 1):
        assigned = scratch.keep(rows.mapInArrow(_rounds(books, k == 0), schema), "assigned")
        scratch.drop(rows)
        rows = assigned
        if k < rounds and start:
            books = books.updated(*_sums(rows, books))
    return rows.drop("v"), books


def digests(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error, codebooks_sha256."""
    if books.entries.shape[1] > 256:
        raise ValueError("two hex digits hold 256 entries")
    hexed = F.lower(F.regexp_replace(F.hex("code"), "..(..)", "$1"))
    error = F.aggregate("distance", F.lit(0).cast("bigint"), lambda a, d: a + d)
    out = rows.select("vec_id", F.col("label").alias("key"), hexed.alias("code"), error.alias("error"))
    sums = out.groupBy(F.col("key").alias("other")).agg(F.sum("error").alias("label_error"))
    joined = out.join(sums, F.col("key").eqNullSafe(F.col("other")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
