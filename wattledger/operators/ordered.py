"""Previous-row and running-sum operators that stay balanced when one key is huge.

``lag`` over ``partitionBy(device)`` puts all rows of a device in one task. Here only keys above a row
limit are cut along time into pieces. Rows are then ordered inside (key, piece), and what one piece
hands to the next travels in a small table with one row per piece. The result equals the plain window,
and the rows are shuffled once: the handover is joined on the partitioning they already have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = "_piece"
WHOLE_KEY = -(1 << 62)  # piece number of a key that is not cut
PIECE_ROWS = 2_000_000


@dataclass(frozen=True)
class Pieces:
    """Rows and the columns ``by`` that part them: the keys or, if any key was cut, key stand-ins and
    the piece number."""

    rows: DataFrame
    keys: list[str]
    by: list[str]
    cut: bool

    def with_rows(self, rows: DataFrame) -> Pieces:
        return Pieces(rows, self.keys, self.by, self.cut)

    def result(self) -> DataFrame:
        return self.rows.drop(*self.by) if self.cut else self.rows


def cut_large_keys(
    df: DataFrame,
    keys: list[str],
    ts: str,
    piece_rows: int = PIECE_ROWS,
    bucket_seconds: int = 3600,
) -> Pieces:
    """Number the time pieces of keys with more than ``piece_rows`` rows.

    A large key is cut at every ``bucket_seconds``; a bucket that is itself too large is cut again into
    equal parts. The limit is the same for any size of the table; how the two lookup tables are joined is
    left to Spark's size check. Sizes come from one aggregate that returns a single row. If no key is
    large, the rows are left as they are.
    """
    limit = piece_rows
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if (largest or 0) <= limit:
        return Pieces(df, keys, keys, False)

    # Stand-ins make a null key an ordinary one, as it is in grouping and windows.
    stand_ins = {}
    for i, key in enumerate(keys):
        stand_ins[f"_key{i}"] = F.coalesce(key, _any_value(df.schema[key].dataType))
        stand_ins[f"_null{i}"] = F.col(key).isNull()
    named = list(stand_ins)
    width = bucket_seconds * 1_000_000
    us = F.unix_micros(ts)
    rows = df.withColumns({**stand_ins, "_bucket": F.floor(us / F.lit(width))})
    count = F.count(F.lit(1)).alias("_n")
    large = rows.groupBy(*named).agg(count).filter(F.col("_n") > limit).select(*named, F.lit(True).alias("_large"))
    rows = rows.join(large, named, "left")
    buckets = (
        rows.filter("_large")
        .groupBy(*named, "_bucket")
        .agg(count)
        .filter(F.col("_n") > limit)
        .select(*named, "_bucket", F.ceil(F.col("_n") / F.lit(limit)).alias("_parts"))
    )
    start = F.col("_bucket") * F.lit(width)
    part = F.greatest(F.floor(F.lit(width) / F.coalesce("_parts", F.lit(1))), F.lit(1))
    # Rows without a time sort first, so their piece does too.
    piece = F.coalesce(start + F.floor((us - start) / part) * part, F.lit(WHOLE_KEY + 1))
    rows = (
        rows.join(buckets, [*named, "_bucket"], "left")
        .withColumn(PIECE, F.when(F.col("_large"), piece).otherwise(F.lit(WHOLE_KEY)))
        .select(*df.columns, *named, PIECE)
    )
    return Pieces(rows, keys, [*named, PIECE], True)


def _any_value(kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    return F.lit(0).cast(kind)


def _order(columns: list[str]) -> list[Column]:
    return [F.col(c).asc() for c in columns]


def with_previous(pieces: Pieces, order_by: list[str], columns: dict[str, str]) -> Pieces:
    """Add ``columns`` (new name -> source column) holding the values of the key's previous row."""
    by, source = pieces.by, list(columns.values())
    inside = Window.partitionBy(*by).orderBy(*_order(order_by))
    rows = pieces.rows.withColumn("_prev", F.lag(F.struct(*source)).over(inside))
    if pieces.cut:
        last = F.struct(
            *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)], F.struct(*source).alias("_v")
        )
        handover = (
            pieces.rows.filter(F.col(PIECE) != WHOLE_KEY)
            .groupBy(*by)
            .agg(F.max(last).alias("_last"))
            .select(*by, F.lag("_last").over(Window.partitionBy(*by[:-1]).orderBy(PIECE))["_v"].alias("_handed"))
        )
        rows = rows.join(handover, by, "left").withColumn("_prev", F.coalesce("_prev", "_handed")).drop("_handed")
    for name, column in columns.items():
        rows = rows.withColumn(name, F.col("_prev")[column])
    return pieces.with_rows(rows.drop("_prev"))


def with_running_sum(pieces: Pieces, order_by: list[str], column: str, name: str) -> Pieces:
    """Add the sum of ``column`` over the key's rows up to and including this one."""
    by = pieces.by
    inside = (
        Window.partitionBy(*by).orderBy(*_order(order_by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = pieces.rows.withColumn(name, F.sum(column).over(inside))
    if pieces.cut:
        before = Window.partitionBy(*by[:-1]).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            pieces.rows.filter(F.col(PIECE) != WHOLE_KEY)
            .groupBy(*by)
            .agg(F.sum(column).alias("_s"))
            .select(*by, F.sum("_s").over(before).alias("_offset"))
        )
        rows = (
            rows.join(offsets, by, "left")
            .withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0)))
            .drop("_offset")
        )
    return pieces.with_rows(rows)
