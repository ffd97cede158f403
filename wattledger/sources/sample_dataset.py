"""Sample dataset: configuration, appliance ranges and hourly samples in one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.schemas import SAMPLE_DATASET

# Series names of the document and the appliances they belong to.
SERIES_APPLIANCE = {
    "ac": "Air Conditioner",
    "refrigerator": "Refrigerator",
    "washingMachine": "Washing Machine",
    "electricFan": "Electric Fan",
}


def parse_sample_dataset(docs: DataFrame, column: str = "value") -> DataFrame:
    """Documents as typed columns; unreadable ones become nulls."""
    return docs.withColumn("_d", F.from_json(column, SAMPLE_DATASET)).select(
        *[c for c in docs.columns if c != column], "_d.*"
    )


def read_sample_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_DATASET).json(path, multiLine=True)


def sample_series(dataset: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long table (period, segment, series, slot, kwh); a series absent from the document has no rows."""
    keys = keys or []
    sides = [("lookback", "actual"), ("lookback", "forecast")]
    sides += [("forecast", name) for name in SERIES_APPLIANCE]
    series = F.array(
        *[
            F.struct(
                F.lit(segment).alias("segment"),
                F.lit(name).alias("series"),
                F.col(f"_sample.{segment}.{name}").alias("points"),
            )
            for segment, name in sides
        ]
    )
    return (
        dataset.select(*keys, F.explode("sampleData").alias("period", "_sample"))
        .select(*keys, "period", F.inline(series))
        .select(*keys, "period", "segment", "series", F.posexplode("points").alias("slot", "kwh"))
    )


def appliance_ranges(dataset: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return dataset.select(*(keys or []), F.explode("applianceRanges").alias("appliance", "_r")).select(
        *(keys or []), "appliance", F.col("_r.min").alias("range_min"), F.col("_r.max").alias("range_max")
    )


def configured_appliances(dataset: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return dataset.select(*(keys or []), F.explode("settings.appliances").alias("appliance"))
