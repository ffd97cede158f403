"""Meter logs of both generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.operators.normalise import scale_raw
from wattledger.schemas import METER_LOG_V2


def parse_meter_log_v1(lines: DataFrame, column: str = "value", quarantine: bool = False) -> DataFrame:
    """Readings from text lines with 7 or 8 fields.

    The header names seven fields, yet newer lines carry an unnamed eighth one before the switch. The
    switch is therefore the last field. The columns called volts, amperes and watts hold raw integers.
    Header lines are left out, and lines of another length or without a time too, unless ``quarantine`` is set:
    then every line but headers stays, with its text in ``raw`` and ``is_valid`` to split on.
    """
    fields = F.split(column, ",", -1)
    number = lambda i: F.get("_f", F.lit(i)).try_cast("bigint")
    rows = (
        lines.withColumn("_f", fields)
        .withColumn("n_fields", F.size("_f"))
        .filter(~F.coalesce(F.get("_f", F.lit(0)) == "timestamp", F.lit(False)))
        .withColumn("is_valid", F.col("n_fields").isin(7, 8))
    )
    extra = [F.col(column).alias("raw"), "is_valid"] if quarantine else []
    if quarantine:
        rows = rows.withColumn("is_valid", F.col("is_valid") & F.get("_f", F.lit(0)).try_cast("timestamp").isNotNull())
    else:
        rows = rows.filter("is_valid")
    return (
        rows
        .select(
            F.get("_f", F.lit(0)).try_cast("timestamp").alias("ts"),
            F.get("_f", F.lit(1)).alias("device_id"),
            number(2).alias("voltage_raw"),
            number(3).alias("current_raw"),
            number(4).alias("power_raw"),
            number(5).alias("add_ele_raw"),
            F.when(F.col("n_fields") == 8, F.get("_f", F.lit(6))).alias("interval_unnamed"),
            F.element_at("_f", -1).try_cast("boolean").alias("switch_1"),
            "n_fields",
            *extra,
        )
    )


def read_meter_log_v1(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    return parse_meter_log_v1(spark.read.text(path), quarantine=quarantine)


def read_meter_log_v2(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """With ``quarantine`` a column ``raw`` has the text of lines that do not fit the schema, else null."""
    if not quarantine:
        return spark.read.schema(METER_LOG_V2).csv(path, header=True)
    schema = T.StructType([*METER_LOG_V2.fields, T.StructField("raw", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "raw").csv(path, header=True)


def write_meter_log_v2(df: DataFrame, path: str) -> None:
    columns = [F.col(f.name).cast(f.dataType) for f in METER_LOG_V2]
    df.select(*columns).write.mode("overwrite").csv(
        path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    )


def unify_generations(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Both generations in the newer model; what the older one lacks is null."""
    first = scale_raw(v1).drop("interval_unnamed", "n_fields").withColumn("generation", F.lit(1))
    second = v2.withColumnRenamed("timestamp", "ts").withColumn("generation", F.lit(2))
    return first.unionByName(second, allowMissingColumns=True)


# --- streams -------------------------------------------------------------------------------------


def stream_meter_log_v1(spark: SparkSession, path: str, quarantine: bool = False, max_files_per_trigger: int = 1000) -> DataFrame:
    """New files of the older generation as a stream."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path)
    return parse_meter_log_v1(lines, quarantine=quarantine)


def stream_meter_log_v2(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """New files of the newer generation as a stream."""
    return spark.readStream.schema(METER_LOG_V2).option("maxFilesPerTrigger", max_files_per_trigger).csv(path, header=True)


def counters(rows: DataFrame) -> DataFrame:
    """Readings of either generation as the streaming operators take them: event_id, device_id, ts, kwh_total, power_w.

    Log lines have no number; a hash of the line's values takes its place, so a line that is read again keeps its id.
    """
    if "kwh_total" not in rows.columns:
        rows = scale_raw(rows)
    if "timestamp" in rows.columns:
        rows = rows.withColumnRenamed("timestamp", "ts")
    values = ["device_id", "ts", "voltage_raw", "current_raw", "power_raw", "add_ele_raw"]
    return rows.select(F.xxhash64(*values).alias("event_id"), "device_id", "ts", F.col("kwh_total").cast("double"), F.col("power_w").cast("double"))
