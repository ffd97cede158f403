"""Household settings: a history of saves, of which the last one counts."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.constants import DEFAULT_SETTINGS

BUCKET = "_bucket"


def latest_settings(
    history: DataFrame, key: str = "household", ts: str = "ts", tie: list[str] | None = None
) -> DataFrame:
    """Last save per household, by an aggregate that combines before the shuffle.

    Rows with text columns are aggregated by sorting within a task; there is no window. Saves of one instant
    are ordered by ``tie``.
    """
    order = F.struct(ts, *(tie or []))
    values = [c for c in history.columns if c not in (key, *(tie or []))]
    return (
        history.groupBy(key)
        .agg(F.max_by(F.struct(*values), order).alias("_last"))
        .select(key, *[F.col("_last")[c].alias(c) for c in values])
    )


def settings_or_default(households: DataFrame, latest: DataFrame, key: str = "household") -> DataFrame:
    """Every household (all its columns) with its saved settings or the defaults."""
    joined = households.join(latest, key, "left")
    return joined.withColumns(
        {name: F.coalesce(name, F.lit(value)) for name, value in DEFAULT_SETTINGS.items()}
    )


# --- store ---------------------------------------------------------------------------------------
#
# path/data/<id>     immutable tables: a base, or the saves of one batch (a delta), in hashed buckets of households
# path/versions/<n>  manifest of version n: the tables it consists of; the greatest number is the present version
#
# A version exists from the moment its manifest gets its name, which happens in one step and only if no other writer
# took the number. What a writer leaves behind when it ends before that is in no manifest, so no reader sees it.

BUCKETS = 16
COMPACT_AFTER = 8  # deltas


class VersionTaken(Exception):
    """Another writer published this version first."""


def upsert_settings(
    saves: DataFrame, path: str, key: str = "household", ts: str = "ts", tie: list[str] | None = None,
    buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER, attempts: int = 20,
) -> int:
    """Merge a batch of saves into the store at ``path`` and return the new version: the newest save of each household
    stays, and of saves of the same instant the one merged last.

    The batch becomes a delta; every ``compact_after`` deltas are merged into a new base. A writer that loses its
    version to another one builds on that and tries again. Readers see the old or the new version, never part of one.
    """
    spark = saves.sparkSession
    delta = _write_table(latest_settings(saves, key, ts, tie), path, key, buckets)
    for _ in range(attempts):
        version, tables = _manifest(spark, path)
        tables = [*tables, {"table": delta, "version": version + 1}]
        if len(tables) > compact_after + 1:
            merged = _write_table(_merged(spark, path, tables, key, ts), path, key, buckets)
            tables = [{"table": merged, "version": version + 1}]
        try:
            _publish(spark, path, version + 1, {"key": key, "ts": ts, "tables": tables})
            return version + 1
        except VersionTaken:
            continue
    raise VersionTaken(f"{attempts} attempts to write a version of {path} failed")


def read_settings(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest save of every household, as of a version (default: the present one)."""
    version, tables = _manifest(spark, path, version)
    if not tables:
        raise FileNotFoundError(f"no settings at {path}")
    about = _read_json(spark, f"{path}/versions/{version:010d}")
    return _merged(spark, path, tables, about["key"], about["ts"])


def settings_versions(spark: SparkSession, path: str) -> list[int]:
    names = [f.getPath().getName() for f in _listed(spark, f"{path}/versions")]
    return sorted(int(name) for name in names if name.isdigit())


def forget_versions(spark: SparkSession, path: str, keep: int = 2, older_than_hours: float = 24.0) -> None:
    """Drop all but the newest ``keep`` versions, then tables that none of them has.

    Tables younger than ``older_than_hours`` stay, as a writer may be about to publish them. Ending in between does no
    harm: manifests go first, oldest first.
    """
    versions = settings_versions(spark, path)
    for version in versions[: max(0, len(versions) - keep)]:
        _delete(spark, f"{path}/versions/{version:010d}")
    used = {t["table"] for v in settings_versions(spark, path) for t in _manifest(spark, path, v)[1]}
    before = (time.time() - older_than_hours * 3600) * 1000
    for found in _listed(spark, f"{path}/data"):
        if found.getPath().getName() not in used and found.getModificationTime() <= before:
            _delete(spark, found.getPath().toString())


def _merged(spark: SparkSession, path: str, tables: list[dict], key: str, ts: str) -> DataFrame:
    rows = None
    for entry in tables:
        part = spark.read.parquet(f"{path}/data/{entry['table']}").drop(BUCKET).withColumn("_version", F.lit(entry["version"]))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return latest_settings(rows, key, ts, ["_version"])


def _write_table(rows: DataFrame, path: str, key: str, buckets: int) -> str:
    name = uuid.uuid4().hex
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    rows.withColumn(BUCKET, bucket).repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/data/{name}")
    return name


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[dict]]:
    if version is None:
        version = max(settings_versions(spark, path), default=0)
    return (version, _read_json(spark, f"{path}/versions/{version:010d}")["tables"]) if version else (0, [])


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """The manifest is written beside its place and then gets its name, unless the name exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs
    beside, place = files.Path(f"{path}/versions/.{uuid.uuid4().hex}"), files.Path(f"{path}/versions/{version:010d}")
    out = beside.getFileSystem(conf).create(beside, False)
    try:
        out.write(bytearray(json.dumps(manifest), "utf-8"))
    finally:
        out.close()
    option = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.valueOf("NONE")
    try:
        files.FileContext.getFileContext(place.toUri(), conf).rename(beside, place, options)
    except Py4JJavaError as failed:
        if "FileAlreadyExists" in str(failed.java_exception):
            _delete(spark, beside.toString())
            raise VersionTaken(f"version {version} of {path}") from failed
        raise


def _read_json(spark: SparkSession, path: str) -> dict:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _listed(spark: SparkSession, path: str) -> list:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(store.listStatus(place)) if store.exists(place) else []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
