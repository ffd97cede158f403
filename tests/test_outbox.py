"""The outbox holds each alert once: replayed batches, failed tasks, a stream started anew."""

import os

import pytest
from pyspark.sql import functions as F

from wattledger.schemas import EVENTS
from wattledger.sources.outbox import outbox_batches, read_outbox, store_of, stream_to_outbox, write_outbox
from wattledger.plans.tables import events

SCHEMA = "household bigint, ts timestamp, subject string"


@pytest.fixture(scope="module")
def parts(spark, small, tmp_path_factory):
    """One file for each of five events in a row of time."""
    folder = str(tmp_path_factory.mktemp("outbox-input"))
    rows = events(spark, small).dropDuplicates(["user_id", "ts"])
    for k in range(4):
        rows.where(F.col("event_id") % 4 == k).coalesce(2).write.mode("append").parquet(folder)
    return folder, rows.count()


def alerts(spark, folder, files=2):
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.select(F.col("user_id").alias("household"), F.col("ts").cast("timestamp").alias("ts"), F.lit("s").alias("subject"))


def run(rows, path, checkpoint, name="default"):
    query = stream_to_outbox(rows, path, checkpoint, name).trigger(availableNow=True).start()
    query.awaitTermination()


def counts(spark, path, keys=("household", "ts")):
    rows = read_outbox(spark, path, SCHEMA, keys)
    return rows.count(), rows.select("household", "ts").distinct().count()


def test_a_replayed_batch_adds_nothing(spark, parts, tmp_path):
    folder, n = parts
    path, checkpoint = f"file:{tmp_path}/outbox", str(tmp_path / "state")
    run(alerts(spark, folder), path, checkpoint)
    assert counts(spark, path, ()) == (n, n)
    commits = sorted((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):  # the stream ended before Spark noted the last batch
        os.remove(f"{checkpoint}/commits/{name}")
    before = outbox_batches(spark, path)
    run(alerts(spark, folder), path, checkpoint)
    assert outbox_batches(spark, path) == before and counts(spark, path, ()) == (n, n)
    store, root = store_of(path)
    assert len(os.listdir(f"{root}/files")) == sum(len(b["files"]) for b in before)  # the replay's files are gone


def test_a_failed_batch_leaves_nothing(spark, parts, tmp_path):
    folder, n = parts
    path, checkpoint, marker = str(tmp_path / "outbox"), str(tmp_path / "state"), str(tmp_path / "marker")

    def failing(batches):
        for batch in batches:
            if os.path.exists(marker):
                raise OSError("lost")
            yield batch

    rows = alerts(spark, folder)
    rows = rows.mapInArrow(failing, rows.schema)
    open(marker, "w").close()
    with pytest.raises(Exception, match="lost"):
        run(rows, path, checkpoint)
    assert outbox_batches(spark, path) == [] and counts(spark, path) == (0, 0)
    os.remove(marker)
    run(rows, path, checkpoint)
    assert counts(spark, path, ()) == (n, n)


def test_a_stream_started_anew_repeats_no_key(spark, parts, tmp_path):
    folder, n = parts
    path = str(tmp_path / "outbox")
    run(alerts(spark, folder, 2), path, str(tmp_path / "one"), "first")
    run(alerts(spark, folder, 3), path, str(tmp_path / "two"), "second")
    assert counts(spark, path, ())[0] == 2 * n and counts(spark, path) == (n, n)


def test_named_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "outbox")
    rows = spark.sql("SELECT id AS household, timestamp'2024-01-01' AS ts, 'a' AS subject FROM range(5)")
    for _ in range(2):
        write_outbox(rows, path, batch="monday")
    write_outbox(rows.withColumn("subject", F.lit("b")).where("household > 2"), path)
    got = read_outbox(spark, path, SCHEMA)
    assert got.count() == 5 and {r.subject for r in got.collect()} == {"a"}
    assert read_outbox(spark, path, SCHEMA, ()).count() == 7
    write_outbox(rows.limit(0), path, batch="empty")
    assert outbox_batches(spark, path)[-1]["rows"] == 0


def test_equal_keys_of_one_batch_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "outbox")
    rows = spark.createDataFrame([(None, None, "b"), (None, None, "a"), (1, None, "c"), (1, None, "c")], "household long, ts string, subject string")
    write_outbox(rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1), path)
    got = sorted(((r.household, r.subject) for r in read_outbox(spark, path, SCHEMA).collect()), key=str)
    assert got == [(1, "c"), (None, "a")]
