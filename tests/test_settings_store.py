"""The settings store: versions, writers that end between any two steps, two writers at once."""

import pytest
from pyspark.sql import functions as F

from wattledger.sources import settings
from wattledger.sources.settings import VersionTaken, forget_versions, read_settings, settings_versions, upsert_settings

SCHEMA = "household long, ts timestamp, currency string"


def saves(spark, *rows):
    return spark.createDataFrame([(h, f"2024-01-0{d} 00:00:00", c) for h, d, c in rows], SCHEMA.replace("timestamp", "string")).withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def held(spark, path, version=None):
    return {r.household: r.currency for r in read_settings(spark, path, version).collect()}


def test_versions_stay_readable(spark, tmp_path):
    path = str(tmp_path / "s")
    assert upsert_settings(saves(spark, (1, 2, "PHP"), (2, 2, "PHP"), (None, 1, "X")), path) == 1
    assert upsert_settings(saves(spark, (1, 1, "OLD"), (2, 2, "EUR"), (3, 3, "EUR")), path) == 2
    assert held(spark, path) == {1: "PHP", 2: "EUR", 3: "EUR", None: "X"}
    assert held(spark, path, 1) == {1: "PHP", 2: "PHP", None: "X"}


def test_many_deltas_become_a_base(spark, tmp_path):
    path = str(tmp_path / "s")
    for day in range(1, 8):
        upsert_settings(saves(spark, (day % 3, day, f"c{day}")), path, buckets=2, compact_after=2)
    assert held(spark, path) == {0: "c6", 1: "c7", 2: "c5"}
    assert max(len(settings._manifest(spark, path, v)[1]) for v in settings_versions(spark, path)) <= 3
    forget_versions(spark, path, keep=2, older_than_hours=0)
    assert settings_versions(spark, path) == [6, 7] and held(spark, path) == {0: "c6", 1: "c7", 2: "c5"}
    used = {t["table"] for v in (6, 7) for t in settings._manifest(spark, path, v)[1]}
    assert {f.getPath().getName() for f in settings._listed(spark, f"{path}/data")} == used


@pytest.mark.parametrize("compact_after", [1, 8])
def test_a_writer_that_ends_between_two_steps(spark, tmp_path, monkeypatch, compact_after):
    """Every call that touches the store is a step; the writer ends before and after each of them."""
    names = ["_write_table", "_publish", "_manifest", "_merged"]
    for point in range(1, 12):
        for when in ("before", "after"):
            path, calls = str(tmp_path / f"s{compact_after}{point}{when}"), [0]
            upsert_settings(saves(spark, (1, 1, "a"), (2, 1, "a")), path, buckets=1)
            upsert_settings(saves(spark, (3, 1, "a")), path, buckets=1)
            old = held(spark, path)

            def stopping(call):
                def run(*args, **kwargs):
                    calls[0] += 1
                    here = calls[0] == point
                    if here and when == "before":
                        raise KeyboardInterrupt
                    out = call(*args, **kwargs)
                    if here:
                        raise KeyboardInterrupt
                    return out

                return run

            with monkeypatch.context() as patch:
                for name in names:
                    patch.setattr(settings, name, stopping(getattr(settings, name)))
                try:
                    upsert_settings(saves(spark, (1, 2, "b"), (4, 2, "b")), path, buckets=1, compact_after=compact_after)
                    ended = False
                except KeyboardInterrupt:
                    ended = True
            new = {**old, 1: "b", 4: "b"}
            assert held(spark, path) in ((old, new) if ended else (new,))
            upsert_settings(saves(spark, (1, 2, "b"), (4, 2, "b")), path, buckets=1)  # a later writer is not disturbed
            assert held(spark, path) == new
            if not ended:
                return
    raise AssertionError("the writer has more steps than were tried")


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    upsert_settings(saves(spark, (1, 1, "a")), path)
    publish, first = settings._publish, []

    def overtaken(*args):
        if not first:
            first.append(True)
            upsert_settings(saves(spark, (2, 1, "other")), path)
        return publish(*args)

    monkeypatch.setattr(settings, "_publish", overtaken)
    assert upsert_settings(saves(spark, (3, 1, "mine")), path) == 3
    assert held(spark, path) == {1: "a", 2: "other", 3: "mine"}
    with pytest.raises(VersionTaken):
        publish(spark, path, 2, {"key": "household", "ts": "ts", "tables": []})
    assert held(spark, path) == {1: "a", 2: "other", 3: "mine"}


def test_no_store_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_settings(spark, str(tmp_path / "none"))
