"""The committed table: replays, aborted writes, two writers, streams, compaction."""

import threading

import pytest

from sessionlens.sinks.event_log import EventLog, write_events_table


def events(spark, *ids):
    return spark.createDataFrame([(i, 1) for i in ids], "event_id string, n int")


def held(log):
    got = log.read()
    return sorted(str(r["event_id"]) for r in got.collect()) if got is not None else []


def test_replays_and_repeats_add_nothing(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "t"))
    assert log.read() is None and held(log) == []
    assert log.append(events(spark, "a", "b", "a", None, None), "1") == 4
    assert log.append(events(spark, "z"), "1") == 0
    assert write_events_table(events(spark, "b", "c"), str(tmp_path / "t")) == 1
    assert log.append(events(spark, "a"), "2") == 0
    assert held(log) == ["None", "None", "a", "b", "c"]
    log.compact()
    assert held(log) == ["None", "None", "a", "b", "c"] and len(log.entries()) == 1
    assert log.append(events(spark, "q"), "1") == 0 and log.append(events(spark, "d"), "3") == 1
    assert log.sweep() == 3 and held(log) == ["None", "None", "a", "b", "c", "d"]


def test_an_aborted_write_is_not_seen(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "t"))
    log.append(events(spark, "a"), "1")

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        log.append(events(spark, "b"), "2", before_commit=fail)
    assert held(log) == ["a"]
    assert log.append(events(spark, "b"), "2") == 1
    assert held(log) == ["a", "b"] and log.sweep() == 1


def test_two_writers_plan_against_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    EventLog(spark, path).append(events(spark, "a"))
    meet, added = threading.Barrier(2, timeout=60), []

    def together():
        if not meet.broken:
            try:
                meet.wait()
            except threading.BrokenBarrierError:
                pass
            meet.abort()  # only the first plans meet; the loser's second is its own

    def write(batch, *ids):
        added.append(EventLog(spark, path).append(events(spark, *ids), batch, before_commit=together))

    threads = [threading.Thread(target=write, args=("x", "b", "c")), threading.Thread(target=write, args=("y", "c", "d"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = EventLog(spark, path)
    assert held(log) == ["a", "b", "c", "d"] and sorted(added) == [1, 2]
    assert [e["version"] for e in log.entries()] == [0, 1, 2]


def test_a_stream_restarts_without_repeats(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "t"))
    for n, ids in enumerate((("a", "b"), ("b", "c"))):
        events(spark, *ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("event_id string, n int").parquet(str(tmp_path / "in"))
        log.start(stream, str(tmp_path / "ck"), trigger={"availableNow": True}).awaitTermination(120)
    log.start(spark.readStream.schema("event_id string, n int").parquet(str(tmp_path / "in")), str(tmp_path / "ck2"), trigger={"availableNow": True}).awaitTermination(120)
    assert held(log) == ["a", "b", "c"]
