"""The journal source: starts, bounds, rotation, restart; always equal to a batch read."""

import json

import pytest

from sessionlens.sources.journal import FORMAT, Journal, JournalSource
from sessionlens.streaming import streams


def lines(a, b):
    return "".join(json.dumps({"event_id": f"e{i}", "timestamp": "2024-05-01T00:00:00Z", "severity": "x" * (i % 7)}) + "\n" for i in range(a, b))


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("json").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}.ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def read(spark, tmp_path, name):
    return sorted(r[0] for r in spark.read.schema("value string").json(str(tmp_path / name)).collect())


def source(spark, path, **options):
    spark.dataSource.register(JournalSource)
    return spark.readStream.format(FORMAT).options(**options).load(str(path)).select("value")


@pytest.mark.parametrize("piece", [7, 100, 1 << 20])
def test_pieces_hold_every_line_once(tmp_path, piece):
    (tmp_path / "events.jsonl").write_text("\n" + lines(0, 30) + "\r\nhalf")
    j = Journal({"path": str(tmp_path / "events.jsonl"), "pieceBytes": piece})
    end = {g: e for g, _, e in j.generations()}
    got = [x for p in j.pieces({}, end) for x in j.read(p)]
    assert [x[2] for x in got] == lines(0, 30).splitlines()
    assert len({x[1] for x in got}) == 30


def test_recent_counts_over_generations(tmp_path):
    (tmp_path / "events.jsonl").write_text(lines(10, 13))
    (tmp_path / "events-2024-05-01.2.jsonl").write_text(lines(5, 10))
    (tmp_path / "events-2024-05-01.10.jsonl").write_text(lines(20, 21))
    (tmp_path / "other.jsonl").write_text(lines(0, 1))
    j = Journal({"path": str(tmp_path / "events.jsonl")})
    assert [p.rpartition("/")[2] for _, p, _ in j.generations()] == ["events-2024-05-01.2.jsonl", "events-2024-05-01.10.jsonl", "events.jsonl"]
    end = {g: e for g, _, e in j.generations()}
    for n in range(12):
        got = [x[2] for p in j.pieces(j.recent(n), end) for x in j.read(p)]
        assert got == (lines(5, 10) + lines(20, 21) + lines(10, 13)).splitlines()[max(0, 9 - n):]
    assert Journal({"path": str(tmp_path / "none" / "events.jsonl")}).generations() == []


def test_stream_over_rotation_and_restart(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    active = folder / "events.jsonl"
    active.write_text(lines(0, 40) + '{"event_id"')
    options = {"bytesPerBatch": "500", "state": str(tmp_path / "state"), "pieceBytes": "200"}
    run(spark, source(spark, active, **options), "out", tmp_path)
    with active.open("a") as f:
        f.write(': "e40"}\n')
    active.rename(folder / "events-2024-05-01.1.jsonl")
    active.write_text(lines(41, 60))
    for _ in range(30):  # a run takes one bounded batch at least; the query is new each time, its checkpoint and state are not
        run(spark, source(spark, active, **options), "out", tmp_path)
        if len(read(spark, tmp_path, "out")) == 60:
            break
    got = read(spark, tmp_path, "out")
    batch = sorted(r[0] for r in spark.read.format(FORMAT).load(str(active)).select("value").collect())
    assert got == batch and len(batch) == 60


def test_starts(spark, tmp_path):
    path = tmp_path / "events.jsonl"
    path.write_text(lines(0, 10))
    run(spark, source(spark, path, start="end"), "end", tmp_path)
    run(spark, source(spark, path, start="recent", recentEvents="3"), "recent", tmp_path)
    assert read(spark, tmp_path, "recent") == sorted(lines(7, 10).splitlines())
    with path.open("a") as f:
        f.write(lines(10, 12) + lines(11, 12) + "not an event\n")
    run(spark, source(spark, path, start="end"), "end", tmp_path)
    assert read(spark, tmp_path, "end") == sorted([*lines(10, 12).splitlines(), *lines(11, 12).splitlines(), "not an event"])
    q = streams.follow_events(spark, str(path), start="recent", recent=4).select("event_id").writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "f.ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r[0] for r in spark.table("followed").collect()) == ["e10", "e11"]
