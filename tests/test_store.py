"""A store read in key ranges: equal to one read, pruned by the high-water mark, in pages of any size."""

import json
import random
import sqlite3

import pytest

from sessionlens.sources import sessions
from sessionlens.sources.store import StoreReader, read_store


def store(path, rows):
    s = sqlite3.connect(path)
    s.execute("CREATE TABLE part (id TEXT, message_id TEXT, session_id TEXT, time_created INT, time_updated INT, data TEXT)")
    s.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_updated INT, data TEXT)")
    s.executemany("INSERT INTO part VALUES (?, ?, ?, ?, ?, ?)", rows)
    s.executemany("INSERT INTO message VALUES (?, ?, ?, ?)", [("m1", "s1", 5, json.dumps({"role": "user"}))])
    s.commit()
    s.close()
    return str(path)


def rows_of(n, span, seed=1):
    r = random.Random(seed)
    return [(f"p{i}", "m1", "s1", 0, r.randrange(span), json.dumps({"type": "text", "text": f"t{i}"})) for i in range(n)]


@pytest.mark.parametrize("ranges,page,span", [(1, 1000, 500), (4, 7, 500), (8, 1, 3), (16, 3, 1), (5, 50, 10_000)])
def test_ranges_hold_each_row_once(tmp_path, ranges, page, span):
    rows = rows_of(60, span)
    path = store(tmp_path / "a.db", rows)
    reader = StoreReader({"path": path, "ranges": str(ranges), "pageRows": str(page)})
    parts = reader.partitions()
    got = [x for p in parts for x in reader.read(p)]
    assert sorted(x[1] for x in got) == sorted(r[0] for r in rows) and len(parts) <= ranges
    assert [(x[5], x[0]) for x in got] == sorted((x[5], x[0]) for x in got)


def test_spark_prunes_ranges_and_normalises(spark, tmp_path):
    rows = rows_of(400, 100_000)
    path = store(tmp_path / "b c.db", rows)
    whole = read_store(spark, path)
    assert sorted(r["id"] for r in whole.collect()) == sorted(r[0] for r in rows)
    late = read_store(spark, path, since=90_000)
    assert sorted(r["id"] for r in late.collect()) == sorted(r[0] for r in rows if r[4] >= 90_000)
    scan = late._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in scan.replace("PushedFilters", "") or "90000" not in scan.split("BatchScan")[0]
    assert read_store(spark, path, since=10**9).count() == 0 and read_store(spark, path).where("time_updated < 10 or id = 'p1'").count() >= 1
    new, top = sessions.read_incremental(whole, 50_000, overlap_ms=0, most=None)
    assert new.count() == sum(r[4] >= 50_000 for r in rows) and top == max(r[4] for r in rows)
    said = sessions.normalize_opencode(whole, read_store(spark, path, "message"))
    assert said.where("role = 'user' and session_id = 's1'").count() == 400


def test_an_empty_store_and_a_wrong_table(spark, tmp_path):
    path = store(tmp_path / "e.db", [])
    assert read_store(spark, path).count() == 0
    with pytest.raises(ValueError):
        StoreReader({"path": path, "table": "users"})
