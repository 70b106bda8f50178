"""State carried over sorted parts against plain searches, whatever the cuts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.operators import carried, sequences


def plain_anchors(times, window):
    out, anchor = {}, None
    for t in sorted(times):
        if anchor is None or t - anchor > window:
            anchor = t
            out[t] = 0
        else:
            out[anchor] += 1
    return out


def plain_end(rows, steps, window):
    """The first anchor whose search ends within the window: (start, end)."""
    for i, (start, _) in enumerate(rows):
        k = 0
        for at, mask in rows[i:]:
            if at - start > window:
                break
            if mask >> k & 1:
                k += 1
                if k == steps:
                    return start, at
    return None


@pytest.mark.parametrize("seed", range(30))
def test_progress_composes_over_any_cuts(seed):
    r = random.Random(seed)
    steps, window = r.randint(1, 4), r.randint(1, 30)
    rows = sorted((r.randrange(100), r.randrange(1 << steps) if r.random() < 0.7 else 0) for _ in range(r.randint(1, 60)))
    want = plain_end(rows, steps, window)
    cuts = sorted(r.sample(range(len(rows) + 1), min(len(rows), r.randint(0, 8))))
    levels, end = [None] * steps, None
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        p = carried.Progress(steps, window)
        for at, mask in rows[a:b]:
            p.take(at, mask)
        levels, got = p.after(levels)
        end = got if end is None else end
    assert end == (want and want[1])
    if want:  # the search began at the first row within the window before its end
        assert want[0] == min(at for at, _ in rows if at >= end - window)


def test_last_anchors_double():
    at = np.unique(np.random.default_rng(1).integers(0, 100_000, 5000))
    nxt, last = carried.last_anchors(at, 700)
    p = 0
    while nxt[p] != p:
        p = nxt[p]
    assert last[0] == p and at[p] == max(plain_anchors(at.tolist(), 700))


@pytest.mark.parametrize("window,span", [(50, 3000), (5000, 3000), (7, 3000), (400, 100_000)])
def test_repeats_of_one_key_over_many_parts(spark, window, span):
    r = random.Random(window)
    rows = [("hot", r.randrange(span)) for _ in range(3000)] + [(f"k{r.randrange(40)}", r.randrange(span)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, epoch long")
    got = sequences.suppress_repeats(df, ["k"], window=window)
    want = {(k, t): n for k in {k for k, _ in rows} for t, n in plain_anchors([t for x, t in rows if x == k], window).items()}
    assert {(x["k"], x["epoch"]): x["repeats"] for x in got.collect()} == want


def test_windows_hold_to_the_microsecond(spark):
    rows = [("k", 0.5), ("k", 10.5), ("k", 10.500001), ("k", 20.4)]
    df = spark.createDataFrame(rows, "k string, epoch double")
    assert sorted((x["epoch"], x["repeats"]) for x in sequences.suppress_repeats(df, ["k"], window=10).collect()) == [(0.5, 1), (10.500001, 1)]
    at = df.withColumn("epoch", F.timestamp_micros((F.col("epoch") * 1_000_000).cast("long")))
    assert sorted(x["repeats"] for x in sequences.suppress_repeats(at, ["k"], window=10).collect()) == [1, 1]


def test_sequences_of_one_entity_over_many_parts(spark):
    r = random.Random(5)
    names = "abcx"
    rows = [("hot" if r.random() < 0.7 else f"e{r.randrange(9)}", r.randrange(200_000), n, r.choice(names)) for n, _ in enumerate(range(6000))]
    df = spark.createDataFrame([(e, t, n, c, c, c) for e, t, n, c in rows], "entity string, epoch long, ord long, category string, rule_id string, child string")
    seqs = [{"id": f"s{w}{''.join(s)}", "score": 40, "window_seconds": w, "steps": [{"any_category": [c]} for c in s]} for w, s in ((20, "abc"), (3, "cab"), (1, "aab"), (60, "cccc"), (0, "ab"))]
    want = set()
    for e in {x[0] for x in rows}:
        own = sorted((t, n, c) for x, t, n, c in rows if x == e)
        total = 0
        for s in sorted(seqs, key=lambda s: s["id"]):
            names_of = [x["any_category"][0] for x in s["steps"]]
            got = plain_end([(t, sum(1 << k for k, x in enumerate(names_of) if x == c)) for t, _, c in own], len(names_of), s["window_seconds"])
            if got:
                points = 40 if total + 40 <= 150 else 0
                total += points
                want.add((e, s["id"], *got, points))
    assert set(map(tuple, sequences.correlate_sequences(df, seqs).collect())) == want


def test_chain_within_one_second_follows_the_sequence(spark):
    rows = [("s", "1", "b", 5.7, 2, "o1"), ("s", "1", "a", 5.1, 1, "o9"), ("s", "2", "a", 5.5, 7, "o2"), ("s", "2", "b", 5.5, 8, "o1"), ("s", "3", "b", 5.5, 7, "o2"), ("s", "3", "a", 5.5, 8, "o1")]
    df = spark.createDataFrame(rows, "source_instance string, session_id string, step string, epoch double, source_sequence long, observation_id string")
    got = sequences.action_chains(df, "c", ["a", "b"]).collect()
    assert sorted((x["session_id"], x["start_epoch"], x["end_epoch"]) for x in got) == [("1", 5.1, 5.7), ("2", 5.5, 5.5)]
