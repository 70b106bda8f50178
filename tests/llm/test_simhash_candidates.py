"""Near copies of the pipeline come from SimHash fingerprints that BK-trees of shards link."""

import random

import numpy as np

import corpus_pipeline
from sessionlens.llm import resemblance, simhash


def test_fingerprints_are_what_decides_who_meets(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text, "s"), (2, text + " end", "s"), (3, "another text of a few words only", "s")], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies_out(spark, docs, "").collect()} == {1, 3}
    # with trees that link nothing no pair is met: there is no other path
    monkeypatch.setattr(resemblance, "FIRST", -1)
    assert {r["doc_id"] for r in corpus_pipeline.near_copies_out(spark, docs, "").collect()} == {1, 2, 3}


def test_trees_link_as_all_pairs_of_a_shard_do(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(512) for _ in range(6)]
    values = [base[i % 6] ^ sum(1 << b for b in rng.sample(range(512), rng.randrange(0, 120))) for i in range(1500)] + [rng.getrandbits(512) for _ in range(500)]
    words = np.array([[v >> 64 * k & 2**64 - 1 for k in range(8)] for v in values], np.uint64)
    drawn = np.array([[1, 70, 300, 511], [5, 6, 7, 8]])
    keys = resemblance.shard_keys(words, drawn)
    near = lambda i, j: (int(np.bitwise_count(words[i, 0] ^ words[j, 0])) <= resemblance.FIRST and int(np.bitwise_count(words[i, 1:resemblance.IN_TREE] ^ words[j, 1:resemblance.IN_TREE]).sum()) <= resemblance.NEXT)
    want = set()
    for t in range(2):
        for shard in np.unique(keys[:, t]):
            at = np.flatnonzero(keys[:, t] == shard)
            low = {int(i): int(i) for i in at}
            for i in at:
                for j in at:
                    if i < j and near(i, j) and low[i] != low[j]:
                        a, b = sorted((low[i], low[j]))
                        low = {x: a if r == b else r for x, r in low.items()}
            size = {r: list(low.values()).count(r) for r in low.values()}
            want |= {(t, r, x) for x, r in low.items() if size[r] > 1}
    df = spark.createDataFrame([(i, bytearray(w.astype("<u8").tobytes())) for i, w in enumerate(words)], "node long, sketch binary").repartition(3)
    assert {tuple(r) for r in resemblance.shard_classes(df, drawn).select("band", "key", "node").collect()} == want


def test_pairs_at_the_limit_are_missed_no_more_often_in_a_larger_corpus():
    for size in (10, 40_000, 200_000, 15_000_000):
        drawn = resemblance.shard_bits(size)
        assert resemblance.missed(drawn.shape[1], len(drawn)) <= 1e-4
        assert size / 2 ** drawn.shape[1] <= 2048


def test_texts_without_a_common_shingle_hardly_ever_meet(spark):
    rng = np.random.default_rng(8)
    words = rng.integers(0, 2**64, (6000, 8), np.uint64)
    df = spark.createDataFrame([(i, bytearray(w.astype("<u8").tobytes())) for i, w in enumerate(words)], "node long, sketch binary").repartition(3)
    assert resemblance.shard_classes(df, resemblance.shard_bits(6000)).count() <= 4


def test_bits_are_the_majority_of_any_number_of_hashes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 255, 256, 20_000):
        hashes = rng.integers(0, 2**64, n, np.uint64)
        got = int(simhash.majority_bits(hashes, 3)[0])
        assert got == sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > n)
