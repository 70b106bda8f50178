"""Near copies of the pipeline against brute-force shingle resemblance."""

import random

import corpus_pipeline
from sessionlens.llm import resemblance


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """Smallest id of each row's class under Jaccard >= 0.8, and the number of linked pairs."""
    sets, root, n = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}, 0
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                n += 1
                low, high = sorted((root[i], root[j]))
                root = {x: low if r == high else r for x, r in root.items()}
    return root, n


def edited(rng, words, share):
    return " ".join(rng.choice("ABCDEFGH") + str(rng.random()) if rng.random() < share else w for w in words)


def test_classes_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):  # pairs and small groups about the limit
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 300))]
        rows += [(1000 * k + i, edited(rng, words, share)) for i, share in enumerate((0, 0.01, 0.02, 0.03, 0.05))]
    words = [f"g{rng.randrange(5000)}" for _ in range(80)]
    rows += [(100_000 + i, edited(rng, words, 0.012)) for i in range(150)]  # one large group, not all of whose pairs are near
    rows += [(200_000, None), (200_001, ""), (200_002, " \n"), (200_003, "a b"), (200_004, "A  b"), (200_005, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, pairs = brute_classes(rows)
    assert pairs > 1000
    assert {r["doc_id"]: r["component_id"] for r in resemblance.near_copies(df).collect()} == want
    assert resemblance.near_copies(df.limit(0)).count() == 0


def test_stage_drops_the_pair_at_17_bits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id in (1, 177, 106, 185)")
    left = {r["doc_id"] for r in corpus_pipeline.near_copies_out(spark, docs, sf_dir).collect()}
    want, _ = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert left == set(want.values()) == {1, 106, 185}  # 1 and 177 agree to 0.83, 106 and 185 to 0.797
