"""Mixing of rows with null and repeated ids."""

from collections import Counter

from sessionlens.llm import mixing


def test_mixed_repeats_each_row_as_mix_counts(spark):
    rows = [(None if i % 3 == 0 else i // 2, " ".join([f"w{i}"] * (1 + i % 7)), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mixed(df).collect())
    counts = mixing.mix(df).collect()
    assert sum(got.values()) == sum(r["copies"] for r in counts)
    sizes, want = Counter(), Counter()
    for (i, t), n in got.items():
        sizes[i, len(t.split())] += n
    for r in counts:
        want[r["doc_id"], r["size"]] += r["copies"]
    assert sizes == +want and sum(n for (i, _), n in got.items() if i is None) > 0
