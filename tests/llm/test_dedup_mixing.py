"""Exact dedup, mixing and SimHash against plain versions, and their edges."""

import hashlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionlens.llm import exact_dedup, mixing, simhash
from sessionlens.llm.queries import ORACLE_SQL, QUERIES

LONG = "ab cd " * 30_000
ROWS = [(1, "Hello World", "b", 1), (2, "hello world", "a", 2), (3, None, None, 3), (4, "", "a", 4), (5, LONG, "a", 5), (5, LONG, "a", 5), (6, "É", "b", 6), (7, "é", "b", 7), (None, "hello world", "b", 8), (None, None, None, 9)]


@pytest.fixture(scope="module")
def docs(spark):
    # columns with names that the operators use themselves
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, size int").withColumns({"kept": F.lit(1), "fp": F.lit(2), "count": F.lit(3), "keep_id": F.lit(4)})


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("hot", [1, 500])
def test_exact_dedup_edges(docs, hot):
    got = exact_dedup.exact_dedup(docs, hot_rows=hot).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(lower(t), []).append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max(i for i in ids if i is not None)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.deduplicated(docs, hot_rows=hot)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 6, 7]


@pytest.mark.parametrize("name", ["op2_mixing", "op8_exact_dedup"])
def test_queries_against_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = c.sql(ORACLE_SQL[name]).df().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns])


def test_empty_tables(docs):
    none = docs.limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def water_fill(sizes, weights, share, most):
    budget, full = share * sum(sizes), set()
    while True:
        left = budget - sum(most * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        t = [most * s if i in full else left * weights[i] / w for i, s in enumerate(sizes)] if w else [most * s for s in sizes]
        over = {i for i in range(len(sizes)) if i not in full and t[i] > most * sizes[i]}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_mixing_targets_and_shares(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {s: int(rng.integers(1, 4000)) for s in ["a", "b", "c", "d", None]}
    rows, i = [], 0
    for s, n in sizes.items():
        while n > 0:
            k = min(n, int(rng.integers(1, 9)))
            rows.append((i, " ".join(["w"] * k), s))
            i, n = i + 1, n - k
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df, bucket_rows=200).toPandas()
    order = ["a", "b", "c", "d", None]
    want = dict(zip(order, water_fill([sizes[s] for s in order], [3, 1, 2, 3, 1], 1.5, 2), strict=True))
    source = {r[0]: r[2] for r in rows}
    got["source"] = got.doc_id.map(source)
    for s, part in got.groupby("source", dropna=False):
        key = s if isinstance(s, str) else None
        assert abs(part.target.iloc[0] - want[key]) < 1e-6 and (part.source_size == sizes[key]).all()
        assert abs(part.taken.sum() - want[key]) <= 20
    assert (got.taken <= 2 * got["size"]).all() and len(got) == len(rows)
    again = mixing.mix(df.repartition(3), bucket_rows=200).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_mixing_edges(docs):
    got = mixing.mix(docs)
    assert got.count() == len(ROWS) and got.where("size = 0 and taken > 0").count() == 0
    assert set(mixing.mixed(docs).columns) == set(docs.columns)


def slow_fingerprint(text, width):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, radius):
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[top(i)] = top(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return [least.get(top(i)) for i in range(len(ids))]


def test_simhash_against_brute_force(spark, sf_dir, docs):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text")).unionByName(spark.createDataFrame([(10**7, "a b"), (10**7 + 1, " x \t\x0b y z w")], "doc_id long, text string"))
    given = df.collect()
    got = simhash.near_duplicates(df.repartition(3)).toPandas()
    fps = [slow_fingerprint(r["text"], 3) for r in given]
    want = sorted((str(r["doc_id"]), f"{f:016x}", str(c)) for r, f, c in zip(given, fps, classes([r["doc_id"] for r in given], fps, 2), strict=True))
    ids = got.doc_id.map(lambda x: "None" if x != x else str(int(x)))
    assert sorted(zip(ids, got.fingerprint, got.component_id.map(lambda x: str(int(x))), strict=True)) == want


@pytest.mark.parametrize("heavy", [8, 4096])
def test_links_lose_no_near_pair(spark, heavy):
    rng = np.random.default_rng(heavy)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    bit = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    fps = np.unique(np.concatenate([base[rng.integers(0, 12, 900)] ^ bit(900) ^ bit(900), rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    ids = list(range(len(fps)))
    want = classes(ids, [int(x) for x in fps], 2)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(int(x), int(x)) for x in fps.astype(np.int64)], "node long, fp long"), 2, heavy)).collect()}
    mine = [roots.get(int(x), int(x)) for x in fps.astype(np.int64)]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))
    tree = simhash.LeafTree(fps)
    tree.LEAF = 16
    tree.root = tree._build(np.arange(len(fps)))
    assert len(set(zip(tree.classes(2).tolist(), want, strict=True))) == len(set(want))


def test_further_words_rule_out_chance_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 4)
    rows = [(i, int(base[0]) ^ (1 << i % 30), *[int(x) for x in base[1:]]) for i in range(400)]  # true near copies
    rows += [(1000 + i, int(base[0]) ^ (1 << i % 30), *[int(x) for x in rng.integers(-(2**62), 2**62, 3)]) for i in range(20)]  # alike in the first word only
    df = spark.createDataFrame(rows, "node long, fp long, e1 long, e2 long, e3 long")
    for part in (df, df.where("node < 60 or node >= 1000")):  # a large shard and small ones
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(part, 10, most=34)).collect()}
        assert {roots.get(n[0]) for n in part.where("node < 1000").collect()} == {0} and not [n for n in roots if n >= 1000]


def test_components_of_a_long_chain(spark):
    got = simhash.components(spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "u long, v long")).collect()
    assert {r["root"] for r in got if r["node"] <= 200} == {0} and len(got) == 203
