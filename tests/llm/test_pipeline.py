"""The corpus pipeline on small tables, stage by stage against plain code."""

from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlens.llm import pieces, quality

D = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) > 0


def plain_near(rows):
    """Positions that stay of (id, text) rows: of each class of near copies the smallest id, null last."""
    sets, top = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                top[root(i)] = root(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        key = (doc_id is None, doc_id or 0, i)
        best[root(i)] = min(best.get(root(i), key), key)
    return Counter((None if none else i) for none, i, _ in best.values())


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with null and repeated ids and texts, near copies, a very long text, and columns that clash."""
    base = spark.read.parquet(f"{D}/documents.parquet")
    long = "the of and to in " * 20_000
    text = " ".join(f"word{i}" for i in range(200))
    more = [
        (None, text, "s1"), (None, text + " end", "s1"), (10**6, text + " tail", "s2"), (5, "unrelated words under an id in use " * 4, "s1"),
        (5, "unrelated words under an id in use " * 4, "s1"), (10**6 + 1, None, None), (10**6 + 2, "", "s1"), (None, None, "s2"), (10**6 + 3, long, None), (10**6 + 4, long + "x", "s2"),
    ]
    both = base.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    names = ("row", "id", "h", "prefix", "block", "blocks", "keep", "node", "root", "nth", "taken", "copies", "_id", "_h", "_rn", "_row", "size", "score", "unit", "ids")
    return both.withColumns({n: F.lit("x") for n in names}).repartition(4).cache()


def texts(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect())


def test_quality_stage_keeps_what_the_score_says(spark, docs):
    got = STAGE["quality"](spark, docs, D)
    model = quality.fit_quality(docs, spark.read.parquet(f"{D}/labels.parquet"))
    assert got.columns == docs.columns
    want = Counter(r for r, n in texts(docs).items() for _ in range(n) if model.scores([r[1]])[0] >= 0.3)
    assert texts(got) == want


def test_exact_stage_against_plain_groups(spark, docs):
    groups = {}
    for (i, t, s), n in texts(docs).items():
        groups.setdefault((t or "").translate(LOWER), []).extend([(i is not None, i or 0, t, s)] * n)
    got = STAGE["exact_dedup"](spark, docs, D)
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], (r["text"] or "").translate(LOWER)) for r in got.collect())
    assert kept == Counter(((max(g)[1] if max(g)[0] else None), key) for key, g in groups.items())


def test_near_stage_against_all_pairs(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = STAGE["near_dedup"](spark, docs, D)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == plain_near(rows)


def test_mixing_stage_emits_what_the_mix_takes(spark, docs):
    from sessionlens.llm import mixing

    got = STAGE["mixing"](spark, docs, D)
    assert got.columns == docs.columns
    size = lambda t: len((t or "").split())
    want, have = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    for r in got.collect():
        have[r["doc_id"], size(r["text"])] += 1
    assert have == +want and sum(n * s for (_, s), n in have.items()) == sum(r["taken"] for r in mixing.mix(docs).collect())
    total = sum(size(r["text"]) for r in docs.collect())
    assert abs(sum(n * s for (_, s), n in have.items()) - 1.5 * total) <= 2 * max(s for _, s in have)


def test_sentencepiece_stage_equals_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    few = docs.where("doc_id < 60 or doc_id >= 1000000 or doc_id is null")
    want = Counter((r["doc_id"], tuple(sp.encode(r["text"] or ""))) for r in few.collect())
    out = STAGE["sentencepiece"](spark, few, D).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == want and all(r["round_trip"] for r in out)


def test_stages_work_on_what_the_one_before_kept(spark):
    left = spark.read.parquet(f"{D}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        new = f(spark, left, D).cache()
        assert new.columns == left.columns
        assert {r["doc_id"] for r in new.collect()} <= {r["doc_id"] for r in left.collect()}, name
        left = new
    assert corpus_pipeline.run(spark, D).count() == left.count() > 0


def test_empty_documents_and_labels(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), D).count() == 0
    flat = quality.fit_quality(docs, spark.read.parquet(f"{D}/labels.parquet").limit(0))
    assert quality.keep_good(docs, flat).count() == docs.count()
