"""Learned operators: held-out accuracy, edges, and gradients."""

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sessionlens.llm import common, language, quality, toxicity

EDGES = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "12 34 !!"), (10**6 + 3, "the of and " * 40_000), (10**6 + 4, "x" * 200_000), (None, "the of and to in"), (10**6 + 5, "é"), (10**6 + 5, "é")]


@pytest.fixture(scope="module")
def data(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = spark.createDataFrame(EDGES, "doc_id long, text string")
    # columns that clash with the operators' own
    both = docs.unionByName(extra, allowMissingColumns=True).withColumns({"score": F.lit("x"), "held_out": F.lit(3), "predicted": F.lit(1), "_id": F.lit(0)})
    return both.repartition(4).cache(), spark.read.parquet(f"{d}/labels.parquet").withColumn("text", F.lit("clash"))


def edge_rows(got):
    rows = [r for r in got if r["doc_id"] is None or r["doc_id"] >= 10**6]
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in rows if r["doc_id"] == 10**6 + 5]
    assert same[0] == same[1]
    return rows


def test_language(data):
    docs, _ = data
    model = language.fit_language(docs, rows=120)
    got = language.identify(docs, model).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    seen = [(lang[r["doc_id"]], r["lang_pred"]) for r in got if r["held_out"] and lang.get(r["doc_id"])]
    assert np.mean([a == b for a, b in seen]) > 0.97
    rows = {r["doc_id"]: r for r in edge_rows(got)}
    assert [rows[10**6 + k]["lang_pred"] for k in (0, 1, 2)] == ["und"] * 3 and rows[10**6 + 5]["lang_pred"] in model.langs
    assert rows[10**6]["rejected"] and rows[10**6]["score"] == 0
    assert language.identify(docs.limit(0), model).count() == 0
    for nothing in (docs.limit(0), docs.where("lang is null"), docs.withColumn("text", F.lit("12 !!"))):
        none = language.fit_language(nothing)
        assert none.langs == []
        assert {(r["lang_pred"], r["score"], r["rejected"]) for r in language.identify(docs.limit(20), none).collect()} == {("und", 0.0, True)}
    one = language.fit_language(docs.where("lang = 'en'"), rows=20)
    assert {r["lang_pred"] for r in language.identify(docs, one).collect()} == {"en", "und"}


def test_language_against_plain_averages(data):
    docs, _ = data
    model = language.fit_language(docs, rows=30)
    texts = [r["text"] for r in docs.where("doc_id < 60").collect()] + ["é", "a b", "The same the same"]
    for t, p in zip(texts, model.probabilities(texts), strict=True):
        rows = []
        for w in t.lower().encode().split():
            marked = b"<" + w + b">"
            for n in language.SIZES:
                rows += [model.table[plain_hash(marked[i : i + n], n)] for i in range(len(marked) - n + 1)]
        z = (np.mean(rows, axis=0) + model.bias) / model.temperature
        e = np.exp(z - z.max())
        assert np.allclose(e / e.sum(), p, atol=1e-9)


def plain_hash(gram, n):
    h = n
    for c in gram:
        h = (h ^ c) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 29
    return h % language.BUCKETS


def test_quality(data):
    docs, labels = data
    model = quality.fit_quality(docs, labels)
    got = quality.quality_scores(docs, model).collect()
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["predicted"], y[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in y]
    assert np.mean([a == b for a, b in held]) > 0.9
    edge_rows(got)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.keep_good(docs, model).count() == sum(r["predicted"] for r in got)
    flat = quality.fit_quality(docs, labels.where("quality = 1"))
    assert {round(r["score"], 6) for r in quality.quality_scores(docs, flat).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), model).count() == 0


def test_quality_against_plain_zstandard(data):
    docs, labels = data
    model = quality.fit_quality(docs, labels)
    size = lambda part, d: len(zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(part))
    text = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 40 or doc_id >= 1000000").collect()}
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, model).collect()}
    for i, t in text.items():
        data = (t or "").encode()
        parts = [data[k : k + 128] for k in range(0, len(data), 128)]
        gap = sum(size(p, model.bad) - size(p, model.good) for p in parts[:40]) if len(parts) <= 40 else None
        if gap is not None:
            z = model.weights @ [gap / max(1, len(data)), np.log1p(len(data)), 1]
            assert abs(got[i]["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and got[i]["predicted"] == (got[i]["score"] >= 0.3)


def test_toxicity(spark, data):
    edges, _ = data
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    docs = docs.unionByName(edges.where(F.col("doc_id").isNull() | (F.col("doc_id") >= 10**6)), allowMissingColumns=True).repartition(4)
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.toxicity_scores(docs, model).collect()
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["score"], y[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in y]
    up, down = [s for s, k in held if k], [s for s, k in held if not k]
    assert np.mean([a > b for a in up for b in down]) > 0.8
    edge_rows(got)
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_network_gradients():
    net, rng = toxicity.ToxicNet(), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = rng.normal(size=(7, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    ids, y = rng.integers(0, 7, (3, 5)), np.array([1.0, 0.0, 1.0])
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    g, dx, _ = net.gradients(x, ids, mask, y)

    def loss():
        return net.gradients(x, ids, mask, y)[2]

    for k in ("fx", "fh", "fc", "bx", "bh", "bc", "att", "pick", "out", "bias"):
        at = tuple(rng.integers(0, n) for n in net.p[k].shape)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-4
        up = loss()
        net.p[k][at] = keep - 1e-4
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / 2e-4 - g[k][at]) < 2e-3, k
    x[2, 3] += 1e-4
    up = loss()
    x[2, 3] -= 2e-4
    assert abs((up - loss()) / 2e-4 - dx[2, 3]) < 2e-3


def test_table_gradients():
    net, words, y = toxicity.ToxicNet(), [b"abcd", b"bcde", b"x"], np.array([1.0, 0.0])
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    ids, mask = np.array([[0, 1, 2], [1, 0, 3]]), np.array([[1, 1, 1], [1, 1, 0]], bool)
    x = lambda: np.concatenate([net.inputs(words).astype(np.float64), np.zeros((1, toxicity.WORD_DIM + toxicity.CHAR_DIM))])
    loss = lambda: net.gradients(x(), ids, mask, y)[2]
    for name, (rows, grad) in net.table_gradients(words, net.gradients(x(), ids, mask, y)[1][:-1]).items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        spot = rows[at[0]], at[1]
        keep = net.p[name][spot]
        net.p[name][spot] = keep + 1e-2
        up = loss()
        net.p[name][spot] = keep - 1e-2
        down = loss()
        net.p[name][spot] = keep
        assert grad[at] != 0 and abs((up - down) / 2e-2 - grad[at]) < 0.02 * abs(grad[at]), name


def test_forward_pass_against_plain_network():
    """The vectorised network against one that takes a window's words one by one."""
    net, rng = toxicity.ToxicNet(seed=4), np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)) for _ in range(50)]
    x, p, h_n = net.inputs(words), net.p, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))

    def plain(ids):
        states = {}
        for side, order in (("f", range(len(ids))), ("b", range(len(ids) - 1, -1, -1))):
            h = np.zeros(h_n)
            for t in order:
                a, r = x[ids[t]] @ p[f"{side}x"] + p[f"{side}c"], h @ p[f"{side}h"]
                z, g = sig(a[:h_n] + r[:h_n]), sig(a[h_n : 2 * h_n] + r[h_n : 2 * h_n])
                h = h + z * (np.tanh(a[2 * h_n :] + g * r[2 * h_n :]) - h)
                states[side, t] = h
        hs = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(ids))])
        e = np.tanh(hs @ p["att"]) @ p["pick"]
        w = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        return float(w @ hs @ p["out"] + p["bias"][0])

    windows = [rng.integers(0, 50, 12) for _ in range(6)]
    rows = np.concatenate([net.project(words), np.zeros((1, 6 * h_n), np.float32)])
    got = net.run(rows, np.array(windows), np.ones((6, 12), bool))
    assert np.allclose(got, [plain(w) for w in windows], atol=1e-4)
    text = " ".join(words[i].decode() for i in rng.integers(0, 50, 12))
    top, first, n = net.best_windows([text])
    assert n[0] == 1 and first[0] == 0


def test_windows_overlap_and_cover():
    starts, owner = toxicity.windows(np.array([0, 5, 32, 33, 100]))
    for i, n, base in ((0, 0, 0), (1, 5, 0), (2, 32, 5), (3, 33, 37), (4, 100, 70)):
        own = starts[owner == i] - base
        assert own[0] == 0 and (n <= 32 or own[-1] == n - 32) and (np.diff(own) <= toxicity.STRIDE).all()


def test_labels_never_come_from_the_held_out_fifth(data):
    docs, labels = data
    flipped = labels.withColumns({"quality": F.when(common.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))})
    a = common.labelled_sample(docs, labels, "quality", 400)
    b = common.labelled_sample(docs, flipped, "quality", 400)
    assert a[0] == b[0] and (a[1] == b[1]).all()
