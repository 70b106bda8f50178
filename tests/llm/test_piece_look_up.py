"""Words are given their ids in arrays, without Python code for each of them."""

import random
import sys

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sessionlens.llm import pieces


def many_words():
    random.seed(5)
    return ["".join(random.choices("abcdefghijklmnopéß,.😀漢ਊ", k=random.randint(1, 14))) for _ in range(20_000)] + ["x" * 60, "word", "word", "▁▁marked"]


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary()


def test_new_words_cost_no_python_calls(vocab):
    words = many_words()
    known = pieces.PieceIds(vocab, pieces.UnitTable(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        ids, n = known.of(words, {})
    finally:
        sys.setprofile(None)
    assert len(n) == len(words) and n.sum() == len(ids)
    assert calls < 2_000


def test_ids_of_many_words_are_the_library_s(spark, vocab):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    words = many_words()
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + ["", " lead", "two  spaces", "trail "]
    want = {i: sp.encode(t) for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for most in (4_000_000, 3_000):
        assert {r["doc_id"]: list(r["ids"]) for r in pieces.encode(df, vocab=vocab, table_units=most).collect()} == want


def test_units_are_counted_over_all_texts(spark, vocab):
    df = spark.createDataFrame([("word word, a word",), ("word",), (None,), ("",), ("b" * 60,)], "text string").repartition(2)
    got = {r["unit"]: r["n"] for r in pieces.distinct_units(df, vocab, "text", most_chars=5).collect()}
    assert got["▁word"] == 4 and got["▁a"] == 1 and all(2 <= len(u) <= pieces.LONGEST for u in got)


def test_lattice_holds_every_piece_once(spark, vocab):
    unit = "▁reading"
    got = pieces.lattice(spark.createDataFrame([(unit,), ("▁a",)], "unit string"), spark, vocab).where(F.col("unit") == unit).first()["edges"]
    want = [(-vocab.scores[unit[a:b]], a, b - a) for a in range(len(unit)) for b in range(a + 2, len(unit) + 1) if unit[a:b] in vocab.scores]
    assert sorted(map(tuple, got)) == sorted(want)
