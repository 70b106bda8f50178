"""What a Python worker of the piece encoder holds at a time doesn't grow with the rows of an Arrow batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sessionlens.llm import pieces


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary()


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    words = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 9))) for _ in range(30_000)]
    return pa.array([" ".join(random.choices(words, k=600)) for _ in range(4_000)] + [None, ""], pa.string())


def most_held(stream) -> tuple[int, int]:
    """Rows of ``stream`` and the most MB that Python and numpy held meanwhile."""
    tracemalloc.start()
    try:
        rows = sum(map(len, stream))
        return rows, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_units_of_a_large_batch_are_counted_slice_by_slice(vocab, texts):
    rows, mb = most_held(pieces.counted_units(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), vocab))
    assert rows and mb < 60


def test_a_large_batch_is_encoded_slice_by_slice(vocab, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts, pa.nulls(len(texts), pa.map_(pa.string(), pa.int64()))], names=["doc_id", "text", "extra"])
    rows, mb = most_held(pieces.encoded_texts(iter([batch]), vocab, pieces.UnitTable(np.zeros(0, np.int64), np.zeros(0, np.int64))))
    assert rows == len(texts) and mb < 150


def test_parts_hold_every_text_once_and_in_order(texts):
    some = pa.array(["aé", None, "", "b" * 9, "漢字", "x"])
    for given, most in ((some, 1), (some, 4), (some, 100), (some.slice(2, 3), 4), (some.slice(0, 0), 4), (texts, 100_000)):
        got = list(pieces.parts(given, most))
        assert [t for _, _, part in got for t in part] == given.to_pylist()
        assert [a for a, _, _ in got] == [0, *[b for _, b, _ in got]][: len(got)] and all(len(p) == b - a for a, b, p in got)
        assert all(sum(len(t or "") for t in p[:-1]) < most for _, _, p in got)


def test_the_piece_table_needs_no_python_workers(spark, vocab):
    plan = pieces.lattice(spark.createDataFrame([("▁reading",)], "unit string"), spark, vocab)._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert plan.count("LocalRelation") == 1 and plan.count("LogicalRDD") == 1  # the units above are a list, which goes by Python
