"""Deltas of whole documents: texts of any length, empty and null texts, null and repeated ids."""

import duckdb

from sessionlens.plans import ORACLE_SQL, QUERIES
from sessionlens.sources import feeds

DOCUMENTS = [
    (1, "x" * 4000), (2, "y" * 4001), (3, "0123456789" * 13_000 + "end"), (4, ""), (5, None), (6, "a" * 50), (7, "b" * 49 + "\n\r\n" + "c" * 60), (8, "ä\U0001f600 " * 40),
    (9, "same"), (9, "same"), (9, "other" * 30), (None, "no id"), (None, "no id, too"), (None, None), (10, " "), (11, "\n" * 120),
]


def sort(rows):
    return sorted(map(tuple, rows), key=repr)


def test_every_document_comes_back_whole(spark, tmp_path):
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["assembled_deltas"](spark, str(tmp_path))
    assert got.columns == ["response_id", "text"] and sort(got.collect()) == sort(DOCUMENTS)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sort(c.sql(ORACLE_SQL["assembled_deltas"]).fetchall()) == sort(DOCUMENTS)


def test_documents_are_read_once_and_without_a_filter(spark, sf_dir):
    df = QUERIES["assembled_deltas"](spark, sf_dir)
    df.collect()
    final, first = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")
    assert "ReusedExchange" in final and final.count("FileScan parquet") <= 1  # below a reused exchange none is shown
    assert first.count("PushedFilters: []") == first.count("FileScan parquet") > 0


def test_a_response_of_null_deltas_has_no_text(spark):
    rows = [("a", 0, 0, None, None, None), ("a", 1, 0, None, None, "stop"), ("b", 0, 0, None, "", None), ("c", 0, 0, None, None, None), ("c", 1, 0, None, "x", "stop")]
    texts, bad = feeds.assemble_deltas(spark.createDataFrame(rows, "response_id string, seq long, choice_index int, tool_index int, delta string, finish_reason string"))
    assert {r["response_id"]: (r["text"], r["chunks"]) for r in texts.collect()} == {"a": (None, 2), "b": ("", 1), "c": ("x", 2)} and not bad.collect()
