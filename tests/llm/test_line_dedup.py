"""Line dedup against a plain version; runs, levels and both ways of joining."""

from collections import Counter

import duckdb

from sessionlens.llm import line_dedup
from tests.llm.test_lexical import LOWER, rows


def plain(docs, least, least_chars=1):
    lines = [(d, (t or "").split("\n")) for d, t in docs]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    n = Counter(k for _, ls in lines for k in {key(x) for x in ls} if len(k) >= least_chars)
    return sorted([(d, "\n".join(x for x in ls if n[key(x)] < least), len(ls), sum(n[key(x)] >= least for x in ls)) for d, ls in lines], key=str)


DOCS = [
    (1, "Common\na\n\n b"), (2, " common\t\nCOMMON\nc"), (3, "common"), (None, "x\ncommon \r"), (None, "x\ncommon \r"), (5, None), (5, ""), (6, "\n\n"),
    (7, "É\nà"), (8, "é\nà"), (9, "À\nà"), (10, "y\n" * 20_000 + "common"), (11, "\x85common\n a"), (12, "a\nb\nend"), (12, "a\nb\nend"),
]


def test_edges(spark):
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in DOCS], "doc_id long, text string, n_lines string, h1 int").repartition(3)
    for how in ({}, {"batches": 3, "fanout": 2}, {"most_broadcast": 0, "hot": 1, "batches": 1}):
        got = line_dedup.without_common_lines(df, least=3, **how)
        assert got.columns == ["doc_id", "text", "n_lines", "h1", "_n_lines", "n_dropped"]
        assert rows(got.select("doc_id", "text", "_n_lines", "n_dropped")) == plain(DOCS, 3)
    assert rows(line_dedup.without_common_lines(df, least=2, least_chars=2, batches=1).select("doc_id", "text", "_n_lines", "n_dropped")) == plain(DOCS, 2, 2)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_runs(spark):
    runs = line_dedup.LineRuns(spark, least=3, fanout=2, buckets=4)
    for b in range(5):
        runs.add(spark.range(100).selectExpr("id as h1", "id * 7 as h2", f"if(id % 5 <= {b}, 1L, 0L) as n").where("n > 0"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    # a key that is settled in a run is not written again
    assert runs.spark.table(runs.levels[0][0]).count() == 60
    assert rows(runs.frequent().selectExpr("h1 % 5 as r").distinct()) == [(0,), (1,), (2,)]
    plan = runs.runs()[0].join(runs.runs()[1].hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()
    assert not runs.made


def test_tables(spark, sf_dir):
    got = line_dedup.line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sql = line_dedup.LINES_SQL.format(docs=f"'{sf_dir}/documents.parquet'")
    assert rows(got) == sorted(duckdb.connect().sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({sql})").fetchall(), key=str)
