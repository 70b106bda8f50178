"""Rows are told apart by themselves: null, repeated and text ids, clashing columns."""

from sessionlens.llm import mixing, pii


def test_sanitised_by_row(spark):
    rows = [(None, "mail a@b.de now", 1), (7, "y card 4111 1111 1111 1111", 2), (7, "x", 3), (8, "ip 10.0.0.1, a@b.de", 4), (9, None, 5), (9, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans int").repartition(3)
    got = {r["_spans"]: (r["doc_id"], r["text"]) for r in pii.sanitised(df, least_share=2.0).collect()}
    assert got == {1: (None, "mail [EMAIL] now"), 2: (7, "y card [CARD]"), 3: (7, "x"), 4: (8, "ip [IP], [EMAIL]"), 5: (9, None), 6: (9, "")}
    assert pii.sanitised(df).columns == df.columns


def test_mixing_takes_ids_of_any_type(spark):
    rows = [(f"d{i}" if i % 5 else None, "w " * (i % 7), "s" if i % 2 else "t") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(3)
    got = mixing.mix(df).collect()
    assert len(got) == 60 and sum(r["taken"] for r in got) > 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mixed(df).count() == sum(r["copies"] for r in got)
