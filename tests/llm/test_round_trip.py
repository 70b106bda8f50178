"""Round trips of whole documents."""

from sessionlens.llm import pieces


class DropsUnits(pieces.Vocabulary):
    """Loses the last word of a text; every word that is left is spelled right."""

    def words(self, text):
        return super().words(text)[:-1]


def test_round_trip_decodes_the_ids(spark):
    df = spark.createDataFrame([(1, "some words here, 😀 and more of them"), (2, ""), (3, None), (4, "a ▁ mark")], "doc_id long, text string")
    for most in (4_000_000, 2):
        assert {r["doc_id"]: r["round_trip"] for r in pieces.encode(df, table_units=most).collect()} == {1: True, 2: True, 3: True, 4: False}
        assert {r["doc_id"]: r["round_trip"] for r in pieces.encode(df, vocab=DropsUnits(), table_units=most).collect()} == {1: False, 2: True, 3: True, 4: False}
