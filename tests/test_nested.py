"""No planted secret is left at any nesting, and nothing else changes."""

import json
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import nested, privacy

SECRET = "hunter2 and more"
PLAIN = f'export DB_PASSWORD="{SECRET}" && ls'
FORMS = {
    "plain": PLAIN, "json": json.dumps({"cmd": PLAIN}), "json in json": json.dumps({"a": json.dumps({"cmd": PLAIN})}), "encoded": quote(PLAIN, safe=""), "twice encoded": quote(quote(PLAIN, safe=""), safe=""),
    "encoded in json": json.dumps({"u": "x\n" + quote(PLAIN, safe="")}), "json in encoded": quote(json.dumps({"cmd": PLAIN}), safe=""), "query": "https://h.com/a?next=" + quote(f"https://u:{SECRET.replace(' ', '')}@h.com/p?token=zzzz9", safe=""),
}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_forms(form):
    got = nested.Scanner().plain(nested.Scanner().inner(FORMS[form]))
    for part in ("hunter2", "and more", "andmore", "zzzz9", quote("hunter2 and")):
        assert part not in got
    assert "[redacted" in got


@pytest.mark.parametrize("text", ['say \\"hi\\" there', "100%25 sure", "a%20b%2Fc", '{"a": "x\\ny", "b": "caf\\u00e9"}', '"open \\', "%zz", '""', ""])
def test_harmless_texts_stay(text):
    assert nested.Scanner().inner(text) == text


def test_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 1500).alias("text"))
    forms = F.array(*[F.lit(v) for v in FORMS.values()])
    planted = docs.withColumn("text", F.concat_ws(" ", "text", F.element_at(forms, (F.col("doc_id") % len(FORMS) + 1).cast("int")), "text"))
    out = planted.select("doc_id", privacy.redact(F.col("text")).alias("t"))
    assert privacy.leaks(out, ["hunter2", "and more", "zzzz9"]).count() == 0
    assert docs.select(nested.unnested(F.col("text")).alias("a"), "text").where(~F.col("text").rlike(nested.NESTED) & (F.col("a") != F.col("text"))).count() == 0
    assert docs.limit(1).select(privacy.redact(F.lit(None).cast("string")).alias("t")).first()["t"] is None
