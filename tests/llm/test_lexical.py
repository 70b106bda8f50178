"""Ranked search against a plain version, term splitting, edges."""

import math
import re
from collections import Counter

import duckdb

from sessionlens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, items, k):
    said = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    n_docs, n_terms = sum(bool(s) for _, s in said), sum(len(s) for _, s in said)
    df = Counter(x for _, s in said for x in set(s))
    out = []
    for item in {i for i, _ in items}:
        terms = Counter(x for i, t in items if i == item for x in TERM.findall((t or "").translate(LOWER)))
        found = []
        for d, s in said:
            tf, score = Counter(s), 0
            for x, times in terms.items():
                if tf[x]:
                    m = 100 - 25 + 25 * len(s) * n_docs // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -minus) for i, (minus, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_terms():
    for text in ("", "A-b_c É9 ÀB\x00c\n\tx ０１ ſK", "Straße zwei", "a" * 100_000):
        assert lexical.terms_of(text.encode()) == [x.encode() for x in TERM.findall(text.translate(LOWER))]
    assert lexical.terms_of(None) == []


def test_edges(spark):
    docs = [(1, "red fox"), (2, "Red red, fox"), (2, "fox"), (None, "red"), (5, None), (6, ""), (7, "..."), (8, "red fox"), (9, "blue " * 50_000 + "fox"), (10, "red")]
    items = [(1, "RED fox fox"), (2, None), (3, ""), (None, "blue"), (4, "nothing here"), (1, "blue")]
    d = spark.createDataFrame([(a, b, "x", 3) for a, b in docs], "doc_id long, text string, item_id string, rank int").repartition(4)
    q = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, score int")
    for k in (1, 3, 20):
        assert rows(lexical.ranked(d, q, k=k, fan_in=2)) == plain(docs, items, k)
    assert rows(lexical.ranked(d, q, block_postings=1)) == plain(docs, items, 20)
    assert lexical.ranked(d.limit(0), q).count() == lexical.ranked(d, q.limit(0)).count() == 0
    assert lexical.ranked(d.where("text is null"), q).count() == 0


def test_tables(spark, sf_dir):
    got = lexical.ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    con = duckdb.connect()
    sql = lexical.RANKED_SQL.format(docs=f"'{sf_dir}/documents.parquet'", items=f"'{sf_dir}/benchmark.parquet'")
    assert rows(got.select("item_id", "rank", "doc_id", "score")) == sorted(con.sql(f"select item_id, rank, doc_id, score from ({sql})").fetchall(), key=str)
