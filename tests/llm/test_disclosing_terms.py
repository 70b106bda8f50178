"""Disclosing terms: statistics against plain code, terms wherever they stand, copies, thresholds."""

import math
from collections import defaultdict

import regex

from sessionlens.llm import pii

TERM = regex.compile(r"[\p{L}\p{N}]+")
WIDTH, LEAST_ENTITIES = 48, 5


def plain_terms(rows, tolerance, least_share=0.5):
    """(id, term places) of every row and the terms, from base spans and texts alone."""
    held, kinds, pairs, kind_pairs, vocabulary, free_of = (defaultdict(set) for _ in range(6))
    for n, (_, text, base) in enumerate(rows):
        for kind, a, b in base:
            entity = (kind, text[a:b])
            held[entity].add(n)
            kinds[kind].add(n)
            low, high = max(0, a - WIDTH), min(len(text), b + WIDTH)
            for before, part in ((True, text[low:a]), (False, text[b:high])):
                for m in TERM.finditer(part):
                    # a word at the window's far edge may go on beyond it and doesn't count
                    if (low == 0 or m.start() > 0) if before else (high == len(text) or m.end() < len(part)):
                        pairs[entity, m[0].lower()].add(n)
                        kind_pairs[kind, m[0].lower()].add(n)
        for w in {m[0] for m in TERM.finditer(text.lower())}:
            vocabulary[w].add(n)
            if not base:
                free_of[w].add(n)
    n, free = len(rows), sum(not base for _, _, base in rows)
    share = defaultdict(float)

    def judge(term, together, holding):
        if term in vocabulary:
            s = math.log2(together * n / (holding * len(vocabulary[term]))) / max(math.log2(n / holding), 1e-9)
            share[term] = max(share[term], s)

    for (entity, term), where in pairs.items():
        judge(term, len(where), len(held[entity]))
    for (kind, term), where in kind_pairs.items():
        if sum(1 for (e, t) in pairs if e[0] == kind and t == term) >= LEAST_ENTITIES:
            judge(term, len(where), len(kinds[kind]))
    steps = defaultdict(int)
    for term, s in share.items():
        if s >= least_share:
            steps[math.floor(s * 1000)] += len(free_of[term])
    threshold, passed = 2.0, 0
    for step in sorted(steps, reverse=True):
        passed += steps[step]
        if passed > tolerance * free:
            break
        threshold = step / 1000
    return {t for t, s in share.items() if math.floor(s * 1000) / 1000 >= threshold}


def test_statistics_against_plain_code(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    said = "the number of {0} is in the file and no other place {1} "
    more = [(10_000 + i, (said.format(f"name{i % 7}", "office") + f"u{i % 7}@mail.com " + "Rest of It. " * i)) for i in range(30)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for tolerance in (0.05,):
        got = pii.find_pii(docs, tolerance=tolerance).collect()
        text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        parts = {r["doc_id"]: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)] for r in got}
        rows = [(i, text[i], [p for p in ps if p[0] != "term"]) for i, ps in parts.items()]
        terms = plain_terms(rows, tolerance)
        assert terms
        if tolerance == 0.05:  # the same where nothing may be sent to the tasks
            again = pii.find_pii(docs, tolerance=tolerance, most_sent=0).collect()
            assert sorted((r["doc_id"], r["spans"]) for r in again) == sorted((r["doc_id"], r["spans"]) for r in got)
        for i, t, base in rows:
            want = [("term", m.start(), m.end()) for m in TERM.finditer(t) if m[0].lower() in terms and not any(a <= m.start() and m.end() <= b for _, a, b in base)]
            assert [p for p in parts[i] if p[0] == "term"] == want, i
        assert all(r["n_base"] == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got)


def test_terms_are_spanned_everywhere_and_by_entity(spark):
    filler = "plain words stand here and there " * 8
    rows = [(i, f"customercode u{i}@mail.com {filler}") for i in range(40)] + [(100, f"{filler}customercode é alone"), (101, filler)]
    rows += [(200 + i, f"johndoe42 j@mail.com {filler} number {'x' * (i + 1)}") for i in range(3)] + [(210, "so johndoe42 stays")]
    rows += [(1000 + i, filler) for i in range(200)]
    rows += [(300 + i, f"copyword c@mail.com {filler}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(df, tolerance=0.7).collect()}
    n = len(filler)
    assert got[3] == "email:13:24,term:0:12" and got[100] == f"term:{n}:{n + 12}" and got[101] == ""
    assert got[200] == "email:10:20,term:0:9" and got[210] == "term:3:12"
    assert got[300] == "email:9:19,term:0:8"
    strict = {r["doc_id"]: r for r in pii.find_pii(df, tolerance=0.0).collect()}
    assert strict[100]["n_term"] == 0 and strict[210]["n_term"] == 0  # no text without an entity may lose a word


def test_no_entities_and_odd_rows(spark):
    rows = [(1, None), (None, ""), (1, "no one is here"), (1, "no one is here")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, terms int")
    got = pii.find_pii(df).collect()
    assert len(got) == 4 and all(r["spans"] == "" and r["n_term"] == 0 for r in got)
