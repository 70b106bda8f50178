"""Neighbours, personal data, secrets and pieces against plain versions."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sessionlens.llm import neighbours, pieces, pii, secrets


def test_neighbours_recall_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(600, 12)), 3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000 + 50 * k, rows[3][1]) for k in range(30)]  # one vector many times
    rows += [(5000, None), (5050, [0.0] * 12), (5100, [float("nan")] * 12), (5150, [1.0, None] + [0.0] * 10), (5200, [float("inf")] * 12), (5250, [1.0, 2.0]), (None, rows[0][1]), (5300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "ids": F.lit(2), "v": F.lit(3)}).repartition(3)
    got = neighbours.nearest(df, shard_rows=200).toPandas()
    ids = np.array([i for i, v in rows if v and i is not None and (i < 5000)])
    vec = np.array([v for i, v in rows if v and i is not None and (i < 5000)])
    n = np.sqrt((vec * vec).sum(axis=1))
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        at = int(np.flatnonzero(ids == q)[0])
        s = np.round((vec * vec[at]).sum(axis=1) / (n * n[at]), 12)
        s[at] = -9
        best = ids[np.lexsort((ids, -s))[:5]].tolist()
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and q not in mine.vec_id.tolist() and mine.score.is_monotonic_decreasing
        hit, total = hit + len(set(best) & set(mine.vec_id)), total + 5
        if q >= 1000:
            assert mine.vec_id.tolist() == best  # copies of one vector tie, smaller ids first
    assert hit / total >= 0.9 and not (set(got.query_id) | set(got.vec_id)) - set(ids.tolist())
    assert neighbours.nearest(df.where("vec_id >= 5000")).count() == 0 and neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_neighbours_of_extreme_size(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    size = np.array([1e-300, 1e-200, 1.0, 1e200, 1e300])[np.arange(300) % 5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x * size[:, None])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert len(got) == 150 and all(abs(r["score"] - unit[r["query_id"]] @ unit[r["vec_id"]]) < 1e-12 for r in got)
    want = {q: set(np.argsort(-(unit @ unit[q]))[1:6].tolist()) for q in range(0, 300, 10)}
    assert np.mean([r["vec_id"] in want[r["query_id"]] for r in got]) > 0.9


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def plain_pii(t):
    t, out = t or "", []
    digits = lambda v: re.sub("[^0-9]", "", v)
    out += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_against_plain_version(spark):
    random.seed(4)
    bits = ["a", "b.c", "@", "x-1", ".", "_", "%", "1", "22", "255", "256", "007", " ", "-", "+", "+1", "(", ")", "4111111111111111", "4111-1111 1111 1111", "555-0100", "😀", "é", "\n", "example.com", "12.3.4.5"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 24))) for _ in range(1500)] + [None, "", "1 " * 20_000, "a@b" + ".c" * 20_000, "x" * 100_000]
    rows = list(enumerate(texts)) + [(None, "q@r.st"), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"email": F.lit(1), "row": F.lit(2), "near": F.lit(3), "n_ip": F.lit(4)}).repartition(4)
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), hashlib.sha256(plain_pii(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want
    assert pii.find_pii(df.limit(0)).count() == 0


def test_disclosing_terms_are_found_and_removed(spark):
    rows = [(i, f"filler words here customercode user{i}@mail.com and more filler words here") for i in range(40)] + [(100 + i, "filler words here and more filler words here " * 5) for i in range(60)] + [(500, "nothing customerless here"), (501, None)]
    rows += [(700 + i, "rareword copy@mail.com") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.cut(pii.found_in(df, "doc_id", "text", 48))
    assert sorted(r["term"] for r in pii.disclosing_terms(found).collect()) == ["customercode", "rareword"]
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert got[3]["spans"] == "email:31:45,term:18:30" and got[3]["n_term"] == 1 and got[100]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert clean[3] == "filler words here  [EMAIL] and more filler words here" and clean[501] is None and clean[500] == rows[100][1]


def plain_secrets(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets_against_plain_version(spark):
    random.seed(5)
    bits = ["password", "PASSWD", "api_key", "apiKey", "toKen", "ſecret", "secret", ": ", "=", " = \"", "'", "AKIA", "ABCDEF12345678", "0123456789abcdef", "deadbeef", "xyzxyzxyzxyz", " ", "é", "😀", "\n", "Q1w2E3r4T5y6", "token"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 14))) for _ in range(1500)] + [None, "", "a" * 100_000, "token=" * 20_000]
    texts += [f"token = \"{random.getrandbits(160):040x}\" text words " for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, "token=abcdefabcdef12"), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"found": F.lit(1), "spans": F.lit(2)}).repartition(4)
    model = secrets.fit_secrets(df)
    got = secrets.find_secrets(df, model).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == sorted((str(i), hashlib.sha256(plain_secrets(t).encode()).hexdigest()) for i, t in rows)
    assert secrets.find_secrets(df.limit(0), model).count() == 0
    assert secrets.fit_secrets(df.limit(0)).automata == {}


def test_automata_tell_formats_apart():
    random.seed(6)
    hexes = [f"{random.getrandbits(160):040x}".translate(secrets.SYMBOLS) for _ in range(300)]
    a = secrets.Automaton(hexes)
    assert len(a.tables()[0]) < 300  # merged, from 300 * 40 states of the prefix tree
    fresh = f"{random.getrandbits(160):040x}".translate(secrets.SYMBOLS)
    assert a.score(fresh) / 41 > a.score("thequickbrownfoxjumps123".translate(secrets.SYMBOLS)) / 25 + 1
    words = secrets.Automaton(["ab", "ab", "ab", "ac"])
    assert words.score("ab") > words.score("ac") > words.score("zz")


def test_gains_against_plain_scores():
    random.seed(7)
    token = lambda n: "".join(random.choices("abcdefghijklmnopqrstuvwxyzABCDEFXYZ0123456789+/_.=-", k=n))
    values = {"hex": [f"{random.getrandbits(128):032x}" for _ in range(60)], "assign": [token(random.randint(12, 20)) for _ in range(60)]}
    automata = {k: secrets.Automaton([v.translate(secrets.SYMBOLS) for v in vs]) for k, vs in values.items()}
    pairs = {(x, y): random.randint(1, 50) for x in "^0agA" for y in "0agA$"}
    model = secrets.SecretModel(automata, pairs)
    names = "^" + secrets.ALPHABET
    total = {x: len(secrets.ALPHABET) + 1 + sum(n for (p, _), n in pairs.items() if p == x) for x in names}
    runs = [token(random.choice([12, 13, 40, 255, 256, 257, 900])) for _ in range(300)] + values["hex"]
    for run, gain in zip(runs, model.gains(runs), strict=True):
        symbols = run.translate(secrets.SYMBOLS)
        plain = sum(math.log((pairs.get((x, y), 0) + 1) / total[x]) for x, y in zip("^" + symbols, symbols + "$", strict=True))
        want = (max(a.score(symbols) for a in automata.values()) - plain) / (len(run) + 1)
        assert abs(gain - want) < 1e-9
    assert len(model.gains([])) == 0


def test_formats_are_found_without_keyword(spark):
    random.seed(8)
    word = lambda: "".join(random.choice(["on", "the", "re", "tion", "ly", "en", "er"]) for _ in range(random.randint(1, 9)))
    key = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=32))
    prose = lambda: " ".join(word() for _ in range(60))
    clean = [(i, f"{prose()} {'internationalization' * (i % 2)} 2024-01-0{i % 9 + 1} https://www.example.com/a/{word()} {prose()}") for i in range(400)]
    taught = [(1000 + i, f"{prose()} api_key = '{key()}' {prose()}") for i in range(200)]
    bare = [(2000 + i, f"{prose()} {key()} {prose()}") for i in range(30)]
    df = spark.createDataFrame(clean + taught + bare, "doc_id long, text string").repartition(4)
    # the keys without a keyword are themselves ordinary runs to the calibration, so it must let that many pass
    model = secrets.fit_secrets(df, false_alarms=0.02)
    got = {r["doc_id"]: r for r in secrets.find_secrets(df, model).collect()}
    assert sum(got[i]["n_format"] for i, _ in clean) <= 4
    assert sum(any(len(f) == 32 for f in got[i]["found"]) for i, _ in bare) >= 24
    values = [got[i] for i, _ in taught]
    assert sum(r["n_format"] for r in values) >= 150 and all(r["n_assign"] == 1 for r in values)
    assert all("format:" in r["spans"] for r in values if r["n_format"])


def test_secrets_in_a_very_long_text(spark):
    random.seed(9)
    hexes = [f"{random.getrandbits(80):020x}" for _ in range(40_000)]
    model = secrets.SecretModel({"hex": secrets.Automaton([h.translate(secrets.SYMBOLS) for h in hexes[:200]])}, {("g", "g"): 100}, 0.5)
    text = " ".join(hexes) + " " + "Zz9" * 3_000_000
    began = time.time()
    base = secrets.base_spans(text)
    found = model.formats([text], [base])[0]
    assert len(base) == 40_000 and time.time() - began < 30
    assert all(k == 3 and (s, e) not in {(x, y) for x, _, y in base[:10]} for s, k, e in found)


def test_pieces_equal_the_library(spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "  Hello   world\n\tx 😀 ąę 漢字 " + "a" * 1000 + " " * 40 + "b" * 49), (10**6 + 3, "\n\n"), (10**6 + 4, " "), (None, "null id"), (10**6 + 4, " ")]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80).unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumns({"unit": F.lit(1), "row": F.lit(2), "ids": F.lit(3)}).cache()
    want = sorted((str(r["doc_id"]), sp.encode(r["text"] or "")) for r in df.collect())
    for most in (4_000_000, 500):
        got = pieces.encode(df, table_units=most)
        assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got.collect()) == want
        assert got.where("not round_trip or n_pieces <> size(ids)").count() == 0
    back = {(str(r["doc_id"]), r["text"]) for r in pieces.decode(got).collect()}
    assert back == {(str(r["doc_id"]), r["text"] or "") for r in df.collect()}
    assert pieces.encode(df.limit(0)).count() == 0


def best_path(word, scores, longest):
    best = [(0.0, [0])]
    for end in range(1, len(word) + 1):
        ways = []
        for a in range(max(0, end - longest), end):
            s = scores.get((a, end))
            if s is not None or end - a == 1:
                ways.append((best[a][0] + (-1e6 if s is None else s), best[a][1] + [end]))
        best.append(max(ways))
    return best[-1][1]


def test_viterbi_takes_the_best_path(spark):
    random.seed(8)
    rows = []
    for _ in range(60):
        word = "".join(random.choices("abc", k=random.randint(2, 9)))
        rows.append((word, {a * 64 + n: -random.random() * 10 for a in range(len(word)) for n in range(1, min(4, len(word) - a) + 1) if random.random() < 0.6}))
    df = spark.createDataFrame(rows, "unit string, edges map<int,double>")
    got = df.select("unit", "edges", pieces.viterbi_cuts(F.col("unit"), F.col("edges"), 4).alias("cuts")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["cuts"] == best_path(r["unit"], {(k // 64, k // 64 + k % 64): s for k, s in r["edges"].items()}, 4)
