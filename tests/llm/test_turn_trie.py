"""The trie of conversations against a plain one; parentheses against a scan; shards and segments of any size."""

import hashlib
import random
import zlib

import duckdb
import numpy as np

from sessionlens.llm import turn_trie
from tests.llm.test_lexical import rows


def plain(turns):
    own = {}
    order = sorted([t for t in turns if t[0] is not None], key=lambda t: (t[1] is not None, t[1] or 0))
    for c, _, role, text in order:
        own.setdefault(c, []).append((role or "", text or ""))
    path = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path[c] = (*own.get(c - c % 20, [])[:h], *ts[h:])
    nodes = {p[:d] for p in path.values() for d in range(len(p) + 1)}
    members = {n: sorted(c for c, p in path.items() if p[: len(n)] == n) for n in nodes}
    kids = {n: [x for x in nodes if x[:-1] == n and x] for n in nodes}
    out = []
    for n in nodes:
        sub = [x for x in nodes if x[: len(n)] == n]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1].split()) if x else 0) for x in sub)
        ends = ",".join(str(c) for c in members[n] if len(path[c]) == len(n))
        out.append((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(kids[n]), sum(not kids[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def invented(seed, convs=120, most=9):
    """Turns of conversations that share openings, with copies, null fields, gaps and null turn numbers."""
    r = random.Random(seed)
    out = []
    for c in r.sample(range(400), convs):
        n = r.choice([1, 2, 3, most])
        texts = ["a b", "c", None, "d  e\tf"] if r.random() < 0.7 else [f"own {c}", "me", "you"]
        out += [(c, None if i == 0 and r.random() < 0.3 else 3 * i, r.choice(["user", None]) if i % 5 == 4 else "user", texts[i % 2 if r.random() < 0.8 else r.randrange(len(texts))]) for i in range(n)]
    out += [(c, i, "user", "hot") for c in range(1000, 1060) for i in range(6)]  # copies
    return [*out, (None, 1, "user", "x")]


def test_rebuilt_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns = invented(1)
    expected = plain(turns)
    df = spark.createDataFrame([(*t, 1) for t in turns], schema + ", d int").repartition(5)
    for how in ({}, {"shard_nodes": 30}, {"segment": 2, "shard_nodes": 25}, {"segment": 1, "shard_nodes": 1000, "small": 0}):
        assert rows(turn_trie.turn_trie(df, **how)) == expected
    assert turn_trie.turn_trie(df.limit(0)).count() == 0
    assert turn_trie.turn_trie(df.where("conv_id is null")).count() == 0


def test_parentheses():
    r = random.Random(3)
    for n in (1, 2, 700, 3000):
        depth = [0]
        for _ in range(n - 1):
            depth.append(r.randint(0 if r.random() < 0.02 else min(1, depth[-1] + 1), depth[-1] + 1))
        tree = turn_trie.Parentheses(np.array(depth))
        size = [next((j for j in range(i + 1, n) if depth[j] <= depth[i]), n) - i for i in range(n)]
        assert tree.sizes().tolist() == size
        leaf = [i + 1 == n or depth[i + 1] <= depth[i] for i in range(n)]
        assert tree.leaves(np.array(size), np.ones(n, bool)).tolist() == [sum(leaf[i : i + size[i]]) for i in range(n)]


def test_tables(spark, sf_dir):
    got = turn_trie.turn_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    sql = turn_trie.TRIE_SQL.format(conversations=f"'{sf_dir}/conversations.parquet'")
    assert rows(got) == sorted(duckdb.connect().sql(f"select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({sql})").fetchall(), key=str)
