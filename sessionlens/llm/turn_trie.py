"""Prefix trie of conversations: balanced parentheses in shards, spines that shards share merged in rounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.llm.common import cut, spread_join
from sessionlens.llm.mixing import words_in

DIGEST = 16
NONE = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: What a shard says: finished nodes, ends of open nodes, paths of open nodes, finished tops of deeper segments.
SAID = "kind string, key binary, parent binary, ref boolean, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, text string, id long, words array<long>, load array<long>"


class Parentheses:
    """A forest's balanced parentheses with the least and greatest excess of each block."""

    BLOCK = 512

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.opens = 2 * np.arange(n) - depth  # i nodes opened and i - depth closed before node i
        bits = np.zeros(2 * n, np.int8)
        bits[self.opens] = 1
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        starts = np.arange(0, 2 * n, self.BLOCK)
        self.least, self.most = np.minimum.reduceat(self.excess, starts), np.maximum.reduceat(self.excess, starts)
        self.pairs = (bits == 1) & np.append(bits[1:] == 0, True)  # "()", the leaves

    def findclose(self, at: int) -> int:
        """Where the parenthesis opened at ``at`` closes: the first later place with one less excess."""
        want, block = self.excess[at] - 1, at // self.BLOCK
        inside = self.excess[at + 1 : (block + 1) * self.BLOCK] == want
        if inside.any():
            return at + 1 + int(inside.argmax())
        # the excess changes by one from place to place, so a block whose bounds enclose the value holds it
        block += 1 + int(((self.least[block + 1 :] <= want) & (want <= self.most[block + 1 :])).argmax())
        start = block * self.BLOCK
        return start + int((self.excess[start : start + self.BLOCK] == want).argmax())

    def sizes(self) -> np.ndarray:
        """Nodes of each subtree, its top included."""
        return np.array([(self.findclose(p) - p + 1) // 2 for p in self.opens.tolist()], np.int64)

    def leaves(self, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Leaf pairs between each node's parentheses, without nodes for which ``counts`` is false."""
        own = self.pairs.astype(np.int64)
        own[self.opens[~counts]] = 0
        rank = np.concatenate([[0], np.cumsum(own)])
        return rank[self.opens + 2 * sizes] - rank[self.opens]


def _shared(a: bytes, b: bytes) -> int:
    """How many leading digests two paths share."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * DIGEST] == b[: mid * DIGEST] else (low, mid - 1)
    return low


class ShardTrie:
    """The trie of one shard's paths, which come sorted. A path is a top's digest followed by those of its turns.

    Nodes are in preorder. ``load`` holds for each node what is known of it beside its children here: members that end at
    it or below children that are finished, the smallest of them, and those children's number, leaves and savings.
    """

    def __init__(self, keys: list[bytes], words: list, loads: list, ends: list, segment: int):
        self.keys, self.segment = keys, segment
        depth, parent, digest, own, at, row_of = [], [], [], [], [], []
        self.path_end, self.ends = [], {}
        stack: list[int] = []
        prev = b""
        for r, key in enumerate(keys):
            m, lcp = len(key) // DIGEST, _shared(prev, key)
            del stack[lcp:]
            for p in range(lcp, m):
                up = stack[-1] if stack else -1
                stack.append(len(depth))
                depth.append(p)
                parent.append(up)
                digest.append(self._digest(key, p, digest[up] if p else b""))
                own.append(words[r][p - 1] if p else 0)
                row_of.append(r)
            node = stack[-1]
            self.path_end.append(node)
            load = loads[r]
            at += [(i, *load[5 * p : 5 * p + 5]) for p, i in enumerate(stack)] if len(load) == 5 * m else [(node, *load)]
            if ends[r] is not None:
                self.ends.setdefault(node, []).append(ends[r])
            prev = key
        self.depth, self.parent, self.digest, self.words, self.row_of = np.array(depth), np.array(parent), digest, np.array(own, np.int64), row_of
        self.load = np.zeros((len(depth), 5), np.int64)
        self.load[:, 1] = NONE
        at = np.array(at, np.int64)
        for c in (0, 2, 3, 4):
            np.add.at(self.load[:, c], at[:, 0], at[:, c + 1])
        np.minimum.at(self.load[:, 1], at[:, 0], at[:, 2])
        self._totals()

    def _digest(self, key: bytes, p: int, above: bytes) -> bytes:
        """A node's name: chained over the turns, but over the segment as a whole at its end, where the next segment takes it up."""
        if p == 0:
            return key[:DIGEST]
        if p == self.segment:
            return segment_end(key[:DIGEST], hashlib.sha256(key[DIGEST : (p + 1) * DIGEST]).digest())
        return hashlib.sha256(above + key[p * DIGEST : (p + 1) * DIGEST]).digest()[:DIGEST]

    def _totals(self) -> None:
        n = len(self.depth)
        tree = Parentheses(self.depth)
        size = tree.sizes()
        i = np.arange(n)

        def below(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[i + size] - total[i]

        self.n_convs = below(self.load[:, 0])
        spans = np.stack([i, i + size], axis=1).ravel()
        self.smallest = np.minimum.reduceat(np.append(self.load[:, 1], NONE), spans)[::2]
        self.n_children = self.load[:, 2] + np.bincount(self.parent[self.parent >= 0], minlength=n)
        self.n_leaves = tree.leaves(size, self.load[:, 2] == 0) + below(self.load[:, 3])
        self.saved = below((self.n_convs - 1) * self.words + self.load[:, 4])

    def open_nodes(self, cap: int) -> np.ndarray:
        """Nodes that other shards may hold too: on the first and last path, and below ``cap`` bytes of what these begin with."""
        out = np.zeros(len(self.depth), bool)
        for r in (0, len(self.keys) - 1):
            node = self.path_end[r]
            while node >= 0:
                out[node] = True
                node = self.parent[node]
        edges = {self.keys[0][:cap], self.keys[-1][:cap]}
        for i in np.flatnonzero(self.depth >= cap // DIGEST).tolist():
            out[i] |= self.keys[self.row_of[i]][:cap] in edges
        return out

    def fold(self, is_open: np.ndarray) -> None:
        """Adds to the loads of open nodes what their finished children make."""
        kids = np.flatnonzero(~is_open & (self.parent >= 0))
        kids = kids[is_open[self.parent[kids]]]
        up = self.parent[kids]
        for c, values in ((0, self.n_convs[kids]), (2, np.ones(len(kids), np.int64)), (3, self.n_leaves[kids]), (4, self.saved[kids])):
            np.add.at(self.load[:, c], up, values)
        np.minimum.at(self.load[:, 1], up, self.smallest[kids])

    def open_paths(self, is_open: np.ndarray):
        """(key, words, loads) of paths that cover the open nodes, the load of each node once."""
        inner = np.zeros(len(is_open), bool)
        inner[self.parent[is_open & (self.parent >= 0)]] = True
        told = set()
        for end in np.flatnonzero(is_open & ~inner).tolist():
            path = [end]
            while self.parent[path[-1]] >= 0:
                path.append(int(self.parent[path[-1]]))
            path.reverse()
            loads = []
            for i in path:
                loads += [0, NONE, 0, 0, 0] if i in told else self.load[i].tolist()
            told.update(path)
            yield self.keys[self.row_of[end]][: len(path) * DIGEST], self.words[path[1:]].tolist(), loads


def segment_end(top: bytes, path: bytes) -> bytes:
    """The name of the node at a full segment's end, from the name of its top and the SHA-256 of its turns."""
    return hashlib.sha256(b"segment" + top + path).digest()[:DIGEST]


def _shard(level: int, segment: int, cap: int, first: bool, final: bool):
    """Turns a partition of sorted paths into rows of SAID."""
    names = [x.split()[0] for x in SAID.split(", ")]
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def rows(t: ShardTrie, part: int):
        is_open = np.zeros(len(t.depth), bool) if final else t.open_nodes(cap)
        t.fold(is_open)
        for i in np.flatnonzero(~is_open).tolist():
            pos, up = int(t.depth[i]), int(t.parent[i])
            total = (int(t.n_convs[i]), int(t.smallest[i]), int(t.n_children[i]), int(t.n_leaves[i]), int(t.saved[i]))
            if level and pos == 0:
                yield ("top", t.digest[i], None, None, total[1], *[None] * 8, None, list(total))
                continue
            sha = hashlib.sha256(",".join(map(str, t.ends.get(i, ()))).encode()).hexdigest() if first else None
            known = up >= 0 and not is_open[up] and (pos > 1 or not level)
            yield ("node", t.digest[i], t.digest[up] if up >= 0 else None, not first or pos == segment, total[1], int(t.smallest[up]) if known else None, level * segment + pos, total[0], total[2], total[3], total[4], sha, *[None] * 3)
        for i, ids in t.ends.items():
            if is_open[i]:
                yield ("ends", t.digest[i], *[None] * 9, ",".join(map(str, ids)), ids[0], None, None)
        if not final:
            for key, words, loads in t.open_paths(is_open):
                yield ("path", key, *[None] * 10, part, words, loads)

    def run(stream):
        keys, words, loads, ends = [], [], [], []
        for batch in stream:
            got = batch.to_pydict()
            keys += got["key"]
            words += got["words"]
            loads += got["load"]
            ends += [i if e else None for i, e in zip(got["id"], got["end"], strict=True)]
        if not keys:
            return
        out = []
        for row in rows(ShardTrie(keys, words, loads, ends, segment), TaskContext.get().partitionId()):
            out.append(row)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def trie_level(paths: DataFrame, level: int, segment: int, shard_nodes: int) -> list[DataFrame]:
    """What the rounds over one level's ``paths`` (key, words, load, id, end) say, one frame a round.

    A round sorts paths into shards of about ``shard_nodes`` nodes by their first ``cap`` bytes and id, so copies of one path
    spread over shards too. A shard finishes all nodes but those that its neighbours may hold; the paths to these,
    two a shard, are the next round's. The last round is one shard.
    """
    out, first, cap = [], True, 512
    wide = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        nodes = paths.agg(F.sum(F.size("words") + 1).alias("n")).first()["n"] or 0
        shards = max(-(-nodes // shard_nodes), min(wide, nodes // 2_000) if first else 1, 1)
        # one shard only when all that is left fits: no key, so that nothing deals it out again
        dealt = paths.repartition(1) if shards == 1 else paths.repartitionByRange(shards, F.substring("key", 1, cap), "id")
        said = cut(dealt.sortWithinPartitions("key", "id").mapInArrow(_shard(level, segment, cap, first, shards == 1), SAID))
        out.append(said.where("kind <> 'path'"))
        if shards == 1:
            return out
        paths = said.where("kind = 'path'").select("key", "words", "load", "id", F.lit(False).alias("end"))
        first, cap = False, 4 * cap


def placed_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, d, words) with idx, its place in the conversation from 0, and total, the conversation's turns.

    Turns are dealt by range and numbered inside their part; counts of the parts before are added, so a conversation of any
    length is spread over tasks.
    """
    dealt = cut(turns.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "d").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy("conv_id")
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("_n").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    inside = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "d"))
    return dealt.withColumn("_at", inside).join(parts, ["conv_id", "part"]).select("conv_id", "d", "words", (F.col("_before") + F.col("_at") - 1).alias("idx"), "total")


def shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, at, d, words, n_turns): each conversation c as the first h turns of conversation c - c % ``group``, then its own beyond its first h.

    h is the CRC-32 of c in decimals modulo ``most``. A conversation left without turns has one row with a null ``at``.
    """
    placed = placed_turns(turns)
    heads = placed.where((F.col("conv_id") % group == 0) & (F.col("idx") < most - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("idx", "d", "words"))).alias("head"))
    # one row a conversation: its first turn's
    convs = placed.where("idx = 0").select("conv_id", "total", (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")).join(heads, "base", "left")
    convs = convs.withColumn("head", F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast("array<struct<idx:bigint,d:string,words:bigint>>")))
    convs = cut(convs.withColumn("n_turns", F.size("head") + F.greatest(F.col("total") - F.col("h"), F.lit(0))))
    first = convs.select("conv_id", F.posexplode_outer("head").alias("at", "x"), "n_turns", "total", "h").where("x is not null or n_turns = 0")
    first = first.select("conv_id", F.col("at").cast("long").alias("at"), "x.d", "x.words", "n_turns")
    own = spread_join(placed.where(F.col("idx") >= F.crc32(F.col("conv_id").cast("string")) % most).drop("total"), convs.select("conv_id", "h", F.size("head").alias("n_head"), "n_turns"), "conv_id", "idx", 4)
    return own.select("conv_id", (F.col("idx") - F.col("h") + F.col("n_head")).alias("at"), "d", "words", "n_turns").unionByName(first)


def segments(rebuilt: DataFrame, segment: int) -> DataFrame:
    """(conv_id, seg, top, path, words, n_turns): conversations cut into pieces of ``segment`` turns, each with the name of the node it starts at."""
    got = rebuilt.groupBy("conv_id", F.coalesce(F.floor(F.col("at") / segment), F.lit(0)).alias("seg")).agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "d", "words")))).alias("x"), F.max("n_turns").alias("n_turns"))
    got = cut(got.select("conv_id", "seg", F.unhex(F.array_join("x.d", "")).alias("path"), F.col("x.words").alias("words"), "n_turns"))
    start = F.lit(bytes(DIGEST))

    def tops(stream):
        conv, top = None, b""
        for batch in stream:
            rows = []
            for c, seg, sha in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if c != conv:
                    conv, top = c, bytes(DIGEST)
                rows.append((c, seg, top))
                top = segment_end(top, bytes.fromhex(sha))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["conv_id", "seg", "top"])

    # a row for each ``segment`` turns of the long conversations, read in order and never held together
    names = got.where(F.col("n_turns") > segment).select("conv_id", "seg", F.sha2("path", 256)).repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(tops, "conv_id long, seg long, top binary")
    return got.where(F.col("n_turns") <= segment).withColumn("top", start).unionByName(got.where(F.col("n_turns") > segment).join(names, ["conv_id", "seg"]))


def turn_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = 4096, shard_nodes: int = 200_000, small: int = 100_000) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the conversations' prefix trie.

    Turns are ordered by number, null first, then by role and text digest; null role or text is empty; repeated rows are
    turns of their own. Conversations are rebuilt by :func:`shared_heads` first. Rows with a null conversation take no part,
    an empty table has no nodes. Other columns play no part. Ids are integers.

    Turns are told apart by 128 bits of SHA-256 and travel as these alone. Conversations of over ``segment`` turns are cut;
    a segment starts at the node where the one before ends, the deepest segments are done first and hand their tops'
    figures up. A node's ends are hashed as a stream in order of ids, so none of its lists is held in memory.
    Open nodes that are looked up as parents are sent to all tasks up to ``small`` rows, joined in parts beyond.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("d"), words_in(text).alias("words"))
    segs = cut(segments(shared_heads(turns), segment))
    deepest = segs.agg(F.max("seg").alias("m")).first()["m"]
    key = F.concat("top", "path")
    said: list[DataFrame] = []
    tops = None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = segs.where(F.col("seg") == level)
        ended = here.where(F.col("n_turns") <= (level + 1) * segment).select(key.alias("key"), "words", F.array(F.lit(1), F.col("conv_id"), F.lit(0), F.lit(0), F.lit(0)).cast("array<long>").alias("load"), F.col("conv_id").alias("id"), F.lit(True).alias("end"))
        if tops is not None:
            lifted = here.join(tops.select("conv_id", F.col("load").alias("load")), "conv_id").select(key.alias("key"), "words", "load", F.col("conv_id").alias("id"), F.lit(False).alias("end"))
            ended = ended.unionByName(lifted)
        rounds = trie_level(ended, level, segment, shard_nodes)
        said += rounds
        tops = None
        for r in rounds if level else []:
            tops = r.where("kind = 'top'") if tops is None else tops.unionByName(r.where("kind = 'top'"))
    if not said:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    every = said[0]
    for r in said[1:]:
        every = every.unionByName(r)
    nodes, ends = every.where("kind = 'node'"), every.where("kind = 'ends'")

    def hashed(stream):
        now, sha = None, None
        for batch in stream:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == now:
                    sha.update(b"," + ids.encode())
                else:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], names=["key", "sha"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "sha"])

    shas = ends.select("key", "text", "id").repartition("key").sortWithinPartitions("key", "id").select("key", "text").mapInArrow(hashed, "key binary, sha string")
    refs = nodes.where("ref").select(F.col("key").alias("parent"), F.col("conv_id").alias("_up"))
    own = nodes.select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "text")
    waits = F.col("parent").isNotNull() & F.col("parent_conv_id").isNull()
    waiting = own.where(waits)
    waiting = waiting.join(F.broadcast(refs), "parent") if refs.limit(small + 1).count() <= small else spread_join(waiting, refs, "parent", "key", 64)
    out = own.where(~waits).unionByName(waiting.withColumn("parent_conv_id", F.col("_up")).drop("_up"))
    late = out.where("text is null").join(shas, "key", "left").withColumn("text", F.coalesce("sha", F.lit(NO_ENDS))).drop("sha")
    return out.where("text is not null").unionByName(late).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("text").alias("ends_sha256"))


#: crc32 by bits: eight shifts a byte, each taking the polynomial in where the lowest bit is set.
TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS idx
  FROM {conversations} WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS total, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id),
h AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda z: 0::UBIGINT)), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 4 AS h
  FROM c),
r AS (
  SELECT h.conv_id, b.idx, b.role, b.text FROM h JOIN t b ON b.conv_id = h.base AND b.idx < h.h
  UNION ALL SELECT h.conv_id, t.idx + 4, t.role, t.text FROM h JOIN t USING (conv_id) WHERE t.idx >= h.h),
p AS (
  SELECT h.conv_id, coalesce(x.path, []) AS path, coalesce(x.words, []) AS words
  FROM h LEFT JOIN (SELECT conv_id, list(length(role) || ':' || role || text ORDER BY idx) AS path, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY idx) AS words FROM r GROUP BY conv_id) x USING (conv_id)),
m AS (SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path, words FROM p),
n AS (
  SELECT depth, path[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words[depth]) AS words,
    list(conv_id ORDER BY conv_id) FILTER (WHERE len(path) = depth) AS ends
  FROM m GROUP BY depth, node),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.node[1:n.depth] = n.node) AS n_children FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.node = n.node[1:n.depth - 1]),
a AS (SELECT unnest(range(depth + 1)) AS up, node, n_children = 0 AS leaf, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * words END AS saved FROM k),
s AS (SELECT up AS depth, node[1:up] AS node, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY ALL)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(array_to_string(k.ends, ','), '')) AS ends_sha256
FROM k JOIN s USING (depth, node)
"""
