"""SimHash near-duplicates: fingerprints linked within a Hamming radius through BK-trees of shards."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import batches, cut, spread_join

SEED = 42


EXTRA = 3
"""64-bit words that a long fingerprint has beyond the first."""


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """Hashes of the ``width``-word shingles of ``text`` in order; a shorter text is one shingle, one without words has none."""
    said = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(said) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(said), SEED)] if said else []
    joined = memoryview(b" ".join(said))
    ends = np.cumsum(np.fromiter(map(len, said), np.int64, len(said)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(said) - width] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, width: int, words: int = 1) -> list[int]:
    """SimHash of ``text`` as ``words`` signed 64-bit integers; no words in the text: zeros.

    The first word is of the shingles' hashes, the others of these hashes mixed further.
    """
    return majority_bits(np.array(shingle_hashes(text, width), np.uint64), words).view(np.int64).tolist()


def majority_bits(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit numbers whose bits are set where over half of ``hashes`` have them; of no hashes zeros."""
    set_bits = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at : at + 16_384].astype(np.uint64)
        mixed = np.empty((len(part), words), ">u8")
        for k in range(words):
            mixed[:, k] = part
            part = (part ^ part >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            part = (part ^ part >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        # up to 255 rows of bits are added as bytes, eight to a number
        lanes = np.unpackbits(mixed.view(np.uint8), axis=1).view(np.uint64)
        set_bits += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > len(hashes)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, fp long, and e1.. for further ``words``) for every row: A-Z lower-cased, words split at ASCII white space, ``width``-word shingles."""
    names = ["fp", *[f"e{k}" for k in range(1, words)]]

    def run(stream):
        for batch in stream:
            texts = batch.column(1)
            for a, b in batches([None] * len(texts)):
                found = np.array([fingerprint(t.as_py(), width, words) for t in texts.slice(a, b - a)], np.int64).reshape(-1, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(found[:, k]) for k in range(words)]], names=["doc_id", *names])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


class BKTree:
    """Fingerprints in a tree whose children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.root = None

    def add_and_search(self, fp: int, item: int, radius: int) -> list[int]:
        """The items within ``radius`` of ``fp`` that are in the tree; then puts ``item`` in."""
        if self.root is None:
            self.root = (fp, item, {})
            return []
        found, todo = [], [self.root]
        while todo:
            value, own, children = todo.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                found.append(own)
            if children:
                todo += [child for k, child in children.items() if d - radius <= k <= d + radius]
        value, _, children = self.root
        while (d := (value ^ fp).bit_count()) in children:
            value, _, children = children[d]
        children[d] = (fp, item, {})
        return found


class LeafTree:
    """The same tree for large shards: nodes keyed by Hamming distance, with arrays of up to LEAF values as leaves.

    All members of the shard search it at once, and only the smallest label that they reach is kept. ``extra`` are
    further words of the fingerprints, of which at most ``most`` bits may differ.
    """

    LEAF = 512

    def __init__(self, fps: np.ndarray, extra: np.ndarray | None = None, most: int = 0):
        self.fps, self.extra, self.most = fps, extra, most
        self.root = self._build(np.arange(len(fps)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.LEAF:
            return at
        parent, rest = at[0], at[1:]
        d = np.bitwise_count(self.fps[rest] ^ self.fps[parent])
        return parent, {int(k): self._build(rest[d == k]) if k else rest[d == k] for k in np.unique(d)}

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the further words of pairs agree well enough."""
        if self.extra is None:
            return np.ones(len(a), bool)
        return np.bitwise_count(self.extra[a] ^ self.extra[b]).sum(axis=1) <= self.most

    def classes(self, radius: int) -> np.ndarray:
        """For each value the smallest position that it reaches over links within ``radius``."""
        label = np.arange(len(self.fps))
        while True:
            before = label.copy()
            todo = [(self.root, np.arange(len(self.fps)))]
            while todo:
                node, asking = todo.pop()
                if isinstance(node, tuple):
                    parent, children = node
                    d = np.bitwise_count(self.fps[asking] ^ self.fps[parent]).astype(np.int64)
                    near = asking[d <= radius]
                    near = near[self.close(near, np.full(len(near), parent))]
                    label[near] = np.minimum(label[near], label[parent])
                    label[parent] = min(label[parent], label[near].min(initial=label[parent]))
                    for k, child in children.items():
                        inside = asking[np.abs(d - k) <= radius]
                        if len(inside):
                            todo.append((child, inside))
                    continue
                for i in range(0, len(asking), 2048):
                    part = asking[i : i + 2048]
                    a, b = np.nonzero(np.bitwise_count(self.fps[part][:, None] ^ self.fps[node][None, :]) <= radius)
                    a, b = part[a], node[b]
                    ok = self.close(a, b)
                    np.minimum.at(label, a[ok], label[b[ok]])
                    np.minimum.at(label, b[ok], label[a[ok]])
            label = label[label]
            if (label == before).all():
                return label


def shard_links(stream, radius: int, most: int, large: int = 256):
    """Links within each shard of rows sorted by (tab, shard, piece): each node with the smallest of its shard that it reaches."""
    state = {"key": None, "rows": {}}

    def close():
        nodes = sorted(state["rows"])
        if len(nodes) < 2:
            return []
        words = np.array([state["rows"][n] for n in nodes], np.int64).view(np.uint64)
        fps, extra = words[:, 0], words[:, 1:] if words.shape[1] > 1 else None
        if len(nodes) > large:
            return [(nodes[i], nodes[j]) for i, j in enumerate(LeafTree(fps, extra, most).classes(radius)) if i != j]
        parent = list(range(len(nodes)))

        def top(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        tree, rest = BKTree(), None if extra is None else extra.tolist()
        for x, fp in enumerate(fps.tolist()):
            for y in tree.add_and_search(fp, x, radius):
                if rest is None or sum((p ^ q).bit_count() for p, q in zip(rest[x], rest[y], strict=True)) <= most:
                    parent[top(x)] = top(y)
        return [(nodes[x], nodes[top(x)]) for x in range(len(nodes)) if top(x) != x]

    def rows(links):
        pair = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

    out: list[tuple[int, int]] = []
    for batch in stream:
        tabs, shards, pieces, nodes, *words = [c.to_pylist() for c in batch.columns]
        for key, node, own in zip(zip(tabs, shards, pieces, strict=True), nodes, zip(*words, strict=True), strict=True):
            if key != state["key"]:
                out += close()
                state["key"], state["rows"] = key, {}
            state["rows"][node] = own
        if len(out) > 50_000:
            yield rows(out)
            out = []
    out += close()
    if out:
        yield rows(out)


def block_masks(blocks: int, bits: int = 64) -> list[int]:
    """``blocks`` disjoint bit masks that cover ``bits`` bits."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def meeting(radius: int, bits: int) -> float:
    """Chance that two fingerprints ``radius`` bits apart agree in ``bits`` random ones of 64."""
    return math.comb(64 - radius, bits) / math.comb(64, bits)


def shard_masks(radius: int, size: int, tables: int = 48, seed: int = 17, miss: float = 0.01) -> list[int]:
    """Bits that make the shard keys of each table.

    Up to radius 4 the 64 bits are cut into radius + 2 blocks, of which two near fingerprints share two at least: a
    table for each pair of blocks misses no link. Beyond that so many blocks would be a few bits each, so tables take as
    many random bits as tell ``size`` fingerprints apart: ``tables`` of them, and as many more as it takes for a link at the
    radius to be missed with probability ``miss`` at most, whatever the size.
    """
    if radius <= 4:
        return [a | b for a, b in combinations(block_masks(radius + 2), 2)]
    bits = min(40, max(10, size.bit_length()), 64 - radius)
    tables = max(tables, math.ceil(math.log(miss) / math.log1p(-meeting(radius, bits))))
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(tables)]


def links(distinct: DataFrame, radius: int = 2, heavy: int = 2048, most: int = 0) -> DataFrame:
    """(u, v) links of distinct fingerprints (node, fp, e1..) that join the same classes as all pairs within ``radius`` bits.

    With further words, a link needs at most ``most`` differing bits in these too. Near fingerprints meet in a shard of
    :func:`shard_masks`, and each shard is searched through its own BK-tree in the task that holds it: the trees together
    grow with the corpus, so none of them is broadcast. Shards of over ``heavy`` fingerprints are cut again by the bits
    that their key leaves free, into radius + 1 pieces of which two near fingerprints share one.
    """
    names = [c for c in distinct.columns if c == "fp" or c[0] == "e"]
    pairs = shard_masks(radius, distinct.count())
    masks = F.array(*[F.lit(signed(m)) for m in pairs])
    keys = F.transform(masks, lambda m, i: F.struct(i.alias("tab"), F.col("fp").bitwiseAND(m).alias("shard")))
    shards = distinct.select("node", *names, F.explode(keys).alias("k")).select("k.tab", "k.shard", "node", *names)
    sizes = shards.groupBy("tab", "shard").count().where("count > 1")
    shards = shards.join(sizes, ["tab", "shard"])

    def pieces(mask: int):
        free = [i for i in range(64) if not mask >> i & 1]
        cuts = [free[len(free) * i // (radius + 1) : len(free) * (i + 1) // (radius + 1)] for i in range(radius + 1)]
        return F.array(*[F.lit(signed(sum(1 << i for i in c))) for c in cuts])

    split = F.transform(F.get(F.array(*[pieces(m) for m in pairs]), F.col("tab")), lambda m, j: F.concat_ws(":", j, F.col("fp").bitwiseAND(m)))
    shards = shards.withColumn("piece", F.explode(F.when(F.col("count") > heavy, split).otherwise(F.array(F.lit("")))))
    shards = shards.select("tab", "shard", "piece", "node", *names).repartition("tab", "shard", "piece").sortWithinPartitions("tab", "shard", "piece")
    return shards.mapInArrow(lambda stream: shard_links(stream, radius, most), "u long, v long")


def components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node that it reaches.

    Large-star and small-star rounds in turn: every node hangs its larger (then its smaller) neighbours on the
    smallest one, until no link changes. Minima are pre-aggregated, so a hub's links never meet in one task.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = cut(edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        now = cut(star(star(now, True), False))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, extra_bits: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most ``radius`` differing bits, the row's own included.
    With ``extra_bits`` a link also needs at most so many differing bits in 192 further ones, which rules out the chance
    links that a wide radius brings among many fingerprints. Null and empty texts have fingerprint zero and link like
    any other. A null id is never a component's id unless all its ids are null. An empty table gives an empty result.
    """
    words = 1 if extra_bits is None else 1 + EXTRA
    names = ["fp", *[f"e{k}" for k in range(1, words)]]
    rows = fingerprints(docs, id_col, text_col, width, words)
    rows = cut(rows.withColumn("node", F.col("fp") if words == 1 else F.xxhash64(*names)))
    distinct = cut(rows.groupBy("node", *names).agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("node", *names), radius, most=extra_bits or 0)).withColumnRenamed("node", "linked")
    named = distinct.join(roots, F.col("node") == F.col("linked"), "left")
    # fingerprints without a link are their own component; only linked ones meet, and those of one component in many tasks
    linked = named.where(F.col("root").isNotNull())
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = spread_join(linked, least, "root", "node").select(F.col("node").alias("_node"), "component_id")
    by_node = by_node.unionByName(named.where(F.col("root").isNull()).select(F.col("node").alias("_node"), F.col("first").alias("component_id")))
    return rows.join(by_node, F.col("node") == F.col("_node")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
