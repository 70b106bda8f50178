"""Near copies by SimHash: BK-trees of shards give candidate pairs, an exact check of their shingle sets decides them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import batches, cut, spread_join
from sessionlens.llm.simhash import LeafTree, components, majority_bits, shingle_hashes

#: Words of 64 bits of a fingerprint, and those of them that the trees compare.
WORDS, IN_TREE = 8, 4
#: Share of bits in which the fingerprints of two sets differ whose resemblance is 0.8: the angle of their indicators over pi.
DIFFERING = math.acos(2 * 0.8 / 1.8) / math.pi
#: Bits in which near copies may differ: of the first word, of the other words in the trees, of all words. 5 to 6 standard
#: deviations above the mean at 0.8, and 4 above it for the sets of five and four shingles that differ most (0.1875). Texts
#: that share no shingle pass the first two with a chance of about 2e-10, so that hardly any meet in the shards of a large corpus.
FIRST, NEXT, WHOLE = 24, 56, 132
#: A pair at 0.8 shares no shard with this probability at most, whatever the corpus' size.
MISS = 1e-4


#: Bins of a fine sketch, and the odd number that deals shingles to them.
FINE_BITS, FINE_FACTOR = 13, np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fine_sketch(hashes: np.ndarray) -> np.ndarray:
    """Of each bin that holds a shingle, in order: the bin and 8 bits of the least shingle in it, as one number.

    Sets much smaller than the number of bins are told almost exactly, larger ones by 2 ** FINE_BITS samples.
    """
    dealt = np.sort(hashes * FINE_FACTOR)
    bins = dealt >> np.uint64(64 - FINE_BITS)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    return (bins[first] << np.uint64(8) | dealt[first] & np.uint64(0xFF)).astype("<u4")


class FineSketches:
    """Fine sketches of a band's members, compared one with many."""

    def __init__(self, sketches: list[bytes]):
        entries = np.frombuffer(b"".join(sketches), "<u4")
        self.sizes = np.array([len(x) // 4 for x in sketches], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bins, self.values = (entries >> 8).astype(np.int64), (entries & 0xFF).astype(np.int64)
        self.dense = np.full(2**FINE_BITS, -1, np.int64)

    def alike(self, one: int, others: np.ndarray, least: float) -> np.ndarray:
        """Which of ``others`` may reach ``least`` with ``one``: five standard deviations, and two shingles that met others in their bins, are let pass.

        The number of bins that agree varies as a sample's does where bins are full, and hardly where they are not, in
        proportion to how full they are.
        """
        own = slice(self.starts[one], self.starts[one] + self.sizes[one])
        self.dense[self.bins[own]] = self.values[own]
        sizes = self.sizes[others]
        owner = np.repeat(np.arange(len(others)), sizes)
        at = np.arange(len(owner)) + np.repeat(self.starts[others] - (np.cumsum(sizes) - sizes), sizes)
        there = self.dense[self.bins[at]]
        same = np.bincount(owner, weights=there == self.values[at], minlength=len(others))
        both = np.bincount(owner, weights=there >= 0, minlength=len(others))
        self.dense[self.bins[own]] = -1
        filled = self.sizes[one] + sizes - both
        slack = 5 * np.sqrt(least * (1 - least) * filled * np.minimum(1, filled / 2**FINE_BITS)) + 2
        return same >= least * filled - slack


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(node, sketch) of rows of (node, text): the SimHash fingerprint of the text's set of shingles, WORDS words of 64 bits."""

    def run(stream):
        for batch in stream:
            texts = batch.column(1)
            for a, b in batches([None] * len(texts)):
                sketches = [majority_bits(shingle_set(t.as_py(), width), WORDS).astype("<u8").tobytes() for t in texts.slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sketches, pa.binary())], names=["node", "sketch"])

    return docs.select("node", "text").mapInArrow(run, "node long, sketch binary")


def words_of(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), "<u8").reshape(-1, WORDS)


def alike(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether fingerprints may be of near copies; true for no pair that the trees don't link where it shares a shard."""
    differ = np.bitwise_count(one ^ others)
    return (differ[..., 0] <= FIRST) & (differ[..., 1:IN_TREE].sum(axis=-1) <= NEXT) & (differ.sum(axis=-1) <= WHOLE)


def missed(bits: int, tables: int) -> float:
    """Chance that two fingerprints of sets at 0.8 agree in none of ``tables`` draws of ``bits`` bits."""
    n = 64 * WORDS
    log_choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    total = 0.0
    for d in range(n - bits + 1):
        met = math.exp(log_choose(n - d, bits) - log_choose(n, bits))
        total += math.exp(log_choose(n, d) + d * math.log(DIFFERING) + (n - d) * math.log1p(-DIFFERING)) * (1 - min(met, 1)) ** tables
    return total


def shard_bits(size: int, members: int = 1024, seed: int = 23) -> np.ndarray:
    """The bits that key each table's shards, one row a table, for ``size`` fingerprints and ``members`` to twice as many in a shard.

    The number of tables grows with the number of bits, so that a pair at 0.8 is missed no more often in a larger corpus.
    """
    bits = max(4, (size // members).bit_length() - 1)
    tables = next(t for t in range(1, 10_000) if missed(bits, t) <= MISS)
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(64 * WORDS, bits, replace=False) for _ in range(tables)])


def shard_keys(words: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """For each fingerprint its shard in every table; the table is part of the number."""
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)
    keys = np.empty((len(words), len(drawn)), np.int64)
    for t, at in enumerate(drawn):
        keys[:, t] = bits[:, at].astype(np.int64) @ (1 << np.arange(len(at))) + (t << 32)
    return keys


def shard_classes(signed: DataFrame, drawn: np.ndarray) -> DataFrame:
    """(band, key, node): the nodes that a BK-tree of table ``band``'s shards links, ``key`` being the smallest node they reach in it.

    Each shard is searched through its own tree in the task that holds it; nodes without a link there have no row.
    """
    def deal(stream):
        for batch in stream:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                words = words_of(part.column(1).to_pylist())
                own = np.repeat(words[:, :IN_TREE], len(drawn), axis=0).view(np.int64)
                nodes = np.repeat(part.column(0).to_numpy(), len(drawn))
                yield pa.RecordBatch.from_arrays([pa.array(shard_keys(words, drawn).ravel()), pa.array(nodes), *[pa.array(own[:, k]) for k in range(IN_TREE)]], names=["shard", "node", *names])

    def classes_of(shard):
        rows = np.concatenate(shard)
        rows = rows[np.argsort(rows[:, 1])]
        words = np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
        label = LeafTree(words[:, 0].copy(), words[:, 1:], NEXT).classes(FIRST)
        linked = np.isin(label, np.flatnonzero(np.bincount(label, minlength=len(label)) > 1))
        return rows[linked, 0] >> 32, rows[label[linked], 1], rows[linked, 1]

    def rows_of(out):
        band, key, node = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))
        return pa.RecordBatch.from_arrays([pa.array(band.astype(np.int32)), pa.array(key), pa.array(node)], names=["band", "key", "node"])

    def search(stream):
        held, out, size = [], [], 0
        for batch in stream:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
                if not len(part):
                    continue
                if held and held[0][0, 0] != part[0, 0]:
                    out.append(classes_of(held))
                    held, size = [], size + len(out[-1][0])
                held.append(part)
                if size > 50_000:
                    yield rows_of(out)
                    out, size = [], 0
        if held:
            out.append(classes_of(held))
        yield rows_of(out)

    names = [f"w{k}" for k in range(IN_TREE)]
    shards = signed.select("node", "sketch").mapInArrow(deal, "shard long, node long, " + ", ".join(f"{n} long" for n in names))
    return shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "band int, key long, node long")


def leader_pairs(shared: DataFrame) -> DataFrame:
    """Distinct (a, b): each node b of a band with the band's smallest node a, where their sketches agree enough."""
    first = shared.groupBy("band", "key").agg(F.min(F.struct("node", "sketch")).alias("first"))
    pairs = shared.join(first, ["band", "key"]).where("node <> first.node").select(F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.sketch").alias("x"), F.col("sketch").alias("y"))

    def run(stream):
        for batch in stream:
            if batch.num_rows:
                x, y = (words_of(batch.column(k).to_pylist()) for k in (2, 3))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(alike(x, y)))

    return pairs.mapInArrow(run, "a long, b long").distinct()


def open_bands(shared: DataFrame) -> DataFrame:
    """(band, key, root, node, sketch) of the bands that hold several roots."""
    mixed = shared.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return cut(shared.join(mixed.select("band", "key"), ["band", "key"], "left_semi").select("band", "key", "root", "node", "sketch"))


def open_pairs(rows: DataFrame, texts: DataFrame, drawn: np.ndarray, width: int, least: float) -> DataFrame:
    """(a, b), a < b, once each: all pairs of a band of :func:`open_bands` that are of different roots and that their sketches let pass.

    A large group of texts a little below ``least`` to each other has many such pairs. Fingerprints can't tell most of
    them from links; fine ones, made for the members of these bands only, can, so few go on to be decided by their texts.
    """
    def finer(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fine_sketch(shingle_set(t.as_py(), width)).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "fine"])

    fine = texts.select("node", "text").mapInArrow(finer, "node long, fine binary")
    rows = rows.join(fine, "node").select("band", "key", "root", "node", "sketch", "fine")

    def pairs_of(band, found):
        found.sort()
        root, node = np.array([r for r, *_ in found]), np.array([n for _, n, *_ in found])
        sketch = words_of([s for _, _, s, _ in found])
        fine = FineSketches([f for *_, f in found])
        lower = shard_keys(sketch, drawn[:band])
        # the members of the largest class are compared with the others only
        values, counts = np.unique(root, return_counts=True)
        for i in np.flatnonzero(root != values[counts.argmax()]).tolist():
            # a pair of two small classes is met at its smaller root; one with the largest class at its other member
            other = (root > root[i]) | (root == values[counts.argmax()])
            at = np.flatnonzero(other)
            at = at[alike(sketch[i], sketch[at])]
            at = at[~(lower[i] == lower[at]).any(axis=1)]  # a pair that shares a lower band is met there
            for j in at[fine.alike(i, at, least)].tolist():
                yield int(min(node[i], node[j])), int(max(node[i], node[j]))

    def batch_of(out):
        pair = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def run(stream):
        now, found, out = None, [], []
        for batch in stream:
            bands, keys, *rest = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(bands, keys, strict=True), zip(*rest, strict=True), strict=True):
                if key != now:
                    if len(found) > 1:
                        out += pairs_of(now[0], found)
                    now, found = key, []
                found.append(row)
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
        if len(found) > 1:
            out += pairs_of(now[0], found)
        yield batch_of(out)

    return rows.repartition("band", "key").sortWithinPartitions("band", "key").mapInArrow(run, "a long, b long")


def decided(pairs: DataFrame, docs: DataFrame, width: int, least: float, cell_pairs: int = 1000) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts' shingle sets agree to ``least``.

    Nodes are dealt to ``side`` lots by hash, and a pair belongs to the cell of its two nodes' lots. A cell gets the text
    of each of its nodes once and then its pairs, about ``cell_pairs`` of them at any input size, so a node of many pairs
    is spread over its row of cells and no text travels once a pair.
    """
    pairs = cut(pairs)
    side = max(1, math.ceil(math.sqrt(pairs.count() / cell_pairs)))
    lot = [F.pmod(F.xxhash64(F.lit(7), c), F.lit(side)).cast("int") for c in ("a", "b")]
    pairs = pairs.select(F.array(*lot).alias("cell"), "a", "b")
    needed = pairs.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    given = needed.join(docs.select("node", "text"), "node").select("cell", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = given.unionByName(pairs.select("cell", "a", "b", F.lit(None).cast("string").alias("text")))
    rows = rows.repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first(), "a")

    def run(stream):
        now, sets = None, {}
        for batch in stream:
            ok = []
            for cell, a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != now:
                    now, sets = cell, {}
                if b is None:
                    sets[a] = shingle_set(text, width)
                ok.append(b is not None and resemblance(sets[a], sets[b]) >= least)
            yield pa.RecordBatch.from_arrays(batch.columns[1:3], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, id_col: str, text_col: str, width: int, least: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, root, and the columns ``keep``) of every row: rows with one root are near copies of each other, see :func:`near_copies`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep).withColumn("node", F.xxhash64("text"))
    signed = cut(signatures(rows, width).dropDuplicates(["node"]))
    drawn = shard_bits(signed.count())
    shared = cut(shard_classes(signed, drawn).join(signed, "node").select("band", "key", "node", "sketch"))
    held = lambda nodes: rows.select("node", "text").join(nodes.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    texts = held(shared)
    links = cut(decided(leader_pairs(shared), texts, width, least))
    roots = components(links, "a", "b").select(F.col("node").alias("_node"), "root")
    shared = shared.join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node")
    bands = open_bands(shared)
    texts = cut(held(bands))  # of the members of open bands only, which are few, and read twice
    links = links.unionByName(cut(decided(open_pairs(bands, texts, drawn, width, least), texts, width, least)))
    roots = components(links, "a", "b").select(F.col("node").alias("_node"), "root")
    return rows.select("doc_id", "node", *keep).join(roots, F.col("node") == F.col("_node"), "left").select("doc_id", F.coalesce("root", "node").alias("root"), *keep)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id, the smallest id reachable over pairs whose shingle sets agree to ``least``.

    Fingerprints (SimHash of the set of shingles) that a BK-tree of a shard links are candidates; what it links is a band. First
    each is compared with the smallest of its band; then, in bands that still hold several classes, all pairs of different
    classes are. A link is never taken from fingerprints or sketches: the exact Jaccard index of the ``width``-word shingle sets decides it. Equal texts are one node; null and empty texts are alike. A
    null id is never a component's id unless all its ids are null. Rows that share an id are rows of their own; an empty
    table gives an empty result.
    """
    ids = cut(classes(docs, id_col, text_col, width, least))
    least_id = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return spread_join(ids, least_id, "root", "doc_id").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each class of :func:`near_copies` the one with the smallest id.

    A null id stays only in a class of null ids, and of rows with one id one stays. Rows are told apart by a key of their
    own and travel inside a struct, so neither repeated ids nor names of columns matter.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = cut(docs.select(whole, F.monotonically_increasing_id().alias("nth")))
    given = rows.select(F.col("row").getField(id_col).alias("doc_id"), F.col("row").getField(text_col).alias("text"), "nth")
    named = cut(classes(given, "doc_id", "text", width, least, ("nth",)))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("nth"))).alias("first"))
    return rows.join(first.select(F.col("first.nth").alias("nth")), "nth", "left_semi").select("row.*")
