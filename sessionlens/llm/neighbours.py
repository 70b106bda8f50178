"""Approximate nearest neighbours by a forest of sorted hash strings with longest-prefix search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.llm.common import cut

BITS = 48
"""Length of a hash string: far beyond what tells a shard's vectors apart, so prefixes end where the data say."""
POOL = 1024
"""Random hyperplanes; each tree takes BITS of them in an order of its own."""


class Planes:
    """Hash functions of ``trees`` trees over vectors of ``dim`` components."""

    def __init__(self, dim: int, trees: int, seed: int):
        rng = np.random.default_rng(seed)
        self.pool, self.trees = rng.normal(size=(POOL, dim)), trees
        self.picked = np.array([rng.permutation(POOL)[:BITS] for _ in range(trees)])

    def strings(self, x: np.ndarray) -> np.ndarray:
        """Hash strings of the rows of ``x`` for each tree, as integers whose leading bits are the string's start."""
        out = np.empty((len(x), self.trees), np.int64)
        for at in range(0, len(x), 512):
            side = x[at : at + 512] @ self.pool.T > 0
            bits = np.packbits(side[:, self.picked], axis=2)
            padded = np.zeros((*bits.shape[:2], 8), np.uint8)
            padded[:, :, 8 - bits.shape[2] :] = bits
            out[at : at + 512] = padded.view(">i8")[:, :, 0]
        return out


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows of ``x``, each times a power of two that brings its largest component near 1: exact, and safe to square."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class PrefixForest:
    """Sorted arrays of hash strings, one for each tree, over one shard of vectors.

    All trees lie in one array, the tree's number above its strings, so a prefix of any length is a range in it.
    """

    def __init__(self, vectors: np.ndarray, planes: Planes):
        self.planes, self.trees = planes, planes.trees
        keys = (planes.strings(vectors) + (np.arange(self.trees, dtype=np.int64) << BITS)).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows, self.size = keys[order], order // self.trees, len(vectors)

    def ranges(self, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the entries that share the first ``length`` bits with each string, by query and tree."""
        low = (strings >> (BITS - length) << (BITS - length)) + (np.arange(self.trees, dtype=np.int64) << BITS)
        return np.searchsorted(self.keys, low.ravel()).reshape(low.shape), np.searchsorted(self.keys, (low + (1 << (BITS - length))).ravel()).reshape(low.shape)

    def candidates(self, queries: np.ndarray, least: int, rows: int):
        """For each query the rows that share its longest prefixes: from whole strings all trees go up in step, a bit
        at a time, until their ranges hold ``least`` entries and ``rows`` different rows (or all there are); the last
        step's ranges are taken whole."""
        strings = self.planes.strings(queries)
        lo, hi = self.ranges(strings, BITS)
        level = np.full(len(queries), BITS)
        open_ = np.arange(len(queries))
        for length in range(BITS - 1, -1, -1):
            open_ = open_[(hi[open_] - lo[open_]).sum(axis=1) < least]
            if not len(open_):
                break
            lo[open_], hi[open_] = self.ranges(strings[open_], length)
            level[open_] = length
        for q in range(len(queries)):
            while True:
                seen = np.zeros(self.size, bool)
                for i, j in zip(lo[q].tolist(), hi[q].tolist(), strict=True):
                    seen[self.rows[i:j]] = True
                found = np.flatnonzero(seen)
                if len(found) >= min(rows, self.size) or not level[q]:
                    break
                level[q] -= 1
                low, high = self.ranges(strings[q : q + 1], int(level[q]))
                lo[q], hi[q] = low[0], high[0]
            yield found


def usable(vec: Column) -> Column:
    """True for vectors of finite numbers with a length above zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def nearest(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, trees: int = 160, effort: float = 0.6, shard_rows: int = 8192, query_block: int = 4096, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``, by cosine.

    Equal vectors are one entry of the index, so copies don't multiply candidates; each entry remembers its k + 1 smallest ids,
    which are all that a result can hold of it. The entries are dealt to shards of about ``shard_rows``, each with a forest of its own; queries
    visit every shard in blocks of ``query_block``. In a shard a query's candidates are what its longest-prefix matches
    hold when the trees together hold ``effort`` entries for each row of the shard; cosines are then exact in double precision,
    of vectors scaled by powers of two, so that components of any size can be squared.
    Ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do
    vectors of another length than the most frequent one; null ids take no part either, of repeated ids each row counts.
    An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull()).where(usable(F.col("v")))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = dims[0]["d"]
    rows = rows.where(F.size("v") == dim)
    # -0.0 and 0.0 are equal numbers, and so are the vectors that differ in them only
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h", F.xxhash64("v"))
    nth = W.partitionBy("h", "v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= k + 1)
    entries = cut(few.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.monotonically_increasing_id()))
    shards = max(1, -(-entries.count() // shard_rows))

    queries = rows.where(F.col("vec_id") % every == 0).select("h", "v").distinct().join(entries.select("h", "v", "entry"), ["h", "v"])
    queries = cut(queries.select(F.col("entry").alias("asking"), F.col("v").alias("asked")))
    blocks = max(1, -(-queries.count() // query_block))
    index = entries.select((F.pmod(F.xxhash64("entry"), F.lit(shards))).alias("shard"), "entry", "v", "ids").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("asking"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    hyper = Planes(dim, trees, seed)

    def search(shard: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(ask):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "entry": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "ids": pd.Series(dtype="object")})
        x, q = scaled(np.stack(shard["v"].to_numpy())), scaled(np.stack(ask["asked"].to_numpy()))
        entry, asking = shard["entry"].to_numpy(), ask["asking"].to_numpy()
        smallest = np.array([i[0] for i in shard["ids"]])
        xn, qn = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        forest = PrefixForest(x / xn[:, None], hyper)
        out = []
        for i, rows in enumerate(forest.candidates(q / qn[:, None], int(np.ceil(effort * len(x))) + trees, k + 1)):
            score = (x[rows] * q[i]).sum(axis=1) / (xn[rows] * qn[i])
            best = np.lexsort((smallest[rows], -score))[: k + 1]
            out += [(asking[i], entry[rows[j]], score[j], shard["ids"].iat[rows[j]]) for j in best]
        return pd.DataFrame(out, columns=["q", "entry", "score", "ids"])

    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, "q long, entry long, score double, ids array<long>")
    best = W.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("q", "score", "ids")
    # each query row of an entry asks for itself: its own id is no candidate
    named = rows.where(F.col("vec_id") % every == 0).select("h", "v", F.col("vec_id").alias("query_id")).join(entries.select("h", "v", F.col("entry").alias("q")), ["h", "v"]).select("query_id", "q")
    pairs = named.join(found, "q").withColumn("vec_id", F.explode("ids")).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
