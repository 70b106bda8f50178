"""What the training-data operators share: reading, held-out split, checkpoints, word tables."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the reliable checkpoint folder, so that a lost executor costs nothing.

    The cluster names the folder in spark.checkpoint.dir, which driver and executors share. Without that setting there
    is no folder that all can reach, so it must be set by SparkContext.setCheckpointDir; on a local master only, where
    all run in one process, one is made here.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes not to be one of ``columns``, whatever the letter case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def spread_join(rows: DataFrame, least: DataFrame, key: str, by: str, ways: int = 16) -> DataFrame:
    """``rows`` joined to ``least``, which has a row for each ``key``, with the rows of one key dealt over ``ways`` tasks by ``by``."""
    many = least.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return rows.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int")).join(many, [key, "_way"]).drop("_way")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 100_000):
    """At most ``rows`` labelled rows outside the held-out fifth, as (texts, 0/1 labels, fold) on the driver.

    The bound is on rows per class, taken by a hash of the id, so the sample is the same on every run.
    Rows with a null id, label or text do not train, nor do texts of over ``most_chars`` characters, so the driver never
    holds more than rows * most_chars.
    """
    lab = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    )
    ids = None
    for y in (0, 1):
        one = lab.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows // 2)
        ids = one if ids is None else ids.unionByName(one)
    got = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        .join(F.broadcast(ids), "_id").where(F.length("_t") <= most_chars).dropDuplicates(["_id"])
        .withColumn("_fold", F.crc32(F.concat(F.lit("fold"), F.col("_id").cast("string"))) % 4)
        .orderBy("_id").collect()
    )
    return [r["_t"] for r in got], np.array([r["_y"] for r in got], dtype=np.int64), np.array([r["_fold"] for r in got], dtype=np.int64)


def prior_shift(labels: DataFrame, label: str, y: np.ndarray, id_col: str = "doc_id") -> float:
    """What to add to the log odds of a model fitted on a sample with labels ``y``, so that they hold for all labelled rows."""
    n = {r["y"]: r["count"] for r in labels.where(F.col(label).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(label).cast("int").alias("y")).count().collect()}
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    if not (n.get(1) and n.get(0) and ones and zeros):
        return 0.0
    return float(np.log(n[1] / n[0]) - np.log(ones / zeros))


class WordTable:
    """Numbers words for vectorised work: each distinct word gets a row of ``features(words)``.

    The table is dropped when it passes ``most`` words, so its memory is bounded whatever the corpus.
    """

    def __init__(self, features, most: int = 400_000):
        self.features, self.most = features, most
        self.clear()

    def clear(self):
        self.ids: dict[bytes, int] = {}
        self.rows = None
        self.used = 0

    def number(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of ``words`` in :attr:`rows`."""
        if len(self.ids) > self.most:
            self.clear()
        ids = self.ids
        new = list({w for w in words if w not in ids})
        if new:
            for w in new:
                ids[w] = len(ids)
            made = self.features(new)
            if self.rows is None:
                self.rows = np.empty((max(1024, 2 * len(new)), *made.shape[1:]), made.dtype)
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[self.used : self.used + len(new)] = made
            self.used += len(new)
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def ngram_hashes(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in [0, buckets) of all byte n-grams of ``<word>``, and the word number of each."""
    marked = [b"<" + w + b">" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    ends = np.repeat(np.cumsum(lens), lens)
    owner = np.repeat(np.arange(len(marked)), lens)
    at = np.arange(len(data))
    hashes, owners = [], []
    for n in sizes:
        ok = at + n <= ends
        pos = at[ok]
        h = np.full(len(pos), n, np.uint64)
        for k in range(n):
            h = (h ^ data[pos + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        hashes.append((h % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[ok])
    return np.concatenate(hashes), np.concatenate(owners)


def batches(texts: list, most_chars: int = 2_000_000):
    """Slices of a list of texts that hold about ``most_chars`` characters each, whole texts only."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
