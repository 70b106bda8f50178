"""Ranked lexical search turned round: the items' inverted index goes to the tasks, documents stream through it."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A byte of a term stays (A-Z as a-z), any other becomes a space. All bytes of characters beyond ASCII belong to terms.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_TERM_BYTES = bytes(_LETTERS[b] if b < 0x80 else b for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order, repeats included; null has none."""
    return text.translate(_TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    """A term's weight in a corpus of ``n_docs`` documents with terms, of which ``df`` hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Index:
    """Inverted index of a block of items: for each term the items that hold it and how often.

    ``rows`` are (item number, term, repeats). Three arrays and a dictionary: 16 bytes a posting and the terms themselves.
    """

    def __init__(self, rows: list[tuple[int, bytes, int]]):
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.terms: dict[bytes, int] = {}
        starts = []
        for at, (_, term, _) in enumerate(rows):
            if term not in self.terms:
                self.terms[term] = len(starts)
                starts.append(at)
        self.starts = np.array([*starts, len(rows)], np.int64)
        self.items = np.array([r[0] for r in rows], np.int64)
        self.repeats = np.array([r[2] for r in rows], np.int64)

    def counts(self, said: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the index' terms among ``said``, and how often each occurs."""
        known = self.terms
        tf = Counter(map(known.get, said))
        tf.pop(None, None)
        return np.fromiter(tf.keys(), np.int64, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))

    def scores(self, which: np.ndarray, gains: np.ndarray, out: np.ndarray) -> None:
        """Adds each term's gain, times its repeats in the item, to the scores of the items that hold it."""
        sizes = self.starts[which + 1] - self.starts[which]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[which] - (ends - sizes), sizes)
        np.add.at(out, self.items[at], np.repeat(gains, sizes) * self.repeats[at])


class Heaps:
    """The ``k`` best documents seen for each of ``n`` items: highest score, then smallest id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.least = np.ones(n, np.int64)  # a document below it can't enter

    def offer(self, scores: np.ndarray, doc_id: int | None) -> None:
        entry = (doc_id is not None, -(doc_id or 0))
        for i in np.flatnonzero(scores >= self.least).tolist():
            heap, new = self.heaps[i], (int(scores[i]), *entry)
            if len(heap) < self.k:
                heapq.heappush(heap, new)
            else:
                heapq.heappushpop(heap, new)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def rows(self):
        """(item number, doc_id, score) of all that the heaps hold."""
        for i, heap in enumerate(self.heaps):
            for score, known, minus in heap:
                yield i, -minus if known else None, score


def _texts(batch: pa.RecordBatch, column: int):
    """The UTF-8 bytes of a string column, row by row, without decoding them."""
    for x in batch.column(column).cast(pa.large_binary()):
        yield x.as_py()


def corpus_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(term int, df long, n_docs long, n_terms long) in parts of one row a task and term; term -1 carries the other two.

    ``vocabulary`` is a broadcast :class:`Index`; ``docs`` has one string column.
    """
    def run(stream):
        known, df, n_docs, n_terms = vocabulary.value.terms, Counter(), 0, 0
        for batch in stream:
            for text in _texts(batch, 0):
                said = terms_of(text)
                n_docs += bool(said)
                n_terms += len(said)
                df.update(set(map(known.get, said)))
        df.pop(None, None)
        rows = [(-1, 0, n_docs, n_terms), *[(t, n, 0, 0) for t, n in df.items()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["term", "df", "n_docs", "n_terms"])

    return docs.mapInArrow(run, "term int, df long, n_docs long, n_terms long")


def best_documents(docs: DataFrame, index, weights, n_docs: int, n_terms: int, n_items: int, k: int) -> DataFrame:
    """(task long, item int, doc_id long, score long): each task's ``k`` best documents for each item. ``docs`` has id and text."""
    def run(stream):
        own, w = index.value, weights.value
        heaps, scores = Heaps(n_items, k), np.zeros(n_items, np.int64)
        for batch in stream:
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                said = terms_of(text)
                which, tf = own.counts(said)
                if not len(which):
                    continue
                m = 100 - 25 + 25 * len(said) * n_docs // n_terms
                scores[:] = 0
                own.scores(which, w[which] * (1_000_000_000 * tf // (1000 * tf + 12 * m)), scores)
                heaps.offer(scores, doc_id)
        found = list(heaps.rows())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item int, doc_id long, score long").withColumn("task", F.spark_partition_id().cast("long"))


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 20, block_postings: int = 1_000_000, fan_in: int = 256) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, all of them if fewer score above 0.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased, over whole
    texts. Equal scores rank by ascending id; rows with a null id rank last among equals, and rows that repeat an id rank
    each for themselves. Null and empty texts hold no term and never rank; rows of ``items`` with one id (null as well)
    are one item with all their terms; an item without terms has no rows. Empty tables give an empty result. Other
    columns play no part, whatever their names. Ids are integers.

    Items are dealt into blocks of about ``block_postings`` postings (16 bytes each and their terms), so that what
    is broadcast stays bounded however many items there are. Every block streams all documents twice: once for the document
    frequencies of its terms, once through the index. A task holds the index and ``k`` entries an item; tasks' heaps
    are merged ``fan_in`` tasks at a time first, so that the last merge doesn't grow with the number of tasks as a whole.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema[item_col].dataType.simpleString()

    def counted(stream):
        for batch in stream:
            for item, text in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                tf = Counter(terms_of(text))
                if tf:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(tf), batch.schema.field(0).type), pa.array(list(tf), pa.binary()), pa.array(list(tf.values()), pa.int64())], names=["item_id", "term", "tf"])

    postings = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string")).mapInArrow(counted, f"item_id {kind}, term binary, tf long")
    postings = postings.groupBy("item_id", "term").agg(F.sum("tf").alias("tf"))
    total = postings.count()
    blocks = max(1, -(-total // block_postings))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks if total else 0):
        rows = postings.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        ids = list(dict.fromkeys(r["item_id"] for r in rows))
        number = {x: i for i, x in enumerate(ids)}
        if not ids:
            continue
        own = Index([(number[r["item_id"]], bytes(r["term"]), r["tf"]) for r in rows])
        index = spark.sparkContext.broadcast(own)
        stats = corpus_counts(given.select("text"), index).groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).collect()
        n_docs, n_terms = next(((r["n"], r["l"]) for r in stats if r["term"] == -1), (0, 0))
        if not n_terms:
            continue
        df = np.zeros(len(own.terms), np.int64)
        for r in stats:
            if r["term"] >= 0:
                df[r["term"]] = r["df"]
        weights = spark.sparkContext.broadcast(np.array([weight(n_docs, int(x)) for x in df], np.int64))
        best = best_documents(given, index, weights, n_docs, n_terms, len(ids), k)
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        # two merges: what fan_in tasks found for an item, then what is left of those
        some = W.partitionBy("item", F.expr(f"task div {fan_in}")).orderBy(*order)
        best = best.withColumn("_nth", F.row_number().over(some)).where(F.col("_nth") <= k).drop("_nth")
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS said
  FROM {docs} WHERE text IS NOT NULL),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM {items} WHERE text IS NOT NULL),
qt AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(said))::BIGINT AS n_terms FROM d WHERE len(said) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(said) AS n, unnest(said) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
g AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))) AS gain FROM tf JOIN w USING (term), s),
scored AS (SELECT item_id, r, doc_id, sum(qtf * gain)::BIGINT AS score FROM g JOIN qt USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
