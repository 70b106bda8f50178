"""Language identification: averaged hashed subword embeddings and a linear softmax, trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.llm.common import WordTable, batches, held_out, ngram_hashes

SIZES, BUCKETS, DIM = (2, 3, 4), 1 << 15, 12


class LanguageModel:
    """Embedding table and softmax, folded into one score row for each subword bucket."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float):
        self.langs, self.table, self.bias, self.temperature, self.reject_below = langs, table, bias, temperature, reject_below

    def words(self) -> WordTable:
        """Word rows: sums of the score rows of a word's subwords, and their number."""
        if not hasattr(self, "_words"):
            self._words = WordTable(lambda new: word_rows(new, self.table))
        return self._words

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_words"}

    def probabilities(self, texts: list) -> np.ndarray:
        out = np.empty((len(texts), len(self.langs)))
        for a, b in batches(texts):
            words = [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in texts[a:b]]
            ids = self.words().number([w for ws in words for w in ws])
            owner = np.repeat(np.arange(b - a), [len(ws) for ws in words])
            sums = np.stack([np.bincount(owner, self.words().rows[ids, k], b - a) for k in range(len(self.langs) + 1)], axis=1) if len(ids) else np.zeros((b - a, len(self.langs) + 1))
            z = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out[a:b] = e / e.sum(axis=1, keepdims=True)
        return out


def word_rows(words: list[bytes], table: np.ndarray) -> np.ndarray:
    hashes, owner = ngram_hashes(words, SIZES, len(table))
    cols = [np.bincount(owner, table[hashes, k], len(words)) for k in range(table.shape[1])]
    return np.stack([*cols, np.bincount(owner, minlength=len(words))], axis=1)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def train(texts: list[str], langs: list[str], fold: np.ndarray, epochs: int = 5, rate: float = 0.5, precision: float = 0.99) -> LanguageModel:
    """Stochastic gradient descent over pieces of the texts; the last fold sets temperature and rejection threshold."""
    names = sorted(set(langs))
    y_of = {k: i for i, k in enumerate(names)}
    rng = np.random.default_rng(7)
    docs, y, part = [], [], []
    for t, k, f in zip(texts, langs, fold, strict=True):
        ws = t.lower().encode("utf-8", "surrogatepass").split()
        for a in range(0, len(ws), 64):  # pieces of unlike length teach short texts too
            piece = ws[a : a + int(rng.integers(2, 65))]
            docs.append(ngram_hashes(piece, SIZES, BUCKETS)[0])
            y.append(y_of[k])
            part.append(f)
    y, part = np.array(y), np.array(part)
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    learn, tune = np.flatnonzero(part > 0), np.flatnonzero(part == 0)
    if not len(learn) or not len(tune):
        learn = tune = np.arange(len(docs))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            h = docs[i]
            mean = table[h].mean(axis=0)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            np.subtract.at(table, h, step * (out @ p) / len(h) * min(len(h), 20))
            out -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
    z = np.array([table[docs[i]].mean(axis=0) @ out + bias for i in tune])

    def soft(t):
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    temperature = min(np.geomspace(0.25, 8, 40), key=lambda t: -np.log(soft(t)[np.arange(len(tune)), y[tune]] + 1e-12).mean())
    p = soft(temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y[tune]
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    reject = float(top[order[np.flatnonzero(good).max()]]) if good.any() else 1.0
    return LanguageModel(names, table @ out, bias, float(temperature), reject)


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 300, most_langs: int = 200, most_chars: int = 20_000) -> LanguageModel:
    """Fits on at most ``rows`` documents of each language outside the held-out fifth, by a hash of their ids.

    Rows with a null id, text or language, without a letter, or of over ``most_chars`` characters do not train, so the
    driver never holds more than most_langs * rows * most_chars. At most ``most_langs`` languages, the most frequent
    ones, are learned. If nothing is left to learn from, the model knows no language and :func:`identify` says `und`.
    """
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"), F.col(lang_col).cast("string").alias("_l"))
    usable = usable.where(F.col("_id").isNotNull() & F.col("_l").isNotNull() & (F.length("_t") <= most_chars) & ~held_out(F.col("_id")))
    usable = usable.where(F.col("_t").rlike(r"\p{L}"))
    counts = usable.groupBy("_l").count().orderBy(F.desc("count"), "_l").limit(most_langs).collect()
    # a hash threshold for each language leaves a little more than is asked for; the rank then makes the bound exact
    slot = F.pmod(F.xxhash64("_id"), F.lit(1_000_000))
    keep = F.lit(False)
    for r in counts:
        keep = keep | ((F.col("_l") == r["_l"]) & (slot < int(min(1_000_000, 1_100_000 * rows / r["count"] + 1))))
    nth = F.row_number().over(W.partitionBy("_l").orderBy(F.xxhash64("_id"), "_id", "_t"))
    picked = usable.where(keep).withColumn("_fold", F.crc32(F.concat(F.lit("fold"), F.col("_id").cast("string"))) % 4).withColumn("_n", nth)
    got = [r for r in picked.where(F.col("_n") <= rows).orderBy(F.xxhash64("_id"), "_id", "_t").collect() if has_letter(r["_t"])]
    if not got:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    return train([r["_t"] for r in got], [r["_l"] for r in got], np.array([r["_fold"] for r in got]))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    lang_pred is the likeliest language and score its calibrated probability; `und` and 0 where the text is null or has no
    letter, and everywhere if the model knows no language. ``rejected`` marks predictions under the calibrated threshold, and
    all `und`. The whole text counts. Repeated rows are judged alike; an empty table gives an empty result.
    """

    def run(stream):
        for batch in stream:
            texts = batch.column(1).to_pylist()
            p = model.probabilities(texts) if model.langs else np.zeros((len(texts), 1))
            best, top = p.argmax(axis=1), p.max(axis=1)
            letters = [bool(model.langs) and has_letter(t) for t in texts]
            lang = [model.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
            score = np.where(letters, top, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array((score < model.reject_below) | ~np.array(letters, bool), pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
