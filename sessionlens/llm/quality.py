"""Quality by compression: zstandard dictionaries of good and of bad text, the difference in size calibrated."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import held_out, labelled_sample, prior_shift

#: Short chunks, so that a text that repeats itself can't be its own dictionary.
CHUNK, LEVEL = 128, 1


def chunks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]


class CompressionClassifier:
    """Two dictionaries, and a logistic calibration of the difference of a whole text's sizes under them and its length."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights

    def compressors(self):
        """One compressor for each dictionary, kept for the life of the worker's copy of this object."""
        if not hasattr(self, "_made"):
            dicts = [zstandard.ZstdCompressionDict(d) for d in (self.good, self.bad)]
            for d in dicts:
                d.precompute_compress(level=LEVEL)
            self._made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in dicts]
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def features(self, text: str | None) -> np.ndarray:
        """Size under the bad dictionary less that under the good one, for a byte of text; log of the length; 1."""
        parts = chunks(text)
        if not parts:
            return np.array([0.0, 0.0, 1.0])
        good, bad = self.compressors()
        n = sum(map(len, parts))
        return np.array([sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts) / n, np.log1p(n), 1.0])

    def scores(self, texts: list) -> np.ndarray:
        return sigmoid(np.array([self.features(t) for t in texts]).reshape(-1, 3) @ self.weights)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-5) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the loss falls, so separable classes don't make it run away."""
    w, pull = np.zeros(x.shape[1]), ridge * len(x)

    def loss(v):
        z = x @ v
        return np.logaddexp(0, z).sum() - y @ z + pull / 2 * v @ v

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) + pull * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * (1 + now):
            break
    return w


def dictionary(texts: list[str], size: int) -> bytes:
    """Dictionary of ``size`` bytes with its entropy tables where zstandard can train one, else the texts themselves."""
    samples = [c for t in texts for c in chunks(t) if len(c) >= 32]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b"the of and to in"


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = 4000, dict_bytes: int = 112_640) -> CompressionClassifier:
    """Fits on at most ``rows`` labelled rows, half of each class, none of them held out.

    Three quarters of the sample make the dictionaries, the last quarter calibrates, as texts inside a dictionary
    compress too well to calibrate on. What is calibrated is the normalised difference of the two sizes, beside it only the
    length, on which its spread depends. Without both classes the score is 1/2 everywhere.
    """
    texts, y, fold = labelled_sample(docs, labels, label, rows, id_col, text_col)
    build = fold > 0
    if not all(((y == c) & part).any() for c in (0, 1) for part in (build, ~build)):
        return CompressionClassifier(b"the of and to in", b"| %%% ***", np.zeros(3))
    pick = lambda c: [t for t, k, b in zip(texts, y, build, strict=True) if b and k == c]
    made = CompressionClassifier(dictionary(pick(1), dict_bytes), dictionary(pick(0), dict_bytes), np.zeros(3))
    made.weights = logistic(np.array([made.features(t) for t, b in zip(texts, build, strict=True) if not b]), y[~build].astype(float))
    made.weights[-1] += prior_shift(labels, label, y, id_col)
    return made


def quality_scores(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher is better text), predicted.

    Whole texts count, in chunks of 128 bytes. Null and empty texts get the score of a difference and length of 0. Repeated rows are scored
    alike, an empty table gives an empty result.
    """

    def run(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: CompressionClassifier, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose whole text scores ``threshold`` or more, with all their columns, in one narrow pass."""
    at = docs.columns.index(text_col)

    def run(stream):
        for batch in stream:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
