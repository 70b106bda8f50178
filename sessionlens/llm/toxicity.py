"""Toxicity: a bidirectional gated recurrent network with attention over words and their characters, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import WordTable, batches, held_out, labelled_sample, ngram_hashes, prior_shift
from sessionlens.llm.quality import logistic, sigmoid

HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 4
WORD_BUCKETS, CHAR_BUCKETS = 1 << 16, 1 << 14
WINDOW, STRIDE = 32, 8


def split_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def bare(words: list[bytes]) -> list[bytes]:
    return [w.strip(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~") or w for w in words]


def word_buckets(words: list[bytes]) -> np.ndarray:
    h = [np.uint64(0)] if not words else ngram_whole(bare(words))
    return (np.asarray(h, np.uint64) % np.uint64(WORD_BUCKETS)).astype(np.int64)


def ngram_whole(words: list[bytes]) -> np.ndarray:
    """One hash for each whole word."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    at = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)
    mixed = (data + np.uint64(1)) * np.power(np.uint64(0x9E3779B97F4A7C15), (at + 1).astype(np.uint64))
    sums = np.add.reduceat(mixed, np.cumsum(lens) - lens)
    return (sums ^ sums >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and text of every window of WINDOW words at a stride of STRIDE; the last one ends with the text.

    A passage of up to WINDOW - STRIDE + 1 words lies whole in one of them.
    """
    starts, owner, at = [], [], 0
    for i, n in enumerate(lengths):
        own = list(range(0, max(1, n - WINDOW + 1), STRIDE))
        if n > WINDOW and own[-1] != n - WINDOW:
            own.append(n - WINDOW)
        starts += [at + s for s in own]
        owner += [i] * len(own)
        at += n
    return np.array(starts, np.int64), np.array(owner, np.int64)


class ToxicNet:
    """Parameters, forward pass and gradients. A word's input is its hashed vector and the mean of its character trigrams' vectors."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        make = lambda *s, by=0.3: rng.normal(0, by, s).astype(np.float32)
        self.p = {"word": make(WORD_BUCKETS, WORD_DIM, by=0.02), "char": make(CHAR_BUCKETS, CHAR_DIM, by=0.02), "att": make(2 * HIDDEN, HIDDEN), "pick": make(HIDDEN), "out": make(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"{side}x": make(d, 3 * HIDDEN), f"{side}h": make(HIDDEN, 3 * HIDDEN), f"{side}c": np.zeros(3 * HIDDEN, np.float32)}
        self.calibration = np.zeros(3)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        grams, owner = ngram_hashes(bare(words), (3,), CHAR_BUCKETS)
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        chars = np.stack([np.bincount(owner, self.p["char"][grams, k], len(words)) / n for k in range(CHAR_DIM)], axis=1)
        return np.concatenate([self.p["word"][word_buckets(words)], chars.astype(np.float32)], axis=1)

    def project(self, words: list[bytes]) -> np.ndarray:
        """What both directions add up from a word before the recurrence."""
        x = self.inputs(words)
        return np.concatenate([x @ self.p["fx"] + self.p["fc"], x @ self.p["bx"] + self.p["bc"]], axis=1)

    def run(self, rows: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: ``ids`` (windows x steps) into ``rows`` of :meth:`project`, ``mask`` true on real words."""
        n, steps = ids.shape
        hs = np.empty((steps, n, 2 * HIDDEN), np.float32)
        saved = {"f": [], "b": []}
        for k, side in enumerate("fb"):
            h, u = np.zeros((n, HIDDEN), np.float32), self.p[f"{side}h"]
            part = rows[:, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN]
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                a, r = part[ids[:, t]], h @ u
                gates = np.tanh(0.5 * (a[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])) * np.float32(0.5) + np.float32(0.5)
                z, g = gates[:, :HIDDEN], gates[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + g * r[:, 2 * HIDDEN :])
                new = h + z * (c - h)
                if keep:
                    saved[side].append((t, h, z, g, c, r))
                h = new
                hs[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        act = np.tanh(hs @ self.p["att"])
        e = np.where(mask.T, act @ self.p["pick"], np.float32(-1e4))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, hs)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (hs, act, w, pooled, saved)) if keep else logit

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Of the mean log loss: by parameter, and by input row of ``x``."""
        rows = np.concatenate([x @ self.p["fx"] + self.p["fc"], x @ self.p["bx"] + self.p["bc"]], axis=1)
        logit, (hs, act, w, pooled, saved) = self.run(rows, ids, mask, keep=True)
        p = sigmoid(logit)
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["out"]
        dhs = w[:, :, None] * dpool
        dw = np.einsum("tnh,nh->tn", hs, dpool)
        de = w * (dw - (w * dw).sum(axis=0))
        g["pick"] = np.einsum("tn,tnk->k", de, act)
        dact = de[:, :, None] * self.p["pick"] * (1 - act * act)
        g["att"] = np.einsum("tnh,tnk->hk", hs, dact)
        dhs = dhs + dact @ self.p["att"].T
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u = self.p[f"{side}h"]
            gu, gx, gc = np.zeros_like(u), np.zeros_like(self.p[f"{side}x"]), np.zeros(3 * HIDDEN, np.float32)
            carry = np.zeros((len(y), HIDDEN), np.float32)
            for t, h, z, r_gate, c, r in reversed(saved[side]):
                dh = dhs[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carry
                dz, dc = dh * (c - h) * z * (1 - z), dh * z * (1 - c * c)
                dr = dc * r[:, 2 * HIDDEN :] * r_gate * (1 - r_gate)
                da = np.concatenate([dz, dr, dc], axis=1)
                drec = np.concatenate([dz, dr, dc * r_gate], axis=1)
                gu += h.T @ drec
                gx += x[ids[:, t]].T @ da
                gc += da.sum(axis=0)
                np.add.at(dx, ids[:, t], da @ self.p[f"{side}x"].T)
                carry = dh * (1 - z) + drec @ u.T
            g |= {f"{side}h": gu, f"{side}x": gx, f"{side}c": gc}
        return g, dx, float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean())

    def table_gradients(self, words: list[bytes], dx: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Rows and their gradients of the word table and, through the mean in each word, of the trigram table."""
        grams, owner = ngram_hashes(bare(words), (3,), CHAR_BUCKETS)
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        out = {}
        for name, buckets, g in (("word", word_buckets(words), dx[:, :WORD_DIM]), ("char", grams, (dx[:, WORD_DIM:] / n[:, None])[owner])):
            rows, at = np.unique(buckets, return_inverse=True)
            total = np.zeros((len(rows), g.shape[1]))
            np.add.at(total, at, g)
            out[name] = rows, total
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_words"}

    def best_windows(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its largest window logit, that window's first word, and its number of windows."""
        if not hasattr(self, "_words"):
            self._words = WordTable(lambda new: self.project(new).astype(np.float32), 150_000)
        top, first, number = np.empty(len(texts)), np.zeros(len(texts), np.int64), np.ones(len(texts))
        for a, b in batches(texts, 1_000_000):
            words = [split_words(t) for t in texts[a:b]]
            lengths = np.array([len(w) for w in words], np.int64)
            starts, owner = windows(lengths)
            ids = self._words.number([w for ws in words for w in ws] or [b""])
            ends = np.cumsum(lengths)[owner]
            at = starts[:, None] + np.arange(WINDOW)
            mask = at < ends[:, None]
            spot = np.where(mask, at, 0).clip(0, max(0, len(ids) - 1))
            rows = np.concatenate([self._words.rows[: self._words.used], np.zeros((1, 6 * HIDDEN), np.float32)])
            ids = np.where(mask, ids[spot], len(rows) - 1)
            logit = np.concatenate([self.run(rows, ids[i : i + 4096], mask[i : i + 4096]) for i in range(0, len(ids), 4096)])
            order = np.lexsort((-logit, owner))
            lead = order[np.concatenate([[0], np.flatnonzero(np.diff(owner[order])) + 1])]
            top[a:b], number[a:b] = logit[lead], np.bincount(owner)
            first[a:b] = starts[lead] - (np.cumsum(lengths) - lengths)
        return top, first, number

    def scores(self, texts: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        top, _, number = self.best_windows(texts)
        return sigmoid(np.stack([top, np.log(number), np.ones(len(texts))], axis=1) @ self.calibration)


def log_odds(docs_words: list[set], y: np.ndarray, hash_of, size: int) -> np.ndarray:
    """Shrunk log odds of a bucket's presence in toxic against other texts."""
    pos, neg = np.zeros(size), np.zeros(size)
    for words, label in zip(docs_words, y, strict=True):
        if words:
            (pos if label else neg)[np.unique(hash_of(list(words)))] += 1
    n, m = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    s = 10.0
    return np.log((pos + s * n / (n + m)) / (n + s)) - np.log((neg + s * m / (n + m)) / (m + s))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = 3000, epochs: int = 8, batch: int = 64, rate: float = 0.02, least_steps: int = 250) -> ToxicNet:
    """Fits on at most ``rows`` labelled rows, half of each class, none held out; the last fold only calibrates.

    Labels are of whole texts, so each round trains on every text's most toxic window so far and on one other window of each clean text.
    Word and character vectors start from the label's log odds. Without both classes scores are a constant.
    """
    texts, y, fold = labelled_sample(docs, labels, label, rows, id_col, text_col)
    net = ToxicNet()
    learn, tune = np.flatnonzero(fold > 0), np.flatnonzero(fold == 0)
    if not all((y[part] == c).any() for part in (learn, tune) for c in (0, 1)):
        net.calibration = np.array([0.0, 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))])
        return net
    words = [split_words(t) for t in texts]
    sets = [set(words[i]) for i in learn]
    net.p["word"][:, 0] = log_odds(sets, y[learn], word_buckets, WORD_BUCKETS)
    net.p["char"][:, 0] = log_odds(sets, y[learn], lambda ws: ngram_hashes(bare(ws), (3,), CHAR_BUCKETS)[0], CHAR_BUCKETS)
    rng = np.random.default_rng(3)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items() if k not in ("word", "char")}
    past = {k: np.zeros(net.p[k].shape) for k in ("word", "char")}
    turn = 0
    epochs = max(epochs, -(-least_steps * batch // (len(learn) + int((y[learn] == 0).sum()))))  # small samples are read more often
    for epoch in range(epochs):
        if epoch == 0:  # before the network knows anything: the window with the largest log odds
            first = np.array([max(0, int(np.argmax(net.p["word"][word_buckets(words[i]), 0])) - WINDOW // 2) if words[i] else 0 for i in learn])
        else:
            net.__dict__.pop("_words", None)
            first = net.best_windows([texts[i] for i in learn])[1]
        examples = [(i, f, y[i]) for i, f in zip(learn, first, strict=True)]
        examples += [(i, int(rng.integers(0, max(1, len(words[i]) - WINDOW + 1))), 0) for i in learn if not y[i]]
        for order in np.array_split(rng.permutation(len(examples)), max(1, len(examples) // batch)):
            picked = [(words[examples[j][0]][examples[j][1] : examples[j][1] + WINDOW], examples[j][2]) for j in order]
            vocab = sorted({w for ws, _ in picked for w in ws}) or [b""]
            number = {w: k for k, w in enumerate(vocab)}
            x = np.concatenate([net.inputs(vocab), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
            ids = np.full((len(picked), WINDOW), len(vocab))
            for k, (ws, _) in enumerate(picked):
                ids[k, : len(ws)] = [number[w] for w in ws]
            mask = ids < len(vocab)
            mask[:, 0] = True
            target = np.array([t for _, t in picked], np.float32)
            g, dx, _ = net.gradients(x, ids, mask, target)
            turn += 1
            for k, (m1, m2) in moments.items():
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.001 * (g[k] ** 2 - m2)
                net.p[k] -= rate * (1 - epoch / epochs) * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.999**turn)) + 1e-7)
            for k, (at, step) in net.table_gradients(vocab, dx[:-1]).items():  # steps shrink with a row's own past gradients, so rare words learn too
                past[k][at] += step**2
                net.p[k][at] -= rate * (1 - epoch / epochs) * step / (np.sqrt(past[k][at]) + 1e-10)
    net.__dict__.pop("_words", None)
    top, _, number = net.best_windows([texts[i] for i in tune])
    net.calibration = logistic(np.stack([top, np.log(number), np.ones(len(tune))], axis=1), y[tune].astype(float))
    net.calibration[2] += prior_shift(labels, label, y, id_col)
    return net


def toxicity_scores(docs: DataFrame, model: ToxicNet, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher is likelier toxic), predicted, worst_word.

    All overlapping windows of the whole text, 32 words at a stride of 8, are scored and the highest counts; worst_word is where that window starts.
    Null and empty texts are one empty window. Repeated rows score alike; an empty table gives an empty result.
    """

    def run(stream):
        for batch in stream:
            texts = batch.column(1).to_pylist()
            if texts:
                top, first, number = model.best_windows(texts)
                score = sigmoid(np.stack([top, np.log(number), np.ones(len(texts))], axis=1) @ model.calibration)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(first, pa.int64())], names=["doc_id", "score", "worst_word"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, score double, worst_word long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_word")
