"""Secret scans: base patterns, and probabilistic automata inferred from labelled credentials by state merging."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import batches, cut

KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
TOKEN_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
#: Characters to symbols: digits, hexadecimal and other lower-case letters, upper-case ones; the rest as they are.
SYMBOLS = {ord(c): s for group, s in (("0123456789", "0"), ("abcdef", "a"), ("ghijklmnopqrstuvwxyz", "g"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")) for c in group}
LEAST, END = 12, "$"
ALPHABET = "0agA+/_.=-"
"""The symbols; their places are the codes of the vectorised scoring."""
CODES = np.zeros(128, np.int64)
for _c in map(chr, range(128)):
    if _c in TOKEN_SET:
        CODES[ord(_c)] = ALPHABET.index(_c.translate(SYMBOLS))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, leftmost and without overlap within a kind."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def credentials(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the credentials themselves in base matches: of an assignment only its value."""
    out = []
    for s, k, e in base:
        out.append((KINDS[k], ASSIGN.match(text, s).start(2) if k == 0 else s, e))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of all maximal runs of ``LEAST`` or more token characters."""
    return [m.span() for m in RUN.finditer(text)]


class Automaton:
    """A deterministic probabilistic automaton merged from the prefix tree of sample strings.

    States are merged when the frequencies of ending and of each next symbol, there and below, differ by less than
    the Hoeffding bound at ``alpha``. Unseen steps keep a small probability.
    """

    FLOOR = math.log(1e-4)

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for s in strings:
            q = 0
            for c in s:
                self.count[q][c] += 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                q = self.next[q][c]
            self.count[q][END] += 1
        self._merge()
        self.log = {}
        for q, n in enumerate(self.count):
            total = sum(n.values()) + 1
            self.log[q] = {c: math.log(k / total) for c, k in n.items()}

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = sum(self.count[p].values()), sum(self.count[q].values())
            if not n or not m:
                continue
            for c in self.count[p].keys() | self.count[q].keys():
                if abs(self.count[p][c] / n - self.count[q][c] / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            p, q = todo.pop()
            self.count[p].update(self.count[q])
            for c, child in self.next[q].items():
                if c in self.next[p]:
                    todo.append((self.next[p][c], child))
                else:
                    self.next[p][c] = child

    def _merge(self) -> None:
        kept, border = [0], [(0, c) for c in sorted(self.next[0])]
        while border:
            # the best supported state next, so that decisions rest on as many strings as can be
            border.sort(key=lambda e: (-sum(self.count[self.next[e[0]][e[1]]].values()), e))
            p, c = border.pop(0)
            q = self.next[p][c]
            for k in kept:
                if self._compatible(k, q):
                    self.next[p][c] = k
                    self._fold(k, q)
                    break
            else:
                kept.append(q)
            border = [(k, s) for k in kept for s in sorted(self.next[k]) if self.next[k][s] not in kept]

    def score(self, symbols: str) -> float:
        """Log probability of a string of symbols, its end included."""
        q, total = 0, 0.0
        for c in symbols:
            total += self.log[q].get(c, self.FLOOR) if q is not None else self.FLOOR
            q = self.next[q].get(c) if q is not None else None
        return total + (self.log[q].get(END, self.FLOOR) if q is not None else self.FLOOR)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next state and log probability by (state, symbol), and log probability of ending, of the states in reach.

        State 0 is the start; the last state is where an unknown step leads, and all its steps are unknown.
        """
        order, todo = {0: 0}, [0]
        while todo:
            for child in self.next[todo.pop()].values():
                if child not in order:
                    order[child] = len(order)
                    todo.append(child)
        lost = len(order)
        to, log, end = np.full((lost + 1, len(ALPHABET)), lost), np.full((lost + 1, len(ALPHABET)), self.FLOOR), np.full(lost + 1, self.FLOOR)
        for q, i in order.items():
            end[i] = self.log[q].get(END, self.FLOOR)
            for c, child in self.next[q].items():
                to[i, ALPHABET.index(c)] = order[child]
                log[i, ALPHABET.index(c)] = self.log[q].get(c, self.FLOOR)
        return to, log, end


def background_automaton(pairs: dict[tuple[str, str], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same tables for a bigram model of ordinary runs: the state is the symbol before."""
    n = len(ALPHABET)
    count = np.ones((n + 1, n + 1))  # the first row is the start, the last column the end
    for (a, b), k in pairs.items():
        count[0 if a == "^" else 1 + ALPHABET.index(a), n if b == END else ALPHABET.index(b)] += k
    log = np.log(count / count.sum(axis=1, keepdims=True))
    return np.tile(np.arange(1, n + 1), (n + 1, 1)), log[:, :n], log[:, n]


def log_likelihood(tables: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each row of ``codes`` (symbols, padded at the end): log probability of its first ``lengths`` symbols and the end."""
    to, log, end = tables
    state, total = np.zeros(len(codes), np.int64), np.zeros(len(codes))
    for t in range(codes.shape[1]):
        on = np.flatnonzero(lengths > t)  # rows come longest first, so these are the first ones
        c = codes[: len(on), t]
        total[: len(on)] += log[state[: len(on)], c]
        state[: len(on)] = to[state[: len(on)], c]
    return total + end[state]


class SecretModel:
    """Automata of the credential kinds, a bigram model of ordinary runs, and the least gain of a found secret."""

    LONG = 256

    def __init__(self, automata: dict[str, Automaton], background: dict[tuple[str, str], int], least: float = math.inf):
        self.automata, self.least = automata, least
        self.models, self.plain = [m.tables() for m in automata.values()], background_automaton(background)

    def gains(self, runs: list[str]) -> np.ndarray:
        """Mean log likelihood gain for a symbol of the best credential automaton over ordinary runs, of each run."""
        out = np.full(len(runs), -math.inf)
        if not self.models or not runs:
            return out
        lengths = np.array([len(r) for r in runs])
        order = np.argsort(-lengths, kind="stable")
        while len(order) and lengths[order[0]] > self.LONG:  # long ones alone, one after the other
            i, order = order[0], order[1:]
            out[i] = self._gain_of_long(runs[i])
        for at in range(0, len(order), 20_000):
            part = order[at : at + 20_000]
            n = lengths[part]
            codes = np.zeros((len(part), int(n[0])), np.int64)
            data = CODES[np.frombuffer("".join(runs[i] for i in part).encode(), np.uint8)]
            codes[np.repeat(np.arange(len(part)), n), np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)] = data
            best = np.max([log_likelihood(m, codes, n) for m in self.models], axis=0)
            out[part] = (best - log_likelihood(self.plain, codes, n)) / (n + 1)
        return out

    def _gain_of_long(self, run: str) -> float:
        codes = CODES[np.frombuffer(run.encode(), np.uint8)].tolist()

        def one(tables):
            (to, log), state, total = (t.tolist() for t in tables[:2]), 0, 0.0
            for c in codes:
                total += log[state][c]
                state = to[state][c]
            return total + float(tables[2][state])

        return (max(map(one, self.models)) - one(self.plain)) / (len(codes) + 1)

    def formats(self, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Of each text the spans of credential format, kind 3, that are no base span themselves.

        Candidates are all runs of :func:`candidates`, and the values of assignments, which a keyword may hide in a run.
        """
        found, owner = [], []
        for i, (text, spans) in enumerate(zip(texts, base, strict=True)):
            known = {(s, e) for s, _, e in spans}
            own = set(candidates(text)) | {(s, e) for _, s, e in credentials(text, spans)}
            own = sorted(own - known)
            found += own
            owner += [i] * len(own)
        gains = self.gains([texts[i][s:e] for i, (s, e) in zip(owner, found, strict=True)])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k in np.flatnonzero(gains >= self.least).tolist():
            out[owner[k]].append((found[k][0], 3, found[k][1]))
        return out


def credential_sample(docs: DataFrame, text_col: str, strings: int, most_symbols: int) -> tuple[DataFrame, dict[str, list[str]]]:
    """(kind, value) of all different credentials of base matches, and ``strings`` of each kind by hash of the value, to learn from.

    Values whose hash falls into the last quarter are never learned from: they calibrate. Neither are those of over ``most_symbols``.
    """

    def run(stream):
        for batch in stream:
            kinds, values = [], []
            for text in batch.column(0).to_pylist():
                for kind, s, e in credentials(text, base_spans(text)):
                    kinds.append(kind)
                    values.append(text[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    given = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"))
    rows = cut(given.mapInArrow(run, "kind string, value string").distinct())
    learn = rows.where((F.crc32("value") % 4 < 3) & (F.length("value") <= most_symbols))
    return rows, {k: [r["value"] for r in learn.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(strings).collect()] for k in KINDS}


def ordinary_pairs(docs: DataFrame, text_col: str) -> dict[tuple[str, str], int]:
    """Counts of neighbouring symbols in all runs of all whole texts that no base span touches; at most 121 rows come back."""

    def run(stream):
        n: Counter = Counter()
        for batch in stream:
            for text in batch.column(0).to_pylist():
                for token in outside(text, base_spans(text)):
                    symbols = token.translate(SYMBOLS)
                    n.update(zip("^" + symbols, symbols + END, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in n], pa.string()), pa.array([b for _, b in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["a", "b", "n"])

    given = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"))
    got = given.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return {(r["a"], r["b"]): r["n"] for r in got}


def outside(text: str, base: list[tuple[int, int, int]]) -> list[str]:
    """The candidates that no base span touches; both lists are in order, so one walk tells."""
    out, k, reach = [], 0, -1
    for s, e in candidates(text):
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= s:
            out.append(text[s:e])
    return out


def calibrated(docs: DataFrame, model: SecretModel, sample: DataFrame, text_col: str, false_alarms: float, least_recall: float) -> float:
    """The least gain: ``false_alarms`` of the ordinary runs of all texts reach it at most.

    The gains of all runs are counted in steps of 1/20, so few rows come back. If fewer than ``least_recall`` of the credentials
    that nothing was learned from reach it, formats tell nothing here and the least gain is infinite.
    """
    step = lambda g: np.floor(np.clip(g, -20, 20) * 20).astype(np.int64)

    def count(stream):
        n: Counter = Counter()
        for batch in stream:
            texts = batch.column(0).to_pylist()
            for a, b in batches(texts):
                n.update(step(model.gains([t for x in texts[a:b] for t in outside(x, base_spans(x))])).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["step", "n"])

    def held(stream):
        for batch in stream:
            n = Counter(step(model.gains(batch.column(0).to_pylist())).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["step", "n"])

    given = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"))
    plain = {r["step"]: r["n"] for r in given.mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()}
    values = sample.where((F.crc32("value") % 4 == 3) & (F.length("value") >= LEAST)).select("value").distinct()
    real = {r["step"]: r["n"] for r in values.mapInArrow(held, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()}
    allowed, passed, least = false_alarms * sum(plain.values()), 0, None
    for at in range(400, -1, -1):
        passed += plain.get(at, 0)
        if passed > allowed:
            break
        least = at
    if least is None or sum(n for at, n in real.items() if at >= least) < max(1, least_recall * sum(real.values())):
        return math.inf
    return least / 20


def fit_secrets(docs: DataFrame, text_col: str = "text", strings: int = 400, most_symbols: int = 256, least_values: int = 10, false_alarms: float = 1e-4, least_recall: float = 0.5) -> SecretModel:
    """Learns formats from the base matches of all documents.

    The labelled credentials are the values of base matches, ``strings`` of a kind (the bound of the sample); kinds of fewer
    than ``least_values`` give no automaton. Ordinary runs of all whole texts make the background and, with the credentials
    that were kept from learning, the least gain; see :func:`calibrated`. Nulls don't train. Without credentials nothing has a format.
    """
    sample, learn = credential_sample(docs, text_col, strings, most_symbols)
    automata = {k: Automaton([v.translate(SYMBOLS) for v in vs]) for k, vs in learn.items() if len(vs) >= least_values}
    if not automata:
        return SecretModel({}, {})
    model = SecretModel(automata, ordinary_pairs(docs, text_col))
    model.least = calibrated(docs, model, sample, text_col, false_alarms, least_recall)
    return model


def find_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format, and ``found`` with text.

    spans lists kind:start:end by start, then kind (assign, access, hex, format), in code points, end exclusive. A `format`
    span is a run, or the value of an assignment, that the automata take for a credential; it may lie inside a base span
    or go beyond it, but is never equal to one.
    Null and empty texts have no spans; whole texts are read; repeated rows are scanned alike; an empty table gives an empty result.
    """
    names = (*KINDS, "format")

    def run(stream):
        for batch in stream:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for a, b in batches(texts):
                base = [base_spans(t) for t in texts[a:b]]
                for text, spans, formats in zip(texts[a:b], base, model.formats(texts[a:b], base), strict=True):
                    spans = sorted(spans + formats)
                    said = [f"{names[k]}:{s}:{e}" for s, k, e in spans]
                    own = ",".join(x for x, (_, k, _) in zip(said, spans, strict=True) if k < 3)
                    n = Counter(k for _, k, _ in spans)
                    rows.append((n[0], n[1], n[2], hashlib.sha256(own.encode()).hexdigest(), ",".join(said), n[3], [text[s:e] for s, _, e in spans]))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format", "found"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, found array<string>")
