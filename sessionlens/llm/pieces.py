"""SentencePiece encoding and decoding over a relational lattice of pieces."""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import cut

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
RUN = re.compile(f"{SPACE}+[^{SPACE}]*")
LONGEST = 48  # code points of a unit whose cuts fit a 64-bit mask
PART = 1_000_000  # characters of the texts that are strings in a Python worker at a time


def bounds(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings without nulls, and the offsets of the strings in them."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def first_bytes(data: np.ndarray) -> np.ndarray:
    """Where the characters of UTF-8 ``data`` begin."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The strings between ``offsets``, which are those of bytes in ``data``."""
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def told_apart(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The distinct ``values``, and for each value its place among them."""
    made = values.dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False), made.dictionary


def parts(texts: pa.Array, most_chars: int = PART):
    """(start, end, texts): slices of Arrow ``texts`` as lists of about ``most_chars`` characters each, whole texts only.

    A batch of Arrow has as many rows as Spark is set to, whatever their length; only one slice becomes Python strings at a time.
    """
    start = size = 0
    for i, n in enumerate(pc.utf8_length(texts).to_pylist()):
        size += n or 0
        if size >= most_chars or i + 1 == len(texts):
            yield start, i + 1, texts.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... up to ``length`` places for each entry, one after another."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """What a SentencePiece model file says: ids and scores of its pieces, ids of its byte pieces."""

    def __init__(self, path: str = MODEL):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in usual}
        self.scores = {sp.id_to_piece(i): float(sp.get_score(i)) for i in usual}
        self.bytes = {i: int(sp.id_to_piece(i)[3:5], 16) for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.unknown = sp.unk_id()
        # characters that stand beside others inside pieces are numbered from 1, all others are 0 and always stand alone
        chars = sorted({c for pair in self.inner for c in pair})
        self.number = np.zeros(0x110000, np.int16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.marks_lead = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.inner)
        for x, y in self.inner:
            self.joins[self.number[ord(x)], self.number[ord(y)]] = True

    def words(self, text: str) -> list[str]:
        """``text`` cut at its spaces if no piece has a space mark after another character, else whole.

        Words between single spaces come bare, as their mark goes without saying; a text with runs of spaces gives
        words with all their marks.
        """
        if self.marks_lead:
            parts = text.split(" ")
            if "" not in parts and SPACE not in text:
                return parts
            return RUN.findall(SPACE + text.replace(" ", SPACE))
        return [SPACE + text.replace(" ", SPACE)]

    def units(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words with their marks, cut wherever no piece spans the two neighbouring characters, and each word's number of units.

        The units are Arrow strings that lie side by side in one buffer.
        """
        if not len(words):
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        data, ends = bounds(pc.if_else(pc.starts_with(words, SPACE), words, pc.binary_join_element_wise(SPACE, words, "")))
        chars, ends = first_bytes(data), ends[1:]
        n = self.number[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
        starts = np.ones(len(n) + 1, bool)
        starts[1:-1] = ~self.joins[n[:-1], n[1:]]
        ends = np.searchsorted(chars, ends)
        starts[ends] = True
        at = np.flatnonzero(starts)
        return strings(data, np.append(chars, len(data))[at]), np.diff(np.searchsorted(at, ends), prepend=0)

    def long_unit(self, unit: str) -> list[int]:
        """Cuts of a unit too long for a mask, by the same merges with a heap."""
        import heapq

        n = len(unit)
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def offer(i):
            j = nxt[i]
            if j < n and nxt[j] - i <= self.longest and (s := self.scores.get(unit[i : nxt[j]])) is not None:
                heapq.heappush(heap, (-s, i, nxt[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or nxt[nxt[i]] != end:
                continue
            alive[nxt[i]] = False
            nxt[i] = end
            if end < n:
                prev[end] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [i for i in range(n) if alive[i]] + [n]

    def decode(self, ids: list[int], names: dict[int, bytes]) -> str:
        text = b"".join(map(names.__getitem__, ids)).decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def gives(self, ids: list[int], names: dict[int, bytes], text: str) -> bool:
        """Whether decoding ``ids`` gives ``text``."""
        try:
            return self.decode(ids, names) == text
        except (KeyError, UnicodeDecodeError):
            return False

    def names(self) -> dict[int, bytes]:
        return {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for i, b in self.bytes.items()}


def counted_units(stream, vocab: Vocabulary, most_chars: int = PART):
    """Batches of (unit, n) for batches of texts: words of a slice of texts are counted first, then the units of its distinct words."""
    for batch in stream:
        for _, _, texts in parts(batch.column(0), most_chars):
            at, words = told_apart(pa.array(chain.from_iterable(vocab.words(t) for t in texts if t), pa.string()))
            units, number = vocab.units(words)
            which, units = told_apart(units)
            n = np.bincount(which, np.repeat(np.bincount(at, minlength=len(words)), number), len(units)).astype(np.int64)
            long = pc.utf8_length(units).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([units, pa.array(n)], names=["unit", "n"]).filter(pa.array((long >= 2) & (long <= LONGEST)))


def distinct_units(docs: DataFrame, vocab: Vocabulary, text_col: str, most_chars: int = PART) -> DataFrame:
    """(unit, n): the units of all texts that have a choice to make, with their number, added up before the shuffle.

    Texts of about ``most_chars`` characters are counted at a time; Spark adds up what one task counted.
    """

    def run(stream):
        return counted_units(stream, vocab, most_chars)

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """(unit, edges): all substrings of a unit that are pieces, as structs of start, length and score.

    Substrings no longer than the longest piece are exploded, by start and then by length, which Spark compiles, and
    equi-joined to the piece table, which the model file bounds; edges come together by unit.
    """
    scores = {p: x for p, x in vocab.scores.items() if len(p) > 1}
    # by Arrow the rows are in the plan; a list of them would be read by Python workers of its own in every executor
    table = spark.createDataFrame(pa.table({"piece": pa.array(list(scores), pa.string()), "score": pa.array(list(scores.values()), pa.float64())}))
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 2)).alias("start"))
    spans = starts.select("unit", "start", F.explode(F.sequence(F.lit(2), F.least(F.length("unit") - F.col("start"), F.lit(vocab.longest)))).alias("length"))
    edges = spans.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("length"))).join(F.broadcast(table), "piece")
    return edges.groupBy("unit").agg(F.collect_list(F.struct((-F.col("score")).alias("cost"), "start", "length")).alias("edges"))


def bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def merge_mask(unit: Column, edges: Column) -> Column:
    """Mask of the cuts after merging neighbours by best score, leftmost first: for models of the BPE kind.

    A piece's parts have better scores than the piece, so one fold over the edges in order of score sees each merge
    when its turn comes: an edge is merged if both its ends are cuts and one cut alone is left inside.
    """
    ready = F.transform(F.array_sort(edges), lambda e: F.struct((bit(e["start"]) + bit(e["start"] + e["length"])).alias("ends"), ((bit(e["length"] - 1) - 1) * bit(e["start"] + 1)).alias("inside")))
    can = lambda m, e: (m.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(m.bitwiseAND(e["inside"])) == 1)
    return F.aggregate(ready, bit(F.length(unit) + 1) - 1, lambda m, e: F.when(can(m, e), m.bitwiseAND(F.bitwise_not(e["inside"]))).otherwise(m))


def viterbi_cuts(unit: Column, edges: Column, longest: int, unknown: float = -1e6) -> Column:
    """Cuts of the path with the largest sum of scores, over a map of start * 64 + length to score: for models of the unigram kind.

    The fold keeps the best score and cuts for each end; a character without a piece costs ``unknown``.
    """
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("cuts")))

    def step(best: Column, end: Column) -> Column:
        # struct comparison: score first, then the cuts
        ways = F.transform(F.sequence(F.greatest(end - longest, F.lit(0)), end - 1), lambda a: F.struct((F.get(best, a)["score"] + F.coalesce(F.try_element_at(edges, a * 64 + end - a), F.when(end - a == 1, unknown).otherwise(float("-inf")))).alias("score"), F.concat(F.get(best, a)["cuts"], F.array(end)).alias("cuts")))
        return F.concat(best, F.array(F.array_max(ways)))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(unit)), first, step), -1)["cuts"]


def encoded_units(units: DataFrame, vocab: Vocabulary, kind: str = "bpe") -> DataFrame:
    """(unit, mask): bit k of mask is set if the unit is cut before its character k. Units without edges have no row."""
    made = lattice(units.select("unit"), units.sparkSession, vocab)
    if kind == "bpe":
        return made.select("unit", merge_mask(F.col("unit"), F.col("edges")).alias("mask"))
    single = F.map_from_entries(F.transform("edges", lambda e: F.struct((e["start"] * 64 + e["length"]).alias("at"), (-e["cost"]).alias("score"))))
    cuts = viterbi_cuts(F.col("unit"), single, vocab.longest)
    return made.select("unit", F.aggregate(cuts, F.lit(0).cast("long"), lambda a, c: a + bit(c)).alias("mask"))


class PieceIds:
    """Ids of many words at once: each distinct word is cut once, each distinct unit looked up once, in arrays over all of them."""

    def __init__(self, vocab: Vocabulary, table: "UnitTable"):
        self.vocab, self.table = vocab, table
        self.pieces, self.ids = pa.array(list(vocab.ids), pa.string()), np.fromiter(vocab.ids.values(), np.int32, len(vocab.ids))
        self.byte_ids = np.full(256, vocab.unknown, np.int32)
        self.byte_ids[list(vocab.byte_ids)] = list(vocab.byte_ids.values())

    def of(self, words: list[str], more: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words``, one after another, and the number of ids of each word. ``more`` has masks of units that the table lacks."""
        at, distinct = told_apart(pa.array(words, pa.string()))
        units, number = self.vocab.units(distinct)
        which, units = told_apart(units)
        pool, n = self._units(units, more)
        unit_start, unit_n = (np.cumsum(n) - n)[which], n[which]
        pool = pool[runs(unit_start, unit_n)]  # the ids of the distinct words
        upto = np.concatenate([[0], np.cumsum(unit_n)])[np.concatenate([[0], np.cumsum(number)])]
        start, length = upto[:-1][at], np.diff(upto)[at]
        return pool[runs(start, length)], length

    def _units(self, units: pa.Array, more: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``units``, one after another, and the number of ids of each unit; a character without a piece becomes its UTF-8 bytes."""
        if not len(units):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        text, ends = bounds(units)
        chars = first_bytes(text)
        first = np.searchsorted(chars, ends)
        first, long = first[:-1], np.diff(first)
        mask = self.table.masks_of(units)
        if more:
            got = np.fromiter((more.get(u, 0) for u in units.to_numpy(zero_copy_only=False)), np.int64, len(units))
            mask = np.where(got != 0, got, mask)
        mask[long < 2] = -1
        cut = (np.repeat(mask, long) >> np.minimum(np.arange(len(chars)) - np.repeat(first, long), 63) & 1).astype(bool)
        for u in np.flatnonzero(long > LONGEST).tolist():
            cut[first[u] : first[u] + long[u]] = False
            cut[first[u] + np.array(self.vocab.long_unit(units[u].as_py())[:-1])] = True
        starts = chars[cut]
        width = np.diff(starts, append=len(text))
        found = pc.index_in(strings(text, np.append(starts, len(text))), value_set=self.pieces)
        at = found.fill_null(-1).to_numpy(zero_copy_only=False)
        lacks = at < 0
        n = np.where(lacks & bool(self.vocab.byte_ids), width, 1)
        ids = np.repeat(np.where(lacks, self.vocab.unknown, self.ids[at]), n)
        if self.vocab.byte_ids and lacks.any():
            ids[np.repeat(lacks, n)] = self.byte_ids[text[runs(starts[lacks], width[lacks])]]
        return ids.astype(np.int32), np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, ends)])


class Spelling:
    """Decodes the ids of many texts at once: what each id writes, side by side in one array of bytes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.names = vocab, vocab.names()
        parts = [self.names.get(i, b"") for i in range(max(self.names) + 1)]
        self.length = np.array([len(x) for x in parts])
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(parts), np.uint8)

    def gives(self, ids: np.ndarray, ends: np.ndarray, texts: list) -> list[bool]:
        """Of each text whether decoding its ids, those up to its entry of ``ends``, gives it again."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.length) or not self.length[ids].all()):
            starts = np.concatenate([[0], ends[:-1]])
            return [self.vocab.gives(ids[a:b].tolist(), self.names, t or "") for a, b, t in zip(starts, ends, texts, strict=True)]
        n = self.length[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        said = self.pool[np.repeat(self.start[ids] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        cut = upto[np.concatenate([[0], ends])].tolist()
        # a text that holds the mark itself can't be told from one with a space there
        return [said[a:b] == (SPACE + t.replace(" ", SPACE)).encode("utf-8", "surrogatepass") and SPACE not in t if t else a == b for a, b, t in zip(cut, cut[1:], texts, strict=False)]


class UnitTable:
    """Masks by the 64-bit hash of a unit, in two sorted arrays: 16 bytes a unit."""

    def __init__(self, hashes: np.ndarray, masks: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.masks = hashes[order], masks[order]

    def masks_of(self, units: pa.Array) -> np.ndarray:
        """Masks of ``units``; one that the table lacks gets -1, which cuts before every character."""
        h, at, known = self.find(units)
        return np.where(known, self.masks[at], -1) if len(self.masks) else np.full(len(h), -1)

    def find(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of ``units``, their places in the table, and whether they are there."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, units.cast(pa.binary()).to_numpy(zero_copy_only=False), repeat(42)), np.uint64, len(units)).view(np.int64)
        at = np.searchsorted(self.hashes, h).clip(0, max(0, len(self.hashes) - 1))
        return h, at, self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)


def most_frequent(masks: DataFrame, most: int, steps: int = 16) -> DataFrame:
    """The rows of (unit, mask, n) with the largest n, about ``most`` and never more.

    They are told by a threshold on n, out of ``steps`` for each doubling, whose counts are some hundred rows: a sort with
    a limit would bring each partition's largest ``most`` rows into one task.
    """
    step = F.floor(F.log2("n") * steps)
    left, threshold = most, None
    for r in sorted(masks.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left -= r["count"]
        if left < 0:
            break
        threshold = r["step"]
    return masks.limit(0) if threshold is None else masks.where(step >= threshold)


def encoded_texts(stream, vocab: Vocabulary, table: UnitTable, most_chars: int = PART):
    """Batches of (doc_id, n_pieces, ids, round_trip) for batches of (doc_id, text, extra), a slice of texts at a time."""
    known, spelling = PieceIds(vocab, table), Spelling(vocab)
    for batch in stream:
        for a, b, texts in parts(batch.column(1), most_chars):
            words = [vocab.words(t) if t else [] for t in texts]
            extras = batch.column(2).slice(a, b - a).to_pylist()
            ids, each = known.of(list(chain.from_iterable(words)), dict(chain.from_iterable(x for x in extras if x)))
            upto = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(list(map(len, words)))])]
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(upto)), lists, pa.array(spelling.gives(ids, upto[1:], texts), pa.bool_())], names=["doc_id", "n_pieces", "ids", "round_trip"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: Vocabulary | None = None, kind: str = "bpe", table_units: int = 4_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, ids, round_trip.

    round_trip says that decoding the ids of the row, as they are returned, gives its whole text again.

    Ids are those of the sentencepiece library for the same model. Each distinct unit of the corpus is encoded once,
    through the lattice. The masks of the most frequent units, ``table_units`` at most and 16 bytes each, go to all tasks:
    that is the bound of the broadcast. They are looked up by the 64-bit hash of the unit: of the units of a corpus that the
    table lacks, 4,000,000 / 2^64 find another's entry, which is a chance of 1 in 460 for 10^10 different units; round_trip
    can't see that. Units beyond the table reach their documents by a join on (row, unit). Units of over 48 characters are
    merged in the task. Null and empty texts have no pieces; repeated rows are encoded alike; empty in, empty out.
    """
    vocab = vocab or Vocabulary()
    spark = docs.sparkSession
    units = cut(distinct_units(docs, vocab, text_col))
    total = units.count()
    masks = cut(encoded_units(units, vocab, kind).join(units, "unit") if total > table_units else encoded_units(units, vocab, kind).withColumn("n", F.lit(0)))
    head = most_frequent(masks, table_units) if total > table_units else masks
    got = head.select(F.xxhash64("unit").alias("h"), "mask").toArrow()
    table = spark.sparkContext.broadcast(UnitTable(got["h"].to_numpy(), got["mask"].to_numpy()))

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    extra = F.lit(None).cast("map<string,long>")
    if total > table_units:
        given = cut(given)

        def rare(stream):
            for batch in stream:
                row = batch.column(0).to_numpy()
                for a, b, texts in parts(batch.column(1)):
                    words = [vocab.words(t) if t else [] for t in texts]
                    at, distinct = told_apart(pa.array(chain.from_iterable(words), pa.string()))
                    units, number = vocab.units(distinct)
                    which, units = told_apart(units)
                    long = pc.utf8_length(units).to_numpy(zero_copy_only=False)
                    wanted = (long >= 2) & (long <= LONGEST) & ~table.value.find(units)[2]
                    # the units of each word, of each text, told apart as pairs of numbers
                    held = which[runs((np.cumsum(number) - number)[at], number[at])]
                    owner = np.repeat(np.repeat(np.arange(b - a), list(map(len, words))), number[at])
                    pairs = np.unique((owner * max(1, len(units)) + held)[wanted[held]])
                    yield pa.RecordBatch.from_arrays([pa.array(row[a:b][pairs // max(1, len(units))]), units.take(pa.array(pairs % max(1, len(units))))], names=["row", "unit"])

        tail = given.select("row", "text").mapInArrow(rare, "row long, unit string").join(masks, "unit")
        tail = tail.groupBy(F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("unit", "mask"))).alias("extra"))
        given = given.join(tail, F.col("row") == F.col("_row"), "left").drop("_row")
        extra = F.col("extra")

    def run(stream):
        return encoded_texts(stream, vocab, table.value)

    kind_of = given.schema["doc_id"].dataType.simpleString()
    return given.select("doc_id", "text", extra.alias("extra")).mapInArrow(run, f"doc_id {kind_of}, n_pieces long, ids array<int>, round_trip boolean")


def decode(coded: DataFrame, ids_col: str = "ids", vocab: Vocabulary | None = None) -> DataFrame:
    """``coded`` with ``text``: its pieces put together, marks as spaces, without the leading one. Null ids give null."""
    vocab = vocab or Vocabulary()
    names = vocab.names()

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else vocab.decode(list(x), names))

    return coded.withColumn("text", text(F.col(ids_col)))
