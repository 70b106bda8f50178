"""Ordered work over keys of any size: sorted parts with a summary each, summaries composed along a key, state carried in.

Rows are dealt by range on (key, time), so one key may fill many parts and no task holds more than a part. A part says how
it changes the state that enters it; only these summaries, a few for each part, are read in order.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.storage import cut

MICROS = 1_000_000


def micros(df: DataFrame, column: str) -> Column:
    """A time column as microseconds: a timestamp, or seconds as any number."""
    kind = df.schema[column].dataType.typeName()
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else (F.col(column) * MICROS).cast("long")


def as_given(df: DataFrame, column: str, at: Column) -> Column:
    """Microseconds in the type of ``column``."""
    kind = df.schema[column].dataType
    return F.timestamp_micros(at).cast(kind) if kind.typeName().startswith("timestamp") else (at / MICROS).cast(kind)


def in_parts(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """``df`` in sorted parts of about ``rows`` rows by range on ``keys`` and ``order``, with ``part``; written once, so every pass sees the same parts."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return cut(df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("part", F.spark_partition_id()))


# --- repeats ---------------------------------------------------------------------------------------------------------


def last_anchors(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted different times: the next anchor's place after each if it is one, itself at the end; and the last anchor's place from each.

    The last is found by pointer doubling, so a chain of n anchors takes log n steps.
    """
    nxt = np.searchsorted(at, at + window, "right")
    nxt = np.where(nxt < len(at), nxt, np.arange(len(at)))
    last = nxt
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return nxt, last
        last = further


def entries(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The times at which a chain from before can enter these, and the last anchor that it then reaches."""
    _, last = last_anchors(at, window)
    n = int(np.searchsorted(at, at[0] + window, "right")) + 1
    return at[:n], at[last[:n]]


def anchored_repeats(seen: DataFrame, keys: list[str], window: int, rows: int = 500_000) -> DataFrame:
    """(keys…, _t, repeats): the anchors among rows (keys…, _t, _n) with unique (keys, _t), and how many rows beyond one each stands for.

    A time beyond the window of the last anchor is the next anchor. Times and ``window`` are whole numbers.
    """
    parts = in_parts(seen.select(*keys, "_t", "_n"), keys, ["_t"], rows)
    kinds = ", ".join(f"{k} {seen.schema[k].dataType.simpleString()}" for k in keys)

    def segments(stream):
        """(key, times, counts) of the sorted rows of one part."""
        pdf = pd.concat(list(stream))
        if len(pdf):
            edge = np.zeros(len(pdf), bool)
            edge[0] = True
            for k in keys:
                edge[1:] |= pdf[k].values[1:] != pdf[k].values[:-1]
            starts = [*np.flatnonzero(edge).tolist(), len(pdf)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield pdf.iloc[a], pdf["_t"].values[a:b], pdf["_n"].values[a:b]

    def summarise(stream):
        found = list(segments(stream))
        for row, at, _ in ([found[0], found[-1]] if len(found) > 1 else found):  # a key inside a part ends there
            enters, reaches = entries(at, window)
            yield pd.DataFrame([(*[row[k] for k in keys], row["part"], enters.tolist(), reaches.tolist())], columns=[*keys, "part", "enters", "reaches"])

    def compose(stream):
        now = anchor = None
        for pdf in stream:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(row[: len(keys)])
                if key != now:
                    now, anchor = key, None
                else:
                    out.append((row.part, anchor))
                i = 0 if anchor is None else int(np.searchsorted(row.enters, anchor + window, "right"))
                if i < len(row.reaches):
                    anchor = row.reaches[i]
            yield pd.DataFrame(out, columns=["part", "carried"])

    made = parts.mapInPandas(summarise, f"{kinds}, part int, enters array<long>, reaches array<long>")
    # a part has at most one key from before, its first, so this is at most a row a part
    carried = cut(made.repartition(*keys).sortWithinPartitions(*keys, "part").mapInPandas(compose, "part int, carried long"))

    def resolve(stream):
        for i, (row, at, n) in enumerate(segments(stream)):
            before = row["carried"] if i == 0 and not pd.isna(row["carried"]) else None
            first = 0 if before is None else int(np.searchsorted(at, before + window, "right"))
            nxt, _ = last_anchors(at[first:], window) if first < len(at) else (np.array([], int), None)
            places, p = [], 0
            while p < len(nxt):
                places.append(p + first)
                if nxt[p] == p:
                    break
                p = int(nxt[p])
            bounds = np.array([*([0] if first else []), *places, len(at)])
            sums = np.add.reduceat(n, bounds[:-1]) if len(bounds) > 1 else np.array([], int)
            anchors = [*([int(before)] if first else []), *at[places].tolist()]
            key = [row[k] for k in keys]
            yield pd.DataFrame([(*key, a, int(s)) for a, s in zip(anchors, sums, strict=True)], columns=[*keys, "_t", "_n"])

    given = parts.join(F.broadcast(carried), "part", "left")
    counted = given.mapInPandas(resolve, f"{kinds}, _t long, _n long")
    # an anchor's window may reach into later parts, which count for it too
    return counted.groupBy(*keys, "_t").agg((F.sum("_n") - 1).alias("repeats"))


# --- sequences -------------------------------------------------------------------------------------------------------


class Progress:
    """How far the searches of one sequence have come at a point: for each number of steps taken, the latest search that has taken so many.

    Searches with equally many steps take the same rows from then on, so the latest stands for all. A row moves a search
    by one step. ``level[k]`` lists what may stand there, latest first: -j for whatever entered the part with j steps, which
    may be nothing, and in the end the time of a search's first step.
    """

    def __init__(self, steps: int, window: int):
        self.steps, self.window = steps, window
        self.level: list[list[int]] = [[], *[[-k] for k in range(1, steps)]]
        self.entered_ends: dict[int, int] = {}
        self.first_end: int | None = None

    def take(self, at: int, mask: int) -> None:
        """A row at ``at`` that fits the steps in ``mask``."""
        for k in range(self.steps - 1, 0, -1):
            moving = self.level[k]
            if mask >> k & 1 and moving:
                self.level[k] = []
                if k + 1 < self.steps:
                    self.level[k + 1] = moving if moving[-1] >= 0 else moving + self.level[k + 1]
                    continue
                for start in moving:
                    if start < 0:
                        self.entered_ends[-start] = at
                    elif at - start <= self.window and self.first_end is None:
                        self.first_end = at
        if mask & 1:
            if self.steps == 1:
                self.first_end = at if self.first_end is None else self.first_end
            else:
                self.level[1] = [at]

    def after(self, entering: list[int | None]) -> tuple[list[int | None], int | None]:
        """The levels that leave and the first end in the window, for levels that enter as times."""
        ends = [end for k, end in self.entered_ends.items() if entering[k] is not None and end - entering[k] <= self.window]
        if self.first_end is not None:
            ends.append(self.first_end)
        stands = [[entering[-x] if x < 0 else x for x in may] for may in self.level]
        return [next((x for x in may if x is not None), None) for may in stands], min(ends, default=None)


def first_ends(rows: DataFrame, steps: list[int], windows: list[int], key: str = "entity", per_part: int = 500_000) -> DataFrame:
    """(key, seq, at): the first row of each key that ends sequence ``seq`` within its window of the search's first step.

    ``rows`` has the key, ``at`` in microseconds, any further columns of order after it, and ``masks``: for each sequence the
    bits of the steps that the row fits. Times are not negative.
    """
    order = [c for c in rows.columns if c not in (key, "masks", "at")]
    parts = in_parts(rows, [key], ["at", *order], per_part).select(key, "at", "masks", "part")
    kind = rows.schema[key].dataType.simpleString()

    def summarise(stream):
        """A row for each key and sequence: what the part does to the levels, and the first end of searches that start in it."""
        now, state = None, []

        def told(part):
            for s, p in enumerate(state):
                pairs = p.entered_ends.items()
                yield (now, s, part, p.level, [k for k, _ in pairs], [e for _, e in pairs], p.first_end)

        out = []
        for pdf in stream:
            for entity, at, masks, part in zip(pdf[key].tolist(), pdf["at"].tolist(), pdf["masks"].tolist(), pdf["part"].tolist(), strict=True):
                if entity != now:
                    out += told(part)
                    now, state = entity, [Progress(n, w) for n, w in zip(steps, windows, strict=True)]
                for s, mask in enumerate(masks):
                    if mask:
                        state[s].take(at, mask)
            if len(out) > 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
            last = int(pdf["part"].iloc[-1]) if len(pdf) else 0
        if now is not None:
            out += told(last)
        yield pd.DataFrame(out, columns=names)

    names = [key, "seq", "part", "level", "entered", "ends", "first_end"]

    def compose(stream):
        now, levels, done = None, [], False
        for pdf in stream:
            out = []
            for row in pdf.itertuples(index=False):
                if (row[0], row.seq) != now:
                    now, levels, done = (row[0], row.seq), [None] * steps[row.seq], False
                if done:
                    continue
                p = Progress(steps[row.seq], windows[row.seq])
                p.level = [list(may) for may in row.level]
                p.entered_ends = dict(zip(row.entered, row.ends, strict=True))
                p.first_end = None if pd.isna(row.first_end) else int(row.first_end)
                levels, end = p.after(levels)
                if end is not None:
                    out.append((*now, end))
                    done = True
            yield pd.DataFrame(out, columns=[key, "seq", "at"])

    made = parts.mapInPandas(summarise, f"{key} {kind}, seq int, part int, level array<array<long>>, entered array<long>, ends array<long>, first_end long")
    return made.repartition(key, "seq").sortWithinPartitions(key, "seq", "part").mapInPandas(compose, f"{key} {kind}, seq int, at long")
