"""Streaming forms: session and journal streams, emission dedup, anchored suppression, sequence state, latches, session scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionlens.operators.carried import MICROS, as_given, micros
from sessionlens.operators.sequences import CHAIN_WINDOW, REPEAT_WINDOW, SESSION_TIES, ChainSearch
from sessionlens.schemas import EVENTS, struct
from sessionlens.sources.journal import FORMAT, JournalSource


def stream_sessions(spark: SparkSession, path: str, client: str, kind: str = "sessions", files: int = 1000) -> DataFrame:
    """New session files as lines; ordinals are places in the whole file, so each file is read whole."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(path).select("value", F.col("_metadata.file_path").alias("source_path"))
    lines = raw.select("source_path", F.posexplode(F.split("value", "\r?\n")).alias("ordinal", "value"))
    return lines.where(F.trim("value") != "").select(F.lit(client).alias("client"), F.col("source_path").alias("source_id"), F.lit(kind).alias("source_kind"), "source_path", F.col("ordinal").cast("long").alias("ordinal"), "value")


def follow_events(spark: SparkSession, path: str, start: str = "beginning", recent: int = 256, bytes_per_batch: int | None = None, state: str | None = None, dedup: str = "10 minutes") -> DataFrame:
    """Events of a growing journal and its rotated generations, each id once.

    ``start`` is beginning, end, or recent for the last ``recent`` events. ``bytes_per_batch`` bounds a micro-batch and needs a
    ``state`` folder. Lines that aren't events have a null id and are left out.
    """
    spark.dataSource.register(JournalSource)
    lines = spark.readStream.format(FORMAT).option("start", start).option("recentEvents", recent)
    if bytes_per_batch is not None:
        lines = lines.option("bytesPerBatch", bytes_per_batch).option("state", state)
    df = lines.load(path).select(F.from_json("value", struct(EVENTS)).alias("e")).select("e.*").where("event_id is not null")
    timed = df.withColumn("event_ts", F.coalesce("event_time", F.try_to_timestamp(F.col("timestamp")), F.current_timestamp()))
    return timed.withWatermark("event_ts", dedup).dropDuplicatesWithinWatermark(["event_id"])


def emit_once(events: DataFrame, fields: tuple[str, ...], time: str = "event_ts", within: str = "7 days") -> DataFrame:
    """A stream's events whose fingerprint over ``fields`` was not seen within a time."""
    return events.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*fields)), 256)).withWatermark(time, within).dropDuplicatesWithinWatermark(["fingerprint"])


def split_late(events: DataFrame, now: str = "observed_at", late: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """(in time, late): rows older than ``late`` before they were observed go aside and aren't lost; rows without a time are in time."""
    is_late = F.coalesce(F.col("event_time") < F.col(now) - F.expr(f"interval {late}"), F.lit(False))
    return events.where(~is_late), events.where(is_late)


def suppress_stream(df: DataFrame, keys: list[str], epoch: str = "epoch", window: int = REPEAT_WINDOW, watermark: tuple[str, str] | None = ("ts", "10 minutes")) -> DataFrame:
    """(keys…, epoch, suppressed, repeats): whether a row repeats its key's anchor; the state is one anchor and count for each key.

    Times are timestamps or seconds, exact to the microsecond. Rows of a micro-batch are taken in order of time. The state
    ends when the watermark has passed the anchor's window. Null keys and times are for the caller to keep apart.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    out = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "_at long, suppressed boolean, repeats long"])

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        anchor, n = state.get if state.exists else (None, 0)
        done = []
        for at in pd.concat(list(pdfs))["_at"].sort_values().tolist():
            again = anchor is not None and at - anchor <= window * MICROS
            anchor, n = (anchor, n + 1) if again else (at, 0)
            done.append((*key, int(at), again, int(n)))
        state.update((int(anchor), int(n)))
        if watermark:
            limit = int(anchor) // 1000 + (window + 1) * 1000
            if limit > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(limit)
        yield pd.DataFrame(done, columns=[*keys, "_at", "suppressed", "repeats"])

    given = df.withColumn("_at", micros(df, epoch))
    given = given.withWatermark(*watermark) if watermark else given
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    got = given.groupBy(*keys).applyInPandasWithState(step, out, "anchor long, n long", "append", timeout)
    return got.select(*keys, as_given(df, epoch, F.col("_at")).alias("epoch"), "suppressed", "repeats")


def sequence_stream(steps: DataFrame, chain_id: str, order: list[str], keys: list[str], window: int = CHAIN_WINDOW, watermark: tuple[str, str] | None = ("ts", "10 minutes")) -> DataFrame:
    """(keys…, chain_id, start_epoch, end_epoch): the action chain over a stream; the state is what lies within the window, and which of it has served as a start.

    Rows of a micro-batch are taken in the order of :func:`~sessionlens.operators.sequences.action_chains`; the steps of one observation count as one row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema}
    ties = [c for c in SESSION_TIES if c in steps.columns]

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times, names, used = state.get if state.exists else ((), (), ())
        search = ChainSearch(order, window * MICROS, ([t, set(n), bool(u)] for t, n, u in zip(times, names, used, strict=True)))
        last, out, rows = -1, [], {}
        for name, at, *tie in pd.concat(list(pdfs)).sort_values(["_at", *ties], kind="stable", na_position="first")[["step", "_at", *ties]].itertuples(index=False):
            rows.setdefault((at, *tie) if "observation_id" in ties else (at, len(rows)), set()).add(name)
        for (at, *_), said in rows.items():
            last = max(last, at)
            start = search.add(int(at), said)
            if start is not None:
                out.append((*key, chain_id, int(start), int(at)))
        state.update(([int(h[0]) for h in search.history], [sorted(h[1]) for h in search.history], [h[2] for h in search.history]))
        limit = int(last) // 1000 + (window + 1) * 1000
        if watermark and limit > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(limit)
        yield pd.DataFrame(out, columns=[*keys, "chain_id", "_start", "_end"])

    given = steps.where(F.col("step").isin(*order) & F.col("epoch").isNotNull()).withColumn("_at", micros(steps, "epoch"))
    given = given.withWatermark(*watermark) if watermark else given
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    got = given.groupBy(*keys).applyInPandasWithState(step, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "chain_id string, _start long, _end long"]), "times array<long>, steps array<array<string>>, used array<boolean>", "append", timeout)
    return got.select(*keys, "chain_id", as_given(steps, "epoch", F.col("_start")).alias("start_epoch"), as_given(steps, "epoch", F.col("_end")).alias("end_epoch"))


def latch_stream(states: DataFrame, keys: list[str], bad: str = "bad", order: str = "epoch") -> DataFrame:
    """(keys…, epoch): one row when a key enters a bad state; a good row re-arms it."""
    kinds = {f.name: f.dataType.simpleString() for f in states.schema}

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        on = state.get[0] if state.exists else False
        out = []
        for now, at in pd.concat(list(pdfs)).sort_values(order)[[bad, order]].itertuples(index=False):
            if now and not on:
                out.append((*key, int(at)))
            on = bool(now)
        state.update((on,))
        yield pd.DataFrame(out, columns=[*keys, "epoch"])

    return states.groupBy(*keys).applyInPandasWithState(step, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "epoch long"]), "on boolean", "append", GroupStateTimeout.NoTimeout)


def score_stream(lines: DataFrame, normalise: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Starts a query that scores the sessions of each micro-batch's files; files come whole, so a grown session is scored anew."""

    def batch(df: DataFrame, n: int) -> None:
        write(score(normalise(df)), n)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def next_high_water(df: DataFrame, column: str, before: int | None) -> int | None:
    """The largest value so far; it never falls."""
    top = df.agg(F.max(column)).first()[0]
    return top if before is None or (top is not None and top > before) else before


