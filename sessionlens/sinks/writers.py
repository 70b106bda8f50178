"""Sinks: JSONL, bulk documents, collector envelopes, delivery by bytes, and an idempotent table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BULK_BYTES, COLLECTOR_BYTES = 5 * 1024 * 1024, 1024 * 1024
"""Most bytes of a request."""


def to_jsonl(events: DataFrame) -> DataFrame:
    """(value): one JSON object for each event; null fields and empty arrays are left out."""
    cols = [F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in events.schema]
    return events.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("value"))


def write_events_jsonl(events: DataFrame, path: str, most_records: int = 1_000_000) -> None:
    to_jsonl(events).write.mode("append").option("maxRecordsPerFile", most_records).text(path)


def to_elastic_bulk(events: DataFrame, index: str = "session-events") -> DataFrame:
    """(value): an action line with the event's id and its document line."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col("event_id").alias("_id")).alias("index")))
    return events.select(F.concat_ws("\n", action, F.to_json(F.struct(*events.columns), {"ignoreNullFields": "true"})).alias("value"))


def to_hec(events: DataFrame, host: str, index: str, sourcetype: str = "session:event", source: str = "sessionlens") -> DataFrame:
    """(value): collector envelopes with the time in epoch seconds."""
    at = F.round(F.unix_micros(F.coalesce(F.try_to_timestamp(F.col("timestamp")), F.col("event_time"))) / 1e6, 3)
    return events.select(F.to_json(F.struct(at.alias("time"), F.lit(host).alias("host"), F.lit(index).alias("index"), F.lit(sourcetype).alias("sourcetype"), F.lit(source).alias("source"), F.struct(*events.columns).alias("event"))).alias("value"))


def byte_batches(values, most: int):
    """Lists of lines that together stay within ``most`` bytes; a longer line goes alone."""
    batch, size = [], 0
    for v in values:
        n = len(v.encode()) + 1
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(v)
        size += n
    if batch:
        yield batch


def deliver(lines: DataFrame, sender: Callable[[list[str]], None], most: int = BULK_BYTES) -> None:
    """Sends (value) from the executors in requests of at most ``most`` bytes; ``sender`` retries and raises as it sees fit."""

    def send(rows):
        for batch in byte_batches((r["value"] for r in rows), most):
            sender(batch)

    lines.select("value").foreachPartition(send)
