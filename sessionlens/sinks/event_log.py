"""A table of events with a commit log, so that replays, aborted writes and two writers at once add nothing twice.

Data of a write lies in a folder of its own. It is part of the table once an entry of the log names it, and the entry for a
version can be made by one writer only. A write is planned against a version; if another takes the next one first, it is
planned again. Folders that no entry names are left from aborted writes and are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG, DATA = "_log", "data"


class Conflict(Exception):
    """Another writer made the version first."""


class EventLog:
    """The table at ``path``, on any file system that Hadoop knows. Rows are unique by ``key``; rows with a null key are all kept."""

    def __init__(self, spark: SparkSession, path: str, key: str = "event_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, *parts: str):
        return self.hadoop.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """The log in order of version: version, batch, folder, rows, replaces. One small file a commit; a compacted table starts anew."""
        files = self._files()
        if not files.exists(self._at(LOG)):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(self._at(LOG)) if s.getPath().getName().endswith(".json"))
        out = []
        for name in names:
            stream = files.open(self._at(LOG, name))
            try:
                out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        last = max((i for i, e in enumerate(out) if e["replaces"]), default=0)
        return out[last:]

    def read(self, entries: list[dict] | None = None) -> DataFrame | None:
        """The rows of the table; None before its first rows."""
        folders = [f"{self.path}/{DATA}/{e['folder']}" for e in (self.entries() if entries is None else entries) if e["rows"]]
        return self.spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None

    def _commit(self, entry: dict) -> None:
        """Makes the log's entry, or raises :class:`Conflict`: of all writers that rename onto its name one succeeds."""
        files = self._files()
        held = self._at(LOG, f".{uuid.uuid4().hex}")
        out = files.create(held, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        context = self.hadoop.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(files.makeQualified(held), files.makeQualified(self._at(LOG, f"{entry['version']:020d}.json")), none)
        except Exception as e:
            files.delete(held, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {entry['version']}") from None
            raise

    def append(self, events: DataFrame, batch: str | None = None, tries: int = 10, before_commit: Callable[[], None] | None = None) -> int:
        """Adds the rows whose key the table doesn't hold; returns their number.

        A ``batch`` that the log holds adds nothing. A failure before the commit leaves the table as it was; the same write may be
        tried again. ``before_commit`` runs between the two.
        """
        for _ in range(tries):
            entries = self.entries()
            if batch is not None and any(batch in e["batches"] for e in entries):
                return 0
            fresh = events.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
            old = self.read(entries)
            if old is not None:
                fresh = fresh.join(old.select(self.key), self.key, "left_anti").select(events.columns)
            fresh = fresh.unionByName(events.where(F.col(self.key).isNull()))
            folder = uuid.uuid4().hex
            fresh.write.parquet(f"{self.path}/{DATA}/{folder}")
            rows = self.spark.read.schema(events.schema).parquet(f"{self.path}/{DATA}/{folder}").count()
            if before_commit:
                before_commit()
            version = entries[-1]["version"] + 1 if entries else 0
            try:
                self._commit({"version": version, "batches": [batch] if batch is not None else [], "folder": folder, "rows": rows, "replaces": False})
                return rows
            except Conflict:
                self._files().delete(self._at(DATA, folder), True)
        raise Conflict(f"no version after {tries} tries")

    def compact(self, files: int = 1) -> None:
        """Rewrites the table into one folder, whose entry replaces those before it and names their batches."""
        entries = self.entries()
        rows = self.read(entries)
        if rows is None:
            return
        folder = uuid.uuid4().hex
        rows.repartition(files).write.parquet(f"{self.path}/{DATA}/{folder}")
        self._commit({"version": entries[-1]["version"] + 1, "batches": [b for e in entries for b in e["batches"]], "folder": folder, "rows": sum(e["rows"] for e in entries), "replaces": True})

    def sweep(self) -> int:
        """Deletes folders that no entry names, when no write is under way; returns their number."""
        named = {e["folder"] for e in self.entries()}
        files, gone = self._files(), 0
        if files.exists(self._at(DATA)):
            for s in files.listStatus(self._at(DATA)):
                if s.getPath().getName() not in named:
                    files.delete(s.getPath(), True)
                    gone += 1
        return gone

    def start(self, events: DataFrame, checkpoint: str, name: str = "events", trigger: dict | None = None):
        """Writes a stream's micro-batches, each once: its number is the batch that the log keeps."""

        def write(batch: DataFrame, n: int) -> None:
            self.append(batch, f"{name}:{n}")

        return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def write_events_table(events: DataFrame, path: str, batch: str | None = None) -> int:
    """Appends events whose id the table at ``path`` doesn't hold yet, so a replay adds nothing; returns how many were added."""
    return EventLog(events.sparkSession, path).append(events, batch)
