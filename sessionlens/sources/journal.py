"""A journal of events that grows and is rotated, as a batch and streaming data source with byte offsets.

A journal is a file and its rotated generations beside it: ``events.jsonl``, ``events-2024-05-01.1.jsonl`` and so on. A
generation is known by its first line, which never changes, so a rename is no new file and a replaced file is one.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "session_journal"
SCHEMA = "generation string, offset long, value string"
HEAD, BLOCK = 65_536, 1 << 20


def lowered(options: dict) -> dict:
    """Options by lower-case name, as Spark hands them over."""
    return {k.lower(): v for k, v in options.items()}


@dataclass
class Piece(InputPartition):
    """Lines of one generation that begin in [start, end)."""

    path: str
    generation: str
    start: int
    end: int


class Journal:
    """The generations of a journal and their lines."""

    def __init__(self, options: dict):
        options = lowered(options)
        self.path = options["path"]
        self.most_line = int(options.get("mostlinebytes", 1 << 20))
        self.piece = int(options.get("piecebytes", 8 << 20))

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), re.sub("^file:", "", self.path))

    def generations(self) -> list[tuple[str, str, int]]:
        """(generation, path, bytes up to the last line's end), rotated ones in order of name, the active one last. No file yet is no generation."""
        store, path = self._fs()
        folder, _, name = path.rpartition("/")
        stem, _, ext = name.rpartition(".")
        found = []
        for info in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            own = info.base_name
            if info.type == pafs.FileType.File and (own == name or own.startswith(f"{stem}-") and own.endswith(f".{ext}")):
                order = [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", own)]
                found.append((own == name, order, info.path, info.size))
        out = []
        for _, _, where, size in sorted(found, key=lambda f: (f[0], [str(x).zfill(20) for x in f[1]])):
            head = self._first_line(store, where)
            if head is not None:
                out.append((head, where, self._last_end(store, where, size)))
        return out

    def _first_line(self, store, path: str) -> str | None:
        """The hash of the first line's first bytes; None while there is no whole line."""
        with store.open_input_file(path) as f:
            head = f.read(HEAD)
        line, end, _ = head.partition(b"\n")
        return hashlib.sha256(line).hexdigest() if end or len(head) == HEAD else None

    def _last_end(self, store, path: str, size: int) -> int:
        """Where the last whole line ends: a line that is still being written is left for later."""
        with store.open_input_file(path) as f:
            end = size
            while end > 0:
                start = max(0, end - BLOCK)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def recent(self, events: int) -> dict:
        """Offsets from which the last ``events`` whole lines follow, over all generations."""
        store, _ = self._fs()
        offsets, left = {}, events
        for generation, path, end in reversed(self.generations()):
            at, stop = end, end
            with store.open_input_file(path) as f:
                while left > 0 and at > 0:
                    start = max(0, at - BLOCK)
                    f.seek(start)
                    block = f.read(at - start)
                    # each newline but the one that ends the last line starts a line after it
                    places = [start + m.start() + 1 for m in re.finditer(b"\n", block) if start + m.start() + 1 < end]
                    if len(places) >= left:
                        stop, left = places[-left], 0
                        break
                    left -= len(places)
                    stop = places[0] if places else stop
                    at = start
                else:
                    if left > 0 and end > 0:  # the first line of the file has no newline before it
                        stop, left = 0, left - 1
            offsets[generation] = stop
        return offsets

    def pieces(self, start: dict, end: dict) -> list[Piece]:
        where = {g: p for g, p, _ in self.generations()}
        return [Piece(where.get(g, ""), g, a, min(a + self.piece, to)) for g, to in end.items() for a in range(start.get(g, 0), to, self.piece)]

    def read(self, piece: Piece):
        store, _ = self._fs()
        path = piece.path
        if not path or self._first_line(store, path) != piece.generation:  # rotated since it was planned
            path = next((p for g, p, _ in self.generations() if g == piece.generation), None)
            if path is None:
                raise RuntimeError(f"generation {piece.generation} went before it was read")
        with store.open_input_file(path) as f:
            at = piece.start
            if at > 0:  # the line that holds the byte before belongs to the piece before
                f.seek(at - 1)
                at += len(self._line(f)) - 1
            f.seek(at)
            while at < piece.end:
                line = self._line(f)
                if not line.endswith(b"\n"):
                    break
                text = line[:-1].rstrip(b"\r")
                if text.strip():
                    yield (piece.generation, at, text.decode("utf-8", "replace") if len(text) <= self.most_line else None)
                at += len(line)

    def _line(self, f) -> bytes:
        """The next line. Of a line over the limit only its length is kept true, not its bytes."""
        out = bytearray()
        while True:
            here = f.tell()
            block = f.read(BLOCK if out else 8192)
            cut = block.find(b"\n")
            if cut >= 0:
                f.seek(here + cut + 1)
                return bytes(out + block[: cut + 1])
            if not block:
                return bytes(out)
            out += block


class JournalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.journal = Journal(options)

    def partitions(self):
        end = {g: e for g, _, e in self.journal.generations()}
        return self.journal.pieces({}, end)

    def read(self, partition):
        return self.journal.read(partition)


class JournalStream(DataSourceStreamReader):
    """Offsets are {generation: byte}. ``start`` is beginning, end or recent (the last ``recentEvents`` events).

    A batch takes at most ``bytesPerBatch`` bytes beyond what was handed out before, and a line at least. What was handed out
    is kept in the folder ``state``, so that a restarted stream goes on from there; without it a batch takes all there is.
    """

    def __init__(self, options: dict):
        self.journal = Journal(options)
        options = lowered(options)
        self.start = options.get("start", "beginning")
        self.events = int(options.get("recentevents", 256))
        self.most = int(options["bytesperbatch"]) if "bytesperbatch" in options else None
        self.state = options.get("state")
        if self.start not in ("beginning", "end", "recent"):
            raise ValueError(f"no start {self.start}")
        if self.most is not None and not self.state:
            raise ValueError("bytesPerBatch needs a state folder")
        self.told: dict | None = None

    def initialOffset(self) -> dict:
        if self.start == "beginning":
            return {}
        return {g: e for g, _, e in self.journal.generations()} if self.start == "end" else self.journal.recent(self.events)

    def _held(self) -> dict | None:
        store, path = pafs.FileSystem.from_uri(self.state) if "://" in self.state else (pafs.LocalFileSystem(), self.state)
        if store.get_file_info(f"{path}/offset.json").type == pafs.FileType.NotFound:
            return None
        with store.open_input_stream(f"{path}/offset.json") as f:
            return json.loads(f.read())

    def _hold(self, offset: dict) -> None:
        store, path = pafs.FileSystem.from_uri(self.state) if "://" in self.state else (pafs.LocalFileSystem(), self.state)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/offset.new") as f:
            f.write(json.dumps(offset).encode())
        store.move(f"{path}/offset.new", f"{path}/offset.json")

    def latestOffset(self) -> dict:
        if self.most is None:
            return {g: e for g, _, e in self.journal.generations()}
        if self.told is None:
            held = self._held()
            self.told = self.initialOffset() if held is None else held
        left, out = self.most, {}
        for generation, path, end in self.journal.generations():
            at = self.told.get(generation, 0)
            take = end if end - at <= left else self._line_end(path, at, left)
            left = max(0, left - (take - at))
            out[generation] = max(at, take)
        self._hold(out)
        self.told = out
        return out

    def _line_end(self, path: str, at: int, most: int) -> int:
        """The last line's end within ``most`` bytes of ``at``; the first line's end if none is, and ``at`` if nothing may be taken."""
        if most <= 0:
            return at
        store, _ = self.journal._fs()
        with store.open_input_file(path) as f:
            f.seek(at)
            cut = f.read(most).rfind(b"\n")
            if cut >= 0:
                return at + cut + 1
            if most < self.most:
                return at  # something was taken already; the long line is the next batch's
            f.seek(at)
            return at + len(self.journal._line(f))

    def partitions(self, start: dict, end: dict):
        return self.journal.pieces(start, end)

    def read(self, partition):
        return self.journal.read(partition)

    def commit(self, end: dict) -> None:
        pass


class JournalSource(DataSource):
    """``spark.read.format("session_journal")`` and ``readStream``: generation, offset and value of every line. Lines over ``mostLineBytes`` come with a null value."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return JournalReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return JournalStream(dict(self.options))
