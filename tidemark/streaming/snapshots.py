"""Versions of an index: a list of its files that is replaced atomically, and that readers pin.

Files are folders of Parquet, <folder>/<table>/file=<name>/recording_id=<id>, written before they are listed and deleted
after no version that anyone reads lists them, so at any time the index is what its last list says: a crash between any
two steps leaves files that no list names, which go when the folder is opened. What a batch wrote is listed under its
stream and number; listing the same batch again replaces it. An entry holds its recordings with the bounds of their
messages on both clocks, so readers open only what a window may need.

Entries of one level are merged, MERGE at a time, into one of the next level, and only those of batches that won't be
repeated: a message is rewritten once for each level, of which there are log(batches).
"""

from __future__ import annotations

import json
import os
import re
import shutil
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MERGE = 16
#: Bytes of a recording that a task merges.
PART = 1 << 28


@dataclass(frozen=True)
class Entry:
    table: str
    file: str
    stream: str
    batch: int
    level: int = 0
    #: By recording: [log min, log max, publish min, publish max], or an empty list where no message is.
    recordings: dict[str, list[int]] = field(default_factory=dict)


def overlaps(bounds: list[int], clock: int, start: int, end: int) -> bool:
    """Whether bounds on a clock (0 log, 2 publish) touch an inclusive range; unknown ones do."""
    return not bounds or bounds[clock + 1] >= start and bounds[clock] <= end


def joined(a: list[int], b: list[int]) -> list[int]:
    return a and b and [min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])]


class Snapshots:
    def __init__(self, folder: str, schemas: dict[str, T.StructType]):
        self.folder, self.schemas = folder, schemas
        self.lock = threading.RLock()
        self.pins: Counter[int] = Counter()
        self.versions: dict[int, list[Entry]] = {}
        os.makedirs(folder, exist_ok=True)
        self.version, self.entries = self._load()
        #: Files and their recordings that a list named or that were found: what may have to be deleted.
        self.listed = self._found()
        self.vacuum()

    def _lists(self) -> list[int]:
        return sorted(int(m[1]) for n in os.listdir(self.folder) if (m := re.fullmatch(r"list-(\d+)\.json", n)))

    def _load(self) -> tuple[int, list[Entry]]:
        if not (found := self._lists()):
            return 0, []
        with open(os.path.join(self.folder, f"list-{found[-1]}.json")) as f:
            return found[-1], [Entry(**x) for x in json.load(f)]

    def _commit(self, entries: list[Entry]) -> None:
        """Makes a list the last one: it is there in whole, or not at all."""
        path = os.path.join(self.folder, f"list-{self.version + 1}.json")
        with open(path + ".new", "w") as f:
            json.dump([asdict(e) for e in entries], f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(path + ".new", path)
        if self.pins[self.version]:
            self.versions[self.version] = self.entries
        self.version, self.entries = self.version + 1, entries

    def _place(self, e: Entry) -> str:
        return os.path.join(self.folder, e.table, f"file={e.file}")

    def write(self, table: str, rows: DataFrame) -> str:
        """Writes rows, which have a recording_id, and returns the name of the file; no list names it yet."""
        name = uuid.uuid4().hex
        rows.select(*self.schemas[table].names).write.partitionBy("recording_id").parquet(os.path.join(self.folder, table, f"file={name}"))
        return name

    def add(self, stream: str, batch: int, files: dict[str, tuple[str, dict[str, list[int]]]]) -> None:
        """Lists a batch's files, (name, recordings) by table, in place of what the same batch listed before."""
        with self.lock:
            others = [e for e in self.entries if (e.stream, e.batch) != (stream, batch)]
            self._commit(others + [Entry(t, name, stream, batch, 0, recordings) for t, (name, recordings) in files.items()])
            self.vacuum()

    def prune(self, gone: list[str]) -> None:
        """Takes recordings off the list."""
        with self.lock:
            if any(r in e.recordings for e in self.entries for r in gone):
                left = [replace(e, recordings={r: b for r, b in e.recordings.items() if r not in gone}) for e in self.entries]
                self._commit([e for e in left if e.recordings])
                self.vacuum()

    @contextmanager
    def pinned(self) -> Iterator[list[Entry]]:
        """The entries of the last list, whose files stay until this ends."""
        with self.lock:
            version, entries = self.version, self.entries
            self.pins[version] += 1
        try:
            yield entries
        finally:
            with self.lock:
                self.pins[version] -= 1
                if not self.pins[version]:
                    del self.pins[version]
                    self.versions.pop(version, None)
                self.vacuum()

    def read(self, spark: SparkSession, table: str, entries: list[Entry], wanted: Callable[[str, list[int]], bool] = lambda *_: True) -> DataFrame:
        """The rows of a table in pinned entries, of the recordings (with their bounds there) that are wanted."""
        paths = [os.path.join(self._place(e), f"recording_id={r}") for e in entries if e.table == table for r, b in e.recordings.items() if wanted(r, b)]
        schema = self.schemas[table]
        if not paths:
            return spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField("file", T.StringType())])
        return spark.read.schema(whole).option("basePath", os.path.join(self.folder, table)).parquet(*paths).select(*schema.names)

    def merge(self, spark: SparkSession, stream: str, until: int) -> None:
        """Merges files of one table and level, MERGE at a time, of batches up to `until`."""
        with self.pinned() as entries:
            runs: dict[tuple[str, int], list[Entry]] = {}
            for e in entries:
                if e.stream == stream and e.batch <= until:
                    runs.setdefault((e.table, e.level), []).append(e)
            for (table, level), old in runs.items():
                if len(old) < MERGE:
                    continue
                name = self.write(table, self.read(spark, table, old).repartition("recording_id", F.call_function("div", F.col("offset"), F.lit(PART))))
                with self.lock:  # a recording that was pruned meanwhile stays out
                    left = {e.file: e for e in self.entries}
                    recordings: dict[str, list[int]] = {}
                    for e in (left[o.file] for o in old if o.file in left):
                        for r, b in e.recordings.items():
                            recordings[r] = joined(recordings[r], b) if r in recordings else b
                    files = {o.file for o in old}
                    one = [Entry(table, name, stream, old[-1].batch, level + 1, recordings)] if recordings else []
                    self._commit([e for e in self.entries if e.file not in files] + one)

    def vacuum(self) -> None:
        """Deletes what neither the last list nor one that is being read names any more, older lists too."""
        with self.lock:
            keep: dict[tuple[str, str], set[str]] = {}
            for entries in [self.entries, *(e for v, e in self.versions.items() if self.pins[v])]:
                for e in entries:
                    keep.setdefault((e.table, e.file), set()).update(e.recordings)
            before, self.listed = self.listed, keep
            for (table, file), recordings in before.items():
                self._delete(table, file, recordings - keep.get((table, file), set()), (table, file) not in keep)
            for v in self._lists():
                if v < self.version:
                    os.unlink(os.path.join(self.folder, f"list-{v}.json"))

    def _delete(self, table: str, file: str, recordings: set[str], whole: bool) -> None:
        place = os.path.join(self.folder, table, f"file={file}")
        for where in [place] if whole else [os.path.join(place, f"recording_id={r}") for r in recordings]:
            shutil.rmtree(where, ignore_errors=True)

    def _found(self) -> dict[tuple[str, str], set[str]]:
        """What there is on disk, whether or not a list names it."""
        out = {}
        for table in self.schemas:
            where = os.path.join(self.folder, table)
            for name in os.listdir(where) if os.path.isdir(where) else []:
                out[table, name.removeprefix("file=")] = {n.removeprefix("recording_id=") for n in os.listdir(os.path.join(where, name)) if n.startswith("recording_id=")}
        return out
