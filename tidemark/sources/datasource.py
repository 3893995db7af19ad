"""MCAP as a Spark data source: batch and streaming reads, and a writer that publishes clips atomically.

Read options: path (a folder or file that every node reaches), table (messages, channels, schemas, records, or all, the
union of the four with a kind column), with_payload (default true), ranges (JSON list of [recording_id, path, start, end]:
byte ranges on record boundaries, such as planned extents; only these are read, and a range whose records don't end
where it does is an error), split_bytes (default 128 MB). A finished file's list of chunks tells where it can be cut
into partitions of about that size; any other is one partition, scanned in order, which recorders bound by rolling their
files over; a fault in the framing ends its partition. Filters on log_ns and publish_ns are pushed down. Streaming offsets hold the files on disk in the order of their
discovery and the end of each one's last complete record; a later file is only begun once the earlier ones are read. A
recording's number is given once and never again: a file that is gone leaves the offsets, and another one that gets its
inode is told from it, if not by its absence in between, by its size or its first bytes. With the option `state`, a path,
the numbers outlive a restart on any set of files; without it they are given anew then, to the files there are.

Written rows: trigger_id, segment_no, filename, topic, message_encoding, metadata, schema, sequence, log_ns, publish_ns,
payload, dealt by clip and in file order (`clip_rows` does that); a row without a topic makes an empty clip. Options:
path, compression (none, lz4, zstd), chunk_bytes, cut (a name of this write, by which `finish` ends what a crash cut off).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark import on_workers
from tidemark.model import CLOCKS, CODECS, LONG_MAX, MESSAGES
from tidemark.sources import files, mcap

_LONG, _INT, _TEXT, _BYTES = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()
_PLACE = [("recording_id", _LONG), ("offset", _LONG), ("chunk_offset", _LONG), ("inner_seq", _INT)]
_FIELDS = {
    "messages": [(f.name, f.dataType) for f in MESSAGES],
    "channels": [*_PLACE, ("channel_id", _INT), ("schema_id", _INT), ("topic", _TEXT), ("message_encoding", _TEXT), ("metadata", T.MapType(_TEXT, _TEXT))],
    "schemas": [*_PLACE, ("schema_id", _INT), ("name", _TEXT), ("encoding", _TEXT), ("data", _BYTES)],
    "records": [("recording_id", _LONG), ("offset", _LONG), ("len", _LONG), ("opcode", _INT), ("log_min", _LONG), ("log_max", _LONG), ("publish_min", _LONG), ("publish_max", _LONG), ("damaged", T.BooleanType())],
}
_FIELDS["all"] = [("kind", _TEXT), ("path", _TEXT), *dict(x for t in ("messages", "channels", "schemas", "records") for x in _FIELDS[t]).items()]
TABLES = {k: T.StructType([T.StructField(n, t) for n, t in v]) for k, v in _FIELDS.items()}
ROWS = 4096
#: Bytes of a finished recording that a task reads, about.
SPLIT = 128 << 20
#: Consecutive scans that meet a fault without progress, after which the stream fails.
FAULTS = 5


@dataclass
class Part(InputPartition):
    recording_id: int
    path: str
    start: int
    end: int | None
    strict: bool = False
    head: list[int] | None = None


def _reader(path: str):
    fd = os.open(path, os.O_RDONLY)
    return fd, lambda at, n: os.pread(fd, n, at)


def rows(part: Part, table: str, with_payload: bool, near: dict[str, tuple[int, int]] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a part of a file. A fault in the framing ends the file there: what stands before it is kept.

    near: ranges by clock outside which messages needn't be given.
    """
    schema = to_arrow_schema(TABLES[table])
    wanted = None if table == "all" else table.removesuffix("s")
    fd, read_at = _reader(part.path)
    try:
        held: list[dict] = []
        size = 0
        state = mcap.Scan(part.start)
        for item in mcap.scan(read_at, os.fstat(fd).st_size, state, end=part.end, with_payload=with_payload, near=near):
            if wanted and item.kind != wanted:
                continue
            values = item.values | {"recording_id": part.recording_id, "offset": item.offset, "kind": item.kind, "path": part.path}
            if "metadata" in values:
                values["metadata"] = list(values["metadata"].items())
            held.append({n: values.get(n) for n in schema.names})
            size += item.values.get("size") or 0
            if len(held) >= ROWS or size >= mcap.READ:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if part.strict and state.offset != part.end:
            raise state.fault or mcap.Fault(state.offset, f"a range to {part.end} doesn't end with a record")
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
    finally:
        os.close(fd)


def merged(ranges: list[list]) -> list[list]:
    """Ranges [recording_id, path, start, end], each byte once: those that overlap or touch are one."""
    out: list[list] = []
    for r, path, start, end in sorted(map(tuple, ranges)):
        if out and out[-1][:2] == [r, path] and start <= out[-1][3]:
            out[-1][3] = max(out[-1][3], end)
        else:
            out.append([r, path, start, end])
    return out


def split(index: list[tuple[int, int, int, int]], end: int, size: int, near: tuple[int, int] | None) -> list[tuple[int, int]]:
    """Ranges of a file's bytes, cut at chunks where they reach `size`; chunks with no time in `near` are left out."""
    out, start = [], len(mcap.MAGIC)
    for offset, length, first, last in index:
        if near and (first or last) and (last < near[0] or first > near[1]):
            if offset > start:
                out.append((start, offset))
            start = offset + length
        elif offset - start >= size:
            out.append((start, offset))
            start = offset
    return out + ([(start, end)] if end > start else [])


class _Batch(DataSourceReader):
    """Batch reads. Comparisons of log_ns and publish_ns reach the scan: by a finished file's list of chunks whole ranges
    aren't planned, and tasks pass over other messages and chunks by their first bytes. Spark still tests every row.
    """

    def __init__(self, options: dict):
        self.path, self.table, self.with_payload = options["path"], options.get("table", "messages"), options.get("with_payload", "true") == "true"
        self.ranges = json.loads(options["ranges"]) if "ranges" in options else None
        self.split = int(options.get("split_bytes", SPLIT))
        self.near: dict[str, tuple[int, int]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            clock = f.attribute[0].removesuffix("_ns") if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else None
            if clock in CLOCKS and self.table == "messages" and isinstance(f.value, int):
                low, high = self.near.get(clock, (-LONG_MAX - 1, LONG_MAX))
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = min(high, f.value - isinstance(f, LessThan))
                self.near[clock] = low, high
            yield f

    def partitions(self) -> list[Part]:
        if self.ranges is not None:
            return [Part(*r, strict=True) for r in merged(self.ranges)] or [Part(0, os.devnull, 0, 0)]
        parts = []
        for k, f in enumerate(files.listed(self.path)):
            fd, read_at = _reader(f.path)
            try:
                size = os.fstat(fd).st_size
                index = mcap.chunk_index(read_at, size) if size > self.split or self.near else []
            finally:
                os.close(fd)
            parts += [Part(k, f.path, a, b if b < size else None) for a, b in split(index, size, self.split, self.near.get("log"))] if index else [Part(k, f.path, len(mcap.MAGIC), None)]
        return parts or [Part(0, os.devnull, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return rows(partition, self.table, self.with_payload, self.near or None)


@dataclass
class Known:
    """A recording that a stream knows. head: how many of its first bytes were seen, and their checksum."""

    recording_id: int
    path: str
    device: int
    inode: int
    at: int = len(mcap.MAGIC)
    ended: bool = False
    head: list[int] = field(default_factory=lambda: [0, 0])

    def is_other(self, f: files.Found) -> bool:
        """Whether the file with this identity is another one, which was given the inode of one that is gone."""
        try:
            return f.size < max(self.at if self.at > len(mcap.MAGIC) else 0, self.head[0]) or files.head(f.path, self.head[0]) != self.head
        except FileNotFoundError:
            return True


class _Stream(DataSourceStreamReader):
    """Offsets: the next recording's number and the known files in the order of discovery, as JSON text."""

    def __init__(self, options: dict):
        self.path, self.table, self.with_payload = options["path"], options.get("table", "all"), options.get("with_payload", "true") == "true"
        self.from_start = options.get("startingOffsets", "earliest") == "earliest"
        self.state = options.get("state")
        self.known: list[Known] | None = None
        self.next = 0
        #: Path and change time at which a file's first bytes were last looked at, by recording.
        self.looked: dict[int, tuple] = {}
        self.faults: dict[int, tuple[int, float]] = {}

    @staticmethod
    def _read(offset: dict) -> list[Known]:
        return [Known(**x) for x in json.loads(offset["files"])]

    def _offset(self) -> dict:
        return {"next": self.next, "files": json.dumps([asdict(x) for x in self.known or []])}

    def _take(self, offset: dict) -> None:
        self.next, self.known = int(offset["next"]), self._read(offset)

    def initialOffset(self) -> dict:
        """Nothing read yet; unless reading from the start, files older than the newest count as ended."""
        self.next, self.known = 0, []
        self._meet(files.listed(self.path))
        if self.from_start:
            self.next, self.known = 0, []
        else:
            self.known = [replace(x, ended=True) for x in self.known[:-1]]
            self.next = len(self.known)
        return self._offset()

    def _meet(self, found: list[files.Found]) -> None:
        """Forgets the files that are gone, follows renamed ones and takes up new ones, the oldest first."""
        there = {f.identity: f for f in found}
        kept = []
        for x in self.known or []:
            if (f := there.get((x.device, x.inode))) is None:
                continue
            if self.looked.get(x.recording_id) != (f.path, f.ctime_ns):
                if x.is_other(f):
                    continue
                x.path = f.path
                self.looked[x.recording_id] = (f.path, f.ctime_ns)
            kept.append(x)
        mine = {(x.device, x.inode) for x in kept}
        for f in found:
            if f.identity not in mine:
                kept.append(Known(self.next, f.path, *f.identity))
                self.next += 1
        self.known = kept
        ids = {x.recording_id for x in kept}
        self.looked = {k: v for k, v in self.looked.items() if k in ids}
        self.faults = {k: v for k, v in self.faults.items() if k in ids}

    def latestOffset(self) -> dict:
        if self.known is None and self.state and (saved := _lines(self.state)):
            self._take(saved[0])
        before = self._offset()
        self._meet(files.listed(self.path))
        for k, x in enumerate(self.known):
            if x.ended:
                continue
            if time.monotonic() < self.faults.get(x.recording_id, (0, 0.0))[1]:
                break
            try:
                fd, read_at = _reader(x.path)
            except FileNotFoundError:  # it leaves with the next look
                continue
            try:
                state = mcap.Scan(x.at)
                mcap.frames(read_at, os.fstat(fd).st_size, state)  # headers only: the tasks read the bodies
                if x.head[0] < files.HEAD:
                    x.head = files.head(x.path)
            finally:
                os.close(fd)
            if state.fault is None or state.offset > x.at:
                self.faults.pop(x.recording_id, None)
            if state.fault is not None:
                n = self.faults.get(x.recording_id, (0, 0.0))[0] + 1
                if n >= FAULTS:
                    raise state.fault
                self.faults[x.recording_id] = (n, time.monotonic() + min(0.2 * 2 ** (n - 1), 3.2))
            # a file ends at its end of data, or when a newer one is there and it grows no more
            x.ended = state.ended or state.offset == x.at and k + 1 < len(self.known)
            x.at = state.offset
            if not x.ended:
                break  # strictly one after the other
        now = self._offset()
        if self.state and now != before:
            _durable(self.state, [now])
        return now

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before = {x.recording_id: x.at for x in self._read(start)}
        if self.known is None:
            self._take(end)
        parts = []
        for x in self._read(end):
            from_ = before.get(x.recording_id, len(mcap.MAGIC))
            if x.at > from_:
                parts.append(Part(x.recording_id, x.path, from_, x.at, head=x.head))
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """The rows of a part; none if its recording is gone or another file stands in its place, as it can't be read again."""
        try:
            if files.head(partition.path, partition.head[0]) != partition.head:
                return
            yield from rows(partition, self.table, self.with_payload)
        except FileNotFoundError:
            return

    def commit(self, end: dict) -> None:
        pass


CLIP = T.StructType([
    T.StructField("trigger_id", _LONG), T.StructField("segment_no", _INT), T.StructField("filename", _TEXT), T.StructField("topic", _TEXT), T.StructField("message_encoding", _TEXT),
    T.StructField("metadata", T.MapType(_TEXT, _TEXT)), T.StructField("schema", T.StructType([T.StructField("name", _TEXT), T.StructField("encoding", _TEXT), T.StructField("data", _BYTES)])),
    T.StructField("sequence", _LONG), T.StructField("log_ns", _LONG), T.StructField("publish_ns", _LONG), T.StructField("payload", _BYTES),
])
STAGING = ".staging"
MOST_SUFFIXES = 1000


@dataclass
class Staged(WriterCommitMessage):
    clips: list[dict]


def publish(staged: str, folder: str, name: str, inode: int | None = None) -> str:
    """Links a staged clip under its name, or with the first free suffix, and never over another file.

    inode: the staged file's; a name that it has already is the clip's, whether or not it is still staged.
    """
    stem, extension = os.path.splitext(name)
    inode = os.stat(staged).st_ino if inode is None else inode
    for k in range(MOST_SUFFIXES + 1):
        final = os.path.join(folder, name if not k else f"{stem}_{k}{extension}")
        try:
            os.link(staged, final)
        except (FileExistsError, FileNotFoundError):
            if not os.path.exists(final) or os.stat(final).st_ino != inode:
                continue
        if os.path.exists(staged):
            os.unlink(staged)
        fd = os.open(folder, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)
        return final
    raise FileExistsError(f"{name}: {MOST_SUFFIXES} names are taken")


def _durable(path: str, lines: list[dict]) -> None:
    """Writes lines of JSON under a path that either has all of them or isn't there."""
    with open(path + ".new", "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in lines)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".new", path)


def _lines(path: str) -> list[dict] | None:
    try:
        with open(path) as f:
            return [json.loads(x) for x in f]
    except FileNotFoundError:
        return None


def finish(folder: str, cut: str) -> list[dict] | None:
    """Publishes what a write has staged and planned, each clip once however often this runs, and returns its clips.

    None: the write never came to its plan, so nothing of it is or will be visible.
    """
    plan, published = (os.path.join(folder, f".{kind}-{cut}.jsonl") for kind in ("plan", "published"))
    if (done := _lines(published)) is None:
        if (done := _lines(plan)) is None:
            return None
        for c in done:
            c["path"] = publish(c["staged"], folder, c["name"], c["inode"])
        _durable(published, done)
    if os.path.exists(plan):
        os.unlink(plan)
    return done


def forget(folder: str, cut: str) -> None:
    """Deletes the list of a write's clips."""
    if os.path.exists(path := os.path.join(folder, f".published-{cut}.jsonl")):
        os.unlink(path)


def reset_staging(folder: str) -> None:
    """Empties the staging folder, as nothing in it outlives a run."""
    staging = os.path.join(folder, STAGING)
    os.makedirs(staging, exist_ok=True)
    for name in os.listdir(staging):
        os.unlink(os.path.join(staging, name))


class _Clips(DataSourceArrowWriter):
    """Each task stages its clips; the driver publishes them when all are durable. Failed tasks' files are removed."""

    def __init__(self, options: dict):
        self.folder, self.codec, self.chunk = options["path"], CODECS[options.get("compression", "zstd")], int(options.get("chunk_bytes", 1 << 20))
        self.cut = options.get("cut") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        staging = os.path.join(self.folder, STAGING)
        os.makedirs(staging, exist_ok=True)
        clips: list[dict] = []
        key, writer, out, clip, known = None, None, None, {}, {}

        def close() -> None:
            if writer:
                writer.close()
                out.flush()
                os.fsync(out.fileno())
                out.close()

        try:
            for batch in iterator:
                c = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
                for trigger, segment, name, topic, encoding, metadata, schema, sequence, log_ns, publish_ns, payload in zip(*(c[f.name] for f in CLIP), strict=True):
                    if (trigger, segment) != key:
                        close()
                        key, known = (trigger, segment), {}
                        clips.append({"trigger_id": trigger, "segment_no": segment, "name": name, "staged": os.path.join(staging, uuid.uuid4().hex), "messages": 0, "bytes": 0})
                        clip = clips[-1]
                        out = open(clip["staged"], "xb")  # noqa: SIM115
                        writer = mcap.Writer(out, self.codec, self.chunk)
                    if topic is None:
                        continue
                    if metadata or schema:
                        channel = writer.channel(topic, encoding or "", dict(metadata or []), schema and (schema["name"], schema["encoding"], schema["data"] or b""))
                    elif (channel := known.get((topic, encoding))) is None:
                        channel = known[topic, encoding] = writer.channel(topic, encoding or "")
                    payload = payload or b""
                    writer.add(channel, sequence or 0, log_ns, publish_ns, payload)
                    clip["messages"] += 1
                    clip["bytes"] += len(payload)
            close()
        except BaseException:
            for c in clips:
                if os.path.exists(c["staged"]):
                    os.unlink(c["staged"])
            raise
        return Staged(clips)

    def commit(self, messages: list[Staged | None]) -> None:
        clips = sorted((c for m in messages if m for c in m.clips), key=lambda c: (c["trigger_id"], c["segment_no"]))
        _durable(os.path.join(self.folder, f".plan-{self.cut}.jsonl"), [c | {"inode": os.stat(c["staged"]).st_ino} for c in clips])
        finish(self.folder, self.cut)

    def abort(self, messages: list[Staged | None]) -> None:
        for c in (c for m in messages if m for c in m.clips):
            if os.path.exists(c["staged"]):
                os.unlink(c["staged"])


class McapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mcap"

    def schema(self) -> T.StructType:
        return TABLES[self.options.get("table", "messages")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Clips(dict(self.options))


def register(spark: SparkSession) -> None:
    on_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(McapSource)


def read(spark: SparkSession, path: str, table: str = "messages", with_payload: bool = True, ranges: list[list] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("mcap").option("path", path).option("table", table).option("with_payload", str(with_payload).lower())
    return (reader if ranges is None else reader.option("ranges", json.dumps(ranges))).load()


def read_planned(spark: SparkSession, path: str, planned: DataFrame, table: str = "messages") -> DataFrame:
    """Reads only the planned extents (recording_id, offset, len) of the recordings of a folder, whose order numbers them.

    The plan of a cut is a list of byte ranges, a few for each window; it reaches the driver as such.
    """
    paths = [f.path for f in files.listed(path)]
    ranges = [[r["recording_id"], paths[r["recording_id"]], r["offset"], r["offset"] + r["len"]] for r in planned.select("recording_id", "offset", "len").distinct().toLocalIterator()]
    return read(spark, path, table, ranges=ranges)


def clip_rows(clips: DataFrame, parallelism: int = 0) -> DataFrame:
    """Rows for the writer, dealt by clip and in file order. clips has CLIP's columns, recording_id, offset and inner_seq.

    parallelism: how many tasks write clips; 0 leaves it to Spark.
    """
    dealt = clips.repartition(*([parallelism] if parallelism else []), "trigger_id", "segment_no").sortWithinPartitions("trigger_id", "segment_no", "recording_id", "offset", "inner_seq")
    return dealt.select(*[F.col(f.name).cast(f.dataType) for f in CLIP])


def write_clips(clips: DataFrame, folder: str, compression: str = "zstd", *, cut: str | None = None, parallelism: int = 0) -> list[dict]:
    """Writes and publishes clips; returns a record (trigger_id, segment_no, path, messages, bytes) of each.

    cut: a name for this write, whose list of clips then stays until `forget`.
    """
    spark = clips.sparkSession
    register(spark)
    os.makedirs(folder, exist_ok=True)
    name = cut or uuid.uuid4().hex
    clip_rows(clips, parallelism).write.format("mcap").option("path", folder).option("compression", compression).option("cut", name).mode("append").save()
    done = finish(folder, name) or []
    if cut is None:
        forget(folder, name)
    return done
