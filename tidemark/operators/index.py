"""The index over recordings: extents with time bounds, bounds and high-water marks, channels and their schemas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.model import EXTENT_BYTES, EXTENTS, LONG_MAX
from tidemark.operators.windows import overlapping
from tidemark.sources.mcap import CHUNK as CHUNK_RECORD
from tidemark.sources.mcap import MESSAGE

#: Width in offsets of a chunk of arrivals in a running maximum.
CHUNK = 1 << 20
#: Bytes of a part of a recording, whose extents a task finds.
PART = 64 << 20


def _part(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part of a recording as a function of the bytes that the open extent holds before it.

    Returns the bytes up to the end of each record, the record that next closes an extent after one is closed at each
    (len(sizes): none), and the last that does, by pointer jumping.
    """
    ends = np.cumsum(sizes)
    after = np.searchsorted(ends, ends + limit)
    n = len(ends)
    last = np.where(after < n, after, np.arange(n))
    while True:
        jumped = last[last]
        if (jumped == last).all():
            return ends, after, last
        last = jumped


_TABLE = T.StructType([T.StructField("recording_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("total", T.LongType()), T.StructField("closes", T.ArrayType(T.LongType())), T.StructField("left", T.ArrayType(T.LongType()))])
_ENTRY = T.StructType([T.StructField("recording_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("held", T.LongType())])
_PIECE = T.StructType([
    T.StructField("recording_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("k", T.LongType()), T.StructField("begins", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("len", T.LongType()),
    T.StructField("records", T.LongType()), *[T.StructField(f"{c}_{e}", T.LongType()) for c in ("log", "publish") for e in ("min", "max")],
])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part of a recording, of batches sorted by both."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if held and batch.num_rows and (held[-1].column(0)[-1], held[-1].column(1)[-1]) != (batch.column(0)[0], batch.column(1)[0]):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def extents(records: DataFrame, *, limit: int = EXTENT_BYTES, part: int = PART) -> DataFrame:
    """Extents of each recording: records in file order, closed once they hold `limit` bytes; they tile the file.

    records: recording_id, offset (bytes), len (with its header) and log_ns, publish_ns, or for chunks log_min, log_max,
    publish_min, publish_max (null where a record has no times).

    Where an extent ends depends on where the one before did, but a recording isn't one task. It is cut into parts of
    `part` bytes, and each part tells, from its own records, what the open extent holds after it for whatever it may hold
    before: a table over the records of the part's first `limit` bytes, of which one is the first to close an extent.
    The tables, a row for each part, are followed in order; then every part knows its beginning, and extents that lie in
    several parts are summed up from their pieces.
    """
    one = "log_min" not in records.columns
    clocks = [F.col(f"{c}_ns" if one else f"{c}_{end}").alias(f"{c}_{end}") for c in ("log", "publish") for end in ("min", "max")]
    parted = records.select("recording_id", F.call_function("div", F.col("offset"), F.lit(part)).alias("part"), "offset", "len", *clocks)
    in_order = lambda df: df.repartition("recording_id", "part").sortWithinPartitions("recording_id", "part", "offset")

    def tabled(batches):
        for t in _parts(batches):
            ends, _, last = _part(t.column("len").to_numpy(), limit)
            m = min(int(np.searchsorted(ends, limit)) + 1, len(ends))
            row = [t.column(0)[0], t.column(1)[0], int(ends[-1]), ends[:m], ends[-1] - ends[last[:m]]]
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() if k < 2 else x], type=to_arrow_type(f.dataType)) for k, (x, f) in enumerate(zip(row, _TABLE, strict=True))], names=_TABLE.names)

    def followed(batches):
        recording, held = None, 0
        for b in batches:
            out = []
            for r, p, total, closes, left in zip(*(b.column(k) for k in range(5)), strict=True):
                if r != recording:
                    recording, held = r, 0
                out.append((r.as_py(), p.as_py(), held))
                closes, left = closes.values.to_numpy(), left.values.to_numpy()
                k = int(np.searchsorted(closes, limit - held))
                held = int(left[k]) if k < len(closes) else held + total.as_py()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=_ENTRY.names)

    def cut(batches):
        for t in _parts(batches):
            sizes, offset = t.column("len").to_numpy(), t.column("offset").to_numpy()
            ends, after, _ = _part(sizes, limit)
            held, n = t.column("held")[0].as_py(), len(sizes)
            starts, k = [0], int(np.searchsorted(ends, limit - held))
            while k + 1 < n:
                starts.append(k + 1)
                k = int(after[k])
            starts = np.array(starts)
            begins = np.ones(len(starts), np.int64)
            begins[0] = held == 0
            columns = [np.full(len(starts), t.column(c)[0].as_py()) for c in (0, 1)] + [np.arange(len(starts)), begins, offset[starts], np.add.reduceat(sizes, starts), np.diff(np.append(starts, n))]
            made = [pa.array(c, pa.int64()) for c in columns]
            for name in _PIECE.names[7:]:
                values, none = t.column(name).combine_chunks(), LONG_MAX if name.endswith("min") else -LONG_MAX - 1
                least = (np.minimum if name.endswith("min") else np.maximum).reduceat(values.fill_null(none).to_numpy(zero_copy_only=False), starts)
                some = np.logical_or.reduceat(values.is_valid().to_numpy(zero_copy_only=False), starts)
                made.append(pa.array(least, pa.int64(), mask=~some))
            yield pa.RecordBatch.from_arrays(made, names=_PIECE.names)

    tables = in_order(parted).mapInArrow(tabled, _TABLE)
    entries = tables.repartition("recording_id").sortWithinPartitions("recording_id", "part").mapInArrow(followed, _ENTRY)
    pieces = in_order(parted.join(entries, ["recording_id", "part"])).mapInArrow(cut, _PIECE)
    number = F.sum("begins").over(Window.partitionBy("recording_id").orderBy("part", "k")) - 1
    span = lambda c: F.when(F.min(f"{c}_min").isNotNull(), F.struct(F.min(f"{c}_min").alias("min"), F.max(f"{c}_max").alias("max"))).alias(c)
    whole = pieces.withColumn("extent_no", number.cast("int")).groupBy("recording_id", "extent_no").agg(F.min("offset").alias("offset"), F.sum("len").alias("len"), F.sum("records").alias("records"), span("log"), span("publish"))
    return whole.select(*[F.col(f.name).cast(f.dataType) for f in EXTENTS])


def planned(windows: DataFrame, extent_index: DataFrame, *, clock: str = "log") -> DataFrame:
    """Pairs of windows and the extents that may hold their messages."""
    ranges = extent_index.select("recording_id", "extent_no", "offset", "len", F.col(f"{clock}.min").alias("min_ns"), F.col(f"{clock}.max").alias("max_ns"))
    return overlapping(windows, ranges, ["recording_id", "extent_no", "offset", "len"])


def clip_stats(windows: DataFrame, found: DataFrame, plan: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """A row per window: extents_read, messages_copied, bytes_copied, records_skipped and chunks_dropped.

    found: the windows' messages with their topics (null where the channel is unknown: those are skipped); plan: the
    planned extents; damaged: (recording_id, offset, opcode) of records that can't be read. Of those in planned extents
    chunks are dropped and messages skipped; a definition is neither.
    """
    known = F.col("topic").isNotNull()
    copied = found.groupBy("trigger_id").agg(F.count_if(known).alias("messages_copied"), F.sum(F.when(known, F.col("size")).otherwise(0)).alias("bytes_copied"), F.count_if(~known).alias("unknown"))
    read = plan.groupBy("trigger_id").agg(F.count("*").alias("extents_read"))
    out = windows.select("trigger_id").join(read, "trigger_id", "left").join(copied, "trigger_id", "left")
    if damaged is None:
        lost = windows.select("trigger_id", F.lit(0).cast("long").alias("runts"), F.lit(0).cast("long").alias("chunks_dropped"))
    else:
        bad = damaged.select("recording_id", F.col("offset").alias("at"), "opcode", F.call_function("div", F.col("offset"), F.lit(EXTENT_BYTES)).alias("place"))
        places = F.explode(F.sequence(F.call_function("div", F.col("offset"), F.lit(EXTENT_BYTES)), F.call_function("div", F.col("offset") + F.col("len") - 1, F.lit(EXTENT_BYTES))))
        inside = plan.select("trigger_id", "recording_id", "offset", "len", places.alias("place")).join(bad, ["recording_id", "place"]).filter((F.col("at") >= F.col("offset")) & (F.col("at") < F.col("offset") + F.col("len")))
        lost = inside.groupBy("trigger_id").agg(F.count_if(F.col("opcode") == MESSAGE).alias("runts"), F.count_if(F.col("opcode") == CHUNK_RECORD).alias("chunks_dropped"))
    counted = out.join(lost, "trigger_id", "left").na.fill(0)
    return counted.select("trigger_id", "extents_read", "messages_copied", "bytes_copied", (F.col("unknown") + F.col("runts")).alias("records_skipped"), "chunks_dropped")


def bounds(messages: DataFrame) -> DataFrame:
    """Counts and both clocks' bounds of each recording that has messages."""
    return messages.groupBy("recording_id").agg(F.count("*").alias("messages"), F.min("log_ns").alias("log_min"), F.max("log_ns").alias("log_max"), F.min("publish_ns").alias("publish_min"), F.max("publish_ns").alias("publish_max"))


def skew(messages: DataFrame) -> DataFrame:
    """The least and largest log - publish of each recording, in nanoseconds."""
    difference = F.col("log_ns") - F.col("publish_ns")
    return messages.groupBy("recording_id").agg(F.min(difference).alias("skew_min"), F.max(difference).alias("skew_max"))


def high_water(messages: DataFrame) -> DataFrame:
    """One row: the largest time on each clock, 0 without messages."""
    return messages.agg(F.coalesce(F.max("log_ns"), F.lit(0)).alias("log_high"), F.coalesce(F.max("publish_ns"), F.lit(0)).alias("publish_high"))


def running_high(messages: DataFrame, value: Column, *, chunk: int = CHUNK) -> DataFrame:
    """Messages with high_ns, the largest value so far in order of arrival (recording, offset).

    A tree of scans, as one ordered window over everything would be one task: the maxima of chunks of arrivals and of
    recordings, the running maxima over recordings (a row for each), over a recording's chunks, and within each chunk.
    """
    part = F.call_function("div", F.col("offset"), F.lit(chunk))
    rows = messages.withColumn("part", part).withColumn("value", value)
    chunks = rows.groupBy("recording_id", "part").agg(F.max("value").alias("most"))
    before = lambda by, order: F.max("most").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    files = chunks.groupBy("recording_id").agg(F.max("most").alias("most")).select("recording_id", before(Window, "recording_id").alias("files_before"))
    starts = chunks.select("recording_id", "part", before(Window.partitionBy("recording_id"), "part").alias("parts_before")).join(files, "recording_id")
    inside = rows.withColumn("high", F.max("value").over(Window.partitionBy("recording_id", "part").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)))
    high = F.greatest("high", F.coalesce("parts_before", F.lit(0)), F.coalesce("files_before", F.lit(0)), F.lit(0))
    return inside.join(starts, ["recording_id", "part"]).withColumn("high_ns", high).drop("part", "value", "high", "parts_before", "files_before")


def resolved_channels(channels: DataFrame, schemas: DataFrame) -> DataFrame:
    """Channels with their schema; id 0 and ids without a schema have none. The last definition of an id wins."""
    last = lambda df, key: df.withColumn("k", F.row_number().over(Window.partitionBy("recording_id", key).orderBy(F.desc("offset")))).filter("k = 1").drop("k", "offset")
    named = last(schemas, "schema_id").filter("schema_id <> 0").select("recording_id", "schema_id", F.struct("name", "encoding", "data").alias("schema"))
    return last(channels, "channel_id").join(named, ["recording_id", "schema_id"], "left").drop("schema_id")


def with_topics(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Messages with topic and message_encoding; null where the channel is unknown."""
    return messages.join(channels.select("recording_id", "channel_id", "topic", "message_encoding"), ["recording_id", "channel_id"], "left")


def tapped(messages: DataFrame, channels: DataFrame, topic: str) -> DataFrame:
    """The messages on a topic, with their encoding: undecoded trigger records."""
    return messages.join(channels.filter(F.col("topic") == topic).select("recording_id", "channel_id", "message_encoding"), ["recording_id", "channel_id"])
