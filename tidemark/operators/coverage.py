"""When windows may be cut, what is kept, and which triggers are admitted."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import sat_add, sat_sub, stamp
from tidemark.model import LOG, MAX_ACTIVE
from tidemark.operators.windows import BIN_NS, bin_of, matches


#: Bins of a group of bins; there are at most a few thousand groups, however wild the stamps.
GROUP = 4096
#: Ranges of arrival of one admission count: one for so many triggers, but so many at least and at most.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1 << 20, 8, 64


def first_passage(points: DataFrame, messages: DataFrame, value: Column, arrival: Column, *, width: int = BIN_NS) -> DataFrame:
    """points (trigger_id, at_ns) with passed_ns, the first arrival with a value of at_ns or more; null if there is none.

    Arrivals are reduced to each bin's first, these to each group's, and both to the first of all later ones, bins within
    their group. Only a point's own bin is looked at closely, and there a value's first arrival stands for its messages
    and a bin's distinct times of points for the points.
    """
    rows = messages.select(value.alias("value"), arrival.alias("arrival")).groupBy("value").agg(F.min("arrival").alias("arrival")).withColumn("bin", bin_of(F.col("value"), width))
    p = points.select("trigger_id", "at_ns", bin_of(F.col("at_ns"), width).alias("bin"))
    times = p.select("at_ns", "bin").distinct()
    group = bin_of(F.col("bin"), GROUP).alias("group")
    firsts = rows.select("bin", "arrival").unionByName(times.select("bin", F.lit(None).cast("long").alias("arrival"))).groupBy("bin", group).agg(F.min("arrival").alias("first"))
    later = lambda by, order: F.min("first").over(by.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))
    groups = firsts.groupBy("group").agg(F.min("first").alias("first")).select("group", later(Window, "group").alias("beyond"))
    above = firsts.select("bin", "group", later(Window.partitionBy("group"), "bin").alias("near")).join(groups, "group").select("bin", F.least("near", "beyond").alias("above"))
    here = times.join(rows, "bin").filter("value >= at_ns").groupBy("at_ns").agg(F.min("arrival").alias("here"))
    return p.join(above, "bin").join(here, "at_ns", "left").select("trigger_id", "at_ns", F.least("here", "above").alias("passed_ns"))


def releases(windows: DataFrame, messages: DataFrame, *, clock: str = LOG) -> DataFrame:
    """windows with release_ns: when all of arrival, coverage (the high-water mark reaches the end; equality does) and
    the wall clock's reaching the end have come. Arrivals' log times are the wall clock. Null: not yet.
    """
    points = windows.select("trigger_id", F.col("end_ns").alias("at_ns"))
    covered = first_passage(points, messages, stamp(clock), F.col("log_ns")).select("trigger_id", F.col("passed_ns").alias("covered_ns"))
    wall = first_passage(points, messages, F.col("log_ns"), F.col("log_ns")).select("trigger_id", F.col("passed_ns").alias("wall_ns"))
    joined = windows.join(covered, "trigger_id").join(wall, "trigger_id")
    return joined.withColumn("release_ns", F.when(F.col("covered_ns").isNotNull() & F.col("wall_ns").isNotNull(), F.greatest("log_ns", "covered_ns", "wall_ns")))


def cut_status(windows: DataFrame, coverage_ns: Column, now: Column, grace_ns: int) -> DataFrame:
    """windows with status: covered, grace_cut (grace, which starts when arrival and end are past, has run out) or pending.

    A recording that has ended below the window's end changes nothing: the grace still runs.
    """
    waiting = F.col("end_ns") > now
    status = F.when(waiting, "pending").when(coverage_ns >= F.col("end_ns"), "covered").when(now >= sat_add(F.greatest("log_ns", "end_ns"), grace_ns), "grace_cut").otherwise("pending")
    return windows.withColumn("status", status)


def late(released: DataFrame, messages: DataFrame, *, clock: str = LOG) -> DataFrame:
    """Messages per window that arrived after its release, and so are missing from the clip that was cut then.

    released: windows with release_ns. Messages with the same times meet the windows as one, and the joined rows are
    counted where they are.
    """
    timed = messages.groupBy("log_ns", "publish_ns").agg(F.count("*").alias("n"))
    found = matches(released.filter("release_ns is not null"), timed, clock=clock, keep=["release_ns"]).filter(F.col("log_ns") > F.col("release_ns"))
    return found.groupBy("trigger_id").agg(F.sum("n").alias("late"))


def states(recordings: DataFrame, ended: Column) -> DataFrame:
    """recordings (recording_id, ...) with state, has_successor and is_current: the oldest that hasn't ended.

    One row per recorded file; their order is one window over files.
    """
    order = Window.orderBy("recording_id")
    marked = recordings.withColumn("has_successor", F.lead("recording_id").over(order).isNotNull()).withColumn("ended", ended)
    current = F.min(F.when(~F.col("ended"), F.col("recording_id"))).over(Window.partitionBy(F.lit(1)))
    is_current = F.coalesce(F.col("recording_id") == current, F.lit(False))
    state = F.when(F.col("ended"), "Ended").when(is_current, "Tailing").otherwise("New")
    return marked.withColumn("is_current", is_current).withColumn("state", state).drop("ended")


def pruned(recordings: DataFrame, now: Column, retention_ns: int) -> Column:
    """Whether a recording goes: ended, not current, with messages, the last of which is older than the retention."""
    return (F.col("state") == "Ended") & ~F.col("is_current") & F.col("log_max").isNotNull() & (F.col("log_max") < sat_sub(now, retention_ns))


def _admitting(at: np.ndarray, finish: np.ndarray, active: list[int], limit: int) -> np.ndarray:
    """Whether each of some valid triggers, in order of arrival, is admitted; active, a heap of finish times, moves on.

    While all slots are taken those that arrive before the first is free are passed over at once.
    """
    out, k = np.zeros(len(at), bool), 0
    while k < len(at) and limit > 0:
        while active and active[0] <= at[k]:
            heapq.heappop(active)
        if len(active) < limit:
            heapq.heappush(active, int(finish[k]))
            out[k] = True
            k += 1
        else:
            k += int(np.searchsorted(at[k:], active[0]))
    return out


def _folded(batches: Iterator[pa.RecordBatch], key: str, before: dict, limit: int) -> Iterator[tuple]:
    """Each batch, sorted by key and arrival, with its decisions and the finish times active after each key in it."""
    at, active = None, []
    for b in batches:
        keys, log, finish = b.column(key).to_pylist(), *(b.column(c).fill_null(0).to_numpy() for c in ("log_ns", "finish_ns"))
        valid, out, after = b.column("reject_reason").is_null().to_numpy(zero_copy_only=False), np.zeros(b.num_rows, bool), {}
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else []
        for a, z in zip(cuts, cuts[1:], strict=False):
            if keys[a] != at:
                at, active = keys[a], list(before.get(keys[a], []))
            places = a + np.flatnonzero(valid[a:z])
            out[places] = _admitting(log[places], finish[places], active, limit)
            after[at] = sorted(x for x in active if x > log[z - 1])
        yield b, out, after


def admitted(triggers: DataFrame, *, limit: int = MAX_ACTIVE, by: str | None = "recording_id") -> DataFrame:
    """triggers (trigger_id, log_ns, finish_ns, reject_reason) with admitted: valid, and fewer than `limit` active then.

    A fold in order of arrival (log_ns, then trigger_id) within each source `by`, or over all sources if that is None: a
    task streams its triggers and holds at most `limit` finish times. Refused triggers are dropped, not queued. A slot is
    free again at its finish time.
    """
    if by is None:
        return _admitted_by_all(triggers, limit)
    return _decided(triggers.repartition(by).sortWithinPartitions(by, "log_ns", "trigger_id"), by, {}, limit)


def _decided(ordered: DataFrame, key: str, before: dict, limit: int) -> DataFrame:
    def decide(batches):
        for b, out, _ in _folded(batches, key, before, limit):
            yield b.append_column("admitted", pa.array(out))

    return ordered.mapInArrow(decide, T.StructType([*ordered.schema.fields, T.StructField("admitted", T.BooleanType())]))


def _ranges(triggers: DataFrame) -> Column:
    """The range of each trigger by its arrival: ranges of about equal numbers, cut at quantiles."""
    n, cuts = triggers.agg(F.count("*"), F.percentile_approx("log_ns", [k / MOST_RANGES for k in range(1, MOST_RANGES)], 1000)).first()
    number = max(LEAST_RANGES, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = sorted({cuts[k * MOST_RANGES // number - 1] for k in range(1, number)}) if cuts else []
    return sum((F.when(F.col("log_ns") >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def _admitted_by_all(triggers: DataFrame, limit: int) -> DataFrame:
    """One count over all sources.

    Triggers are dealt by range of arrival. A range is a function from the finish times active before it to those active
    after it, and its decisions follow from the former. Each range is first taken from nothing active; then those whose
    predecessor ended otherwise are taken again from what it ended with, until none changes. That is the fold: the first
    range is right at once, and a range that follows a right one is right in the next round. Ranges forget: a busy spell
    that ends within a range makes its end the same from any beginning, so few rounds are usual, and a round runs only
    the ranges that changed. While slots stay taken throughout, ranges needn't forget, and there are as many rounds as
    ranges; so their number is not that of Spark's partitions but small, and a round is one job however many rows there
    are. The driver holds at most `limit` finish times of each range.
    """
    parted = triggers.withColumn("range", _ranges(triggers).cast("int"))
    ranged = parted.repartition("range").sortWithinPartitions("range", "log_ns", "trigger_id").persist()
    states = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("active", T.ArrayType(T.LongType()))])

    def ends(before: dict[int, list[int]]) -> dict[int, list[int]]:
        def fold(batches):
            after = {}
            for _, _, some in _folded(batches, "range", before, limit):
                after |= some
            yield pa.RecordBatch.from_arrays([pa.array(list(after), pa.int32()), pa.array(list(after.values()), pa.list_(pa.int64()))], names=states.names)

        rows = ranged.select("range", "log_ns", "finish_ns", "reject_reason").coalesce(MOST_RANGES if not before else min(len(before), MOST_RANGES))
        some = rows.filter(F.col("range").isin(sorted(before))) if before else rows
        return {r["range"]: list(r["active"]) for r in some.mapInArrow(fold, states).collect()}

    after = ends({})
    order = sorted(after)
    before = dict.fromkeys(order, [])
    while changed := {k: after[j] for j, k in zip(order, order[1:], strict=False) if before[k] != after[j]}:
        before |= changed
        after |= ends(changed)
    return _decided(ranged, "range", before, limit).drop("range")
