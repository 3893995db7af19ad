"""Triggers as Spark state: when each may be cut, with pending triggers and coverage in the state store.

Time is cut into bins, dealt to groups in turn, and a trigger belongs to the group of its end's bin. Each task reduces a
batch's messages to what moves the coverage or the wall clock; such a step goes to the group of its own bin, and the
other groups hear of it once for each of their bins below it, as of a step at the end of that bin. A group holds the
coverage so far, how far the wall clock has come by arrivals, and its pending triggers. It takes a batch's rows as they
stream by and keeps the steps alone, so its memory grows with its own bins' steps and triggers, not with the batch. A
trigger is released once its arrival, coverage (equality does) and the wall clock's reaching its end have come, as in
coverage.releases, at the last of the three; that is exact where a batch's messages arrive after those of the batch before.

With a grace the wall clock is the real one: timers wake a group at its triggers' ends and when their grace, which starts
when arrival and end are past, has run out, whether or not a message comes. After a restart a query goes on from the
state store, timers included.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.scalars import stamp
from tidemark.model import LOG, LONG_MAX
from tidemark.operators.windows import BIN_NS, bin_of

RELEASED = "trigger_id long, release_ns long, status string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_MS = 1_000_000
#: Rows of a task that are reduced together, and steps of a group between two reductions.
ROWS = 1 << 20
#: Rows of a batch that a task hands on.
BATCH = 1 << 16
#: Kinds of a group's rows.
TRIGGER, COVERAGE, WALL = 0, 1, 2


def _front(value: np.ndarray, arrival: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps in order of arrival: those with a larger value than all that arrive before, one for each arrival."""
    order = np.lexsort((-value, arrival))
    value, arrival = value[order], arrival[order]
    moves = np.ones(len(value), bool)
    moves[1:] = np.diff(np.maximum.accumulate(value)) > 0
    return value[moves], arrival[moves]


class _Steps:
    """The steps of one clock, reduced whenever their number has doubled."""

    def __init__(self):
        self.parts, self.held, self.most = [], 0, ROWS

    def add(self, value: np.ndarray, arrival: np.ndarray) -> None:
        self.parts.append((value, arrival))
        self.held += len(value)
        if self.held > self.most:
            self.most = max(ROWS, 2 * len(self.front()[0]))

    def front(self) -> tuple[np.ndarray, np.ndarray]:
        both = [np.concatenate([p[k] for p in self.parts]) if self.parts else np.empty(0, np.int64) for k in (0, 1)]
        self.parts = [_front(*both)]
        self.held = len(self.parts[0][0])
        return self.parts[0]


def _first(end: np.ndarray, before: int, value: np.ndarray, arrival: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a clock has reached each end, and the arrival at which it did; -1: before this batch."""
    k = np.searchsorted(value, end)
    at = np.append(arrival, 0)[k]
    return (before >= end) | (k < len(value)), np.where(before >= end, -1, at)


class _Release(StatefulProcessor):
    def __init__(self, grace_ns: int | None):
        self.grace = grace_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.high = handle.getValueState("high", "coverage long, wall long")
        self.pending = handle.getMapState("pending", "trigger_id long", "log_ns long, end_ns long")

    def _now(self, timers) -> int | None:
        return None if self.grace is None else timers.getCurrentProcessingTimeInMs() * _MS

    def _ends(self, log: int, end: int) -> int:
        return min(max(log, end) + (self.grace or 0), LONG_MAX)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        coverage, wall = self.high.get() if self.high.exists() else (0, 0)
        waiting = {k[0]: tuple(v) for k, v in self.pending.iterator()}
        clocks = {COVERAGE: _Steps(), WALL: _Steps()}
        new = [np.array([(t, *v) for t, v in waiting.items()], np.int64).reshape(-1, 3).T]
        for b in rows:
            kind, trigger, arrival, value = (b[c].to_numpy() for c in ("kind", "trigger_id", "arrival_ns", "value_ns"))
            for k, steps in clocks.items():
                if (mine := kind == k).any():
                    steps.add(value[mine].astype(np.int64), arrival[mine].astype(np.int64))
            if (mine := kind == TRIGGER).any():
                new.append([x[mine].astype(np.int64) for x in (trigger, arrival, value)])
        ids, log, end = (np.concatenate(x) for x in zip(*new, strict=True))
        last = len(ids) - 1 - np.unique(ids[::-1], return_index=True)[1]  # of rows with one id the last holds
        ids, log, end = ids[last], log[last], end[last]
        now, (cover, ticks) = self._now(timerValues), (clocks[k].front() for k in (COVERAGE, WALL))
        covered, cover_at = _first(end, coverage, *cover)
        passed, wall_at = _first(end, wall, *ticks)
        if now is not None:
            passed, wall_at = now >= end, np.where(covered, now, 0)
        ready = covered & passed
        for t in ids[ready].tolist() if waiting else ():
            if t in waiting:
                self.pending.removeKey((t,))
        for t, at, e in zip(*(x[~ready].tolist() for x in (ids, log, end)), strict=True):
            if t not in waiting:
                self.pending.updateValue((t,), (at, e))
                if now is not None:
                    for due in (e, self._ends(at, e)):
                        self.handle.registerTimer(max(-(-due // _MS), now // _MS + 1))
        if len(cover[0]) or len(ticks[0]):
            self.high.update((max([coverage, *cover[0][-1:].tolist()]), max([wall, *ticks[0][-1:].tolist()])))
        release = np.maximum(log, np.maximum(cover_at, wall_at))[ready]
        yield pd.DataFrame({"trigger_id": ids[ready], "release_ns": release, "status": "covered"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        coverage, _ = self.high.get() if self.high.exists() else (0, 0)
        now, out = self._now(timerValues), []
        for (t,), (log, end) in [(k, tuple(v)) for k, v in self.pending.iterator()]:
            if now >= end and (coverage >= end or now >= self._ends(log, end)):
                out.append((t, now, "covered" if coverage >= end else "grace_cut"))
                self.pending.removeKey((t,))
        yield pd.DataFrame(out, columns=["trigger_id", "release_ns", "status"])

    def close(self) -> None:
        pass


def steps(messages: DataFrame, clock: str, tick_ns: int) -> DataFrame:
    """arrival_ns and value_ns of the messages that move the coverage, or the wall clock by a tick, within a task's batch."""

    def reduced(held):  # each lot by itself: the groups sort what all of a micro-batch's tasks kept
        arrival, value = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(arrival, kind="stable")
        arrival, value = arrival[order], value[order]
        moved = np.ones(len(arrival), bool)
        moved[1:] = (np.diff(np.maximum.accumulate(value)) > 0) | (np.diff(arrival // tick_ns) > 0) if len(value) else False
        arrival, value = arrival[moved], value[moved]
        for k in range(0, len(arrival), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(arrival[k : k + BATCH]), pa.array(value[k : k + BATCH])], names=["arrival_ns", "value_ns"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append([b.column(k).to_numpy() for k in (0, 1)])
            rows += b.num_rows
            if rows >= ROWS:
                yield from reduced(held)
                held, rows = [], 0
        if rows:
            yield from reduced(held)

    return messages.select(F.col("log_ns").alias("a"), stamp(clock).alias("v")).filter("a is not null and v is not null").mapInArrow(run, "arrival_ns long, value_ns long")


def told(value: np.ndarray, arrival: np.ndarray, groups: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, value and arrival of what the groups must hear of some steps to know the first arrival at or beyond each end.

    A step itself goes to its bin's group. What lies beyond a bin reaches every end in it alike: the first arrival beyond
    goes to the bin's group, for the last of that group's bins below a bin with steps, as beyond a lower one nothing arrives
    earlier without a step between.
    """
    if not len(value):
        return (np.empty(0, np.int64),) * 3
    value, arrival = _front(value, arrival)  # both ascend, so the first arrival beyond a bin is that of the next bin's first step
    bin_ = value // width
    first = np.flatnonzero(np.append(True, np.diff(bin_) > 0))
    # bins from that of the step before up to, not including, the step's own: the last `groups` of them have all groups
    low = np.maximum(np.append(bin_[0] - groups, bin_[first[1:] - 1]), bin_[first] - groups)
    n = bin_[first] - low
    below = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    return np.concatenate([bin_, below]) % groups, np.concatenate([value, (below + 1) * width]), np.concatenate([arrival, np.repeat(arrival[first], n)])


def dealt(stepped: DataFrame, groups: int, width: int) -> DataFrame:
    """Rows of steps as rows for groups: (group, kind, trigger_id, arrival_ns, value_ns)."""

    def run(batches):
        for b in batches:
            arrival, value = (b.column(k).to_numpy() for k in (0, 1))
            for kind, x in ((COVERAGE, value), (WALL, arrival)):
                group, at, by = told(x, arrival, groups, width)
                for k in range(0, len(at), BATCH):
                    part = [x[k : k + BATCH] for x in (group, at, by)]
                    same = np.full(len(part[0]), kind)
                    yield pa.RecordBatch.from_arrays([pa.array(part[0].astype(np.int32)), pa.array(same.astype(np.int32)), pa.array(np.zeros(len(same), np.int64)), pa.array(part[2]), pa.array(part[1])], names=["group", "kind", "trigger_id", "arrival_ns", "value_ns"])

    return stepped.mapInArrow(run, "group int, kind int, trigger_id long, arrival_ns long, value_ns long")


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that stateful processors need, for queries that start meanwhile."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def releases(windows: DataFrame, messages: DataFrame, *, clock: str = LOG, grace_ns: int | None = None, groups: int = 64, tick_ns: int = 1, width: int = BIN_NS) -> DataFrame:
    """A stream of (trigger_id, release_ns, status) from streams of windows and messages; start it within `rocksdb`.

    tick_ns: the wall clock by arrivals may be told a tick late; 1 is exact. groups and width, that of the bins, must stay
    the same over restarts. A trigger that is given again has the same end.
    """
    group = F.pmod(bin_of(F.col("end_ns") - F.pmod(F.col("end_ns"), F.lit(width)), width), F.lit(groups)).cast("int").alias("group")
    keyed = windows.filter("log_ns is not null and end_ns is not null").select(group, F.lit(TRIGGER).alias("kind"), "trigger_id", F.col("log_ns").alias("arrival_ns"), F.col("end_ns").alias("value_ns"))
    every = dealt(steps(messages, clock, tick_ns), groups, width)
    return keyed.unionByName(every).groupBy("group").transformWithStateInPandas(statefulProcessor=_Release(grace_ns), outputStructType=RELEASED, outputMode="Append", timeMode="None" if grace_ns is None else "ProcessingTime")
