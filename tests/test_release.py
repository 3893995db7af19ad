"""Triggers as Spark state, against the batch form."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.model import SECOND
from tidemark.operators import coverage, windows
from tidemark.sources import adapters
from tidemark.streaming import release


def started(spark, folder, clock="log", grace=None, **trigger):
    read = lambda n, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / n))
    found = release.releases(read("t", "trigger_id long, log_ns long, end_ns long"), read("m", "log_ns long, publish_ns long"), clock=clock, grace_ns=grace, groups=3)
    with release.rocksdb(spark):
        return found.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(**trigger).start()


def released(spark, folder):
    return {r["trigger_id"]: (r["release_ns"], r["status"]) for r in spark.read.schema(release.RELEASED).parquet(str(folder / "out")).collect()}


@pytest.mark.parametrize("clock", ["log", "publish"])
def test_release_times_equal_the_batch_form_over_restarts(spark, sf, tmp_path, clock):
    """Five batches of arrivals; the query ends after two and goes on from its state store."""
    m, t = adapters.messages(spark, sf), windows.with_windows(adapters.triggers(spark, sf), clock=clock)
    want = {r["trigger_id"]: (r["release_ns"], "covered") for r in coverage.releases(t, m, clock=clock).collect() if r["release_ns"] is not None}
    low, high = m.agg(F.min("log_ns"), F.max("log_ns")).first()
    for k in range(5):
        if k == 2:
            started(spark, tmp_path, clock, availableNow=True).awaitTermination()
            early = released(spark, tmp_path)
            assert 0 < len(early) < len(want)
        a, b = (low + (high - low) * j // 5 + (1 if j == 5 else 0) for j in (k, k + 1))
        inside = (F.col("log_ns") >= a) & (F.col("log_ns") < b)
        m.filter(inside).select("log_ns", "publish_ns").write.mode("append").parquet(str(tmp_path / "m"))
        t.filter(inside).select("trigger_id", "log_ns", "end_ns").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        # files are read one a batch, in order of time: one file for each part
        if k != 1:
            started(spark, tmp_path, clock, availableNow=True).awaitTermination()
    assert released(spark, tmp_path) == want


def test_timers_wake_triggers_without_messages(spark, tmp_path):
    """The wall clock reaches a covered trigger's end, and another's grace runs out, while nothing arrives."""
    now = time.time_ns()
    spark.createDataFrame([(1, now, now + 2 * SECOND), (2, now, now + 3 * SECOND), (3, now - 10, now - 5)], "trigger_id long, log_ns long, end_ns long").coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(now, now + 2 * SECOND)], "log_ns long, publish_ns long").coalesce(1).write.parquet(str(tmp_path / "m"))
    query = started(spark, tmp_path, "publish", grace=4 * SECOND, processingTime="300 milliseconds")
    try:
        end = time.monotonic() + 60
        while time.monotonic() < end and len(released(spark, tmp_path)) < 3:
            time.sleep(0.3)
    finally:
        query.stop()
    got = released(spark, tmp_path)
    assert {k: v[1] for k, v in got.items()} == {1: "covered", 2: "grace_cut", 3: "covered"}
    assert got[1][0] >= now + 2 * SECOND and got[2][0] >= now + 7 * SECOND and got[3][0] >= now


def test_steps_keep_what_moves_the_coverage(spark):
    m = spark.createDataFrame([(10, 5), (20, 4), (30, 9), (30, 8), (41, 1), (42, 9)], "log_ns long, publish_ns long").coalesce(1)
    assert sorted(tuple(r) for r in release.steps(m, "publish", 1).collect()) == [(10, 5), (20, 4), (30, 9), (41, 1), (42, 9)]
    assert sorted(tuple(r) for r in release.steps(m, "publish", 100).collect()) == [(10, 5), (30, 9)]


def test_groups_hear_of_a_batch_in_parts_and_still_know_every_first_arrival():
    """Each group gets its bins' steps and a row a bin, not the whole batch; stamps reach from dense to wild."""
    rng = np.random.default_rng(8)
    for spread, groups in ((2_000, 7), (2_000, 1), (100_000, 16), (2**61, 16)):
        value, arrival, width = rng.integers(0, spread, 3_000), rng.integers(0, 5_000, 3_000), 50
        group, at, by = release.told(value, arrival, groups, width)
        for end in [*rng.integers(0, spread, 200), *value[:50], *(value[:50] // width * width)]:
            mine = group == end // width % groups
            heard, true = by[mine & (at >= end)], arrival[value >= end]
            assert (heard.min() if len(heard) else None) == (true.min() if len(true) else None)
    n, groups = 200_000, 64
    arrival = np.sort(rng.integers(0, 2_000 * 50, n))
    group, _, _ = release.told(arrival, arrival, groups, 50)
    assert len(group) < 1.1 * len(np.unique(arrival)) and np.bincount(group).max() < 2 * len(np.unique(arrival)) / groups


def test_a_group_takes_rows_in_any_order_and_keeps_steps_only(monkeypatch):
    """Rows stream by in chunks, triggers after the messages that release them; steps are reduced meanwhile."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.value, self.map = None, {}

        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)
        iterator = lambda self: iter([((k,), v) for k, v in self.map.items()])
        containsKey = lambda self, k: k[0] in self.map  # noqa: E731, N815
        updateValue = lambda self, k, v: self.map.__setitem__(k[0], v)  # noqa: E731, N815
        removeKey = lambda self, k: self.map.pop(k[0])  # noqa: E731, N815

    monkeypatch.setattr(release, "ROWS", 100)
    most, front = [], release._Steps.front
    monkeypatch.setattr(release._Steps, "front", lambda self: (most.append(self.held), front(self))[1])
    p = release._Release(None)
    p.high, p.pending = Held(), Held()
    row = lambda kind, t, a, v: pd.DataFrame({"kind": kind, "trigger_id": t, "arrival_ns": a, "value_ns": v})
    big = 2**60 + 1
    chunks = [row([k] * 50, [0] * 50, [j] * 50, [j] * 50) for j in range(10, 20) for k in (release.COVERAGE, release.WALL)]
    out = next(p.handleInputRows((0,), iter([*chunks, row([0] * 3, [big, 2, 3], [5, 18, 5], [12, 12, 30])]), None))
    assert sorted(map(tuple, out.itertuples(index=False))) == [(2, 18, "covered"), (big, 12, "covered")] and max(most) <= 200
    assert p.pending.map == {3: (5, 30)} and p.high.value == (19, 19)
    out = next(p.handleInputRows((0,), iter([row([1, 2, 0], [0, 0, 4], [40, 40, 41], [35, 40, 19])]), None))
    assert sorted(map(tuple, out.itertuples(index=False))) == [(3, 40, "covered"), (4, 41, "covered")] and p.pending.map == {}
