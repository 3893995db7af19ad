"""The life of recordings in a stream's offsets, versions of the index, and what goes on beside a cut."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import types as T

from test_live import TRIGGER, clip, recording
from tidemark.model import LONG_MAX, Params
from tidemark.sources import datasource, mcap
from tidemark.streaming import live as module
from tidemark.streaming import snapshots
from tidemark.streaming.live import Live
from tidemark.streaming.snapshots import Snapshots


def until(done, seconds=60):
    end = time.monotonic() + seconds
    while not done() and time.monotonic() < end:
        time.sleep(0.05)
    assert done()


# a file's life


class Source:
    """A stream's offsets as Spark asks for them, without Spark."""

    def __init__(self, folder, **options):
        self.stream = datasource._Stream({"path": str(folder)} | options)
        self.at = self.stream.initialOffset()

    def poll(self):
        """The messages of a batch, with their recordings, read until nothing is left."""
        out = []
        for _ in range(4):
            new = self.stream.latestOffset()
            for part in self.stream.partitions(self.at, new):
                for b in self.stream.read(part):
                    out += [(r["recording_id"], r["log_ns"]) for r in b.to_pylist() if r["kind"] == "message"]
            self.at = new
        return sorted(out)

    def files(self):
        return [(x["recording_id"], os.path.basename(x["path"])) for x in json.loads(self.at["files"])]


def test_a_reused_inode_is_a_new_recording(tmp_path):
    a, b = tmp_path / "a.mcap", tmp_path / "b.mcap"
    recording(a, [("/t", 1, 1, b"x"), ("/t", 2, 2, b"x")])
    s = Source(tmp_path)
    assert s.poll() == [(0, 1), (0, 2)] and s.poll() == []
    inode = os.stat(a).st_ino
    os.rename(a, b)  # the same recording under another name
    assert s.poll() == [] and s.files() == [(0, "b.mcap")]
    recording(b, [("/t", 3, 3, b"other"), ("/t", 4, 4, b"x"), ("/t", 5, 5, b"x")])  # another one in its inode, never absent between
    assert os.stat(b).st_ino == inode and s.poll() == [(1, 3), (1, 4), (1, 5)] and s.files() == [(1, "b.mcap")]
    os.rename(b, a)
    recording(a, [("/t", 6, 6, b"x")])  # shorter, and under another name
    assert os.stat(a).st_ino == inode and s.poll() == [(2, 6)]
    os.unlink(a)
    assert s.poll() == [] and s.files() == []
    recording(b, [("/t", 7, 7, b"x")])
    assert s.poll() == [(3, 7)] and s.files() == [(3, "b.mcap")]


def test_offsets_hold_only_what_is_on_disk(tmp_path):
    s = Source(tmp_path)
    for k in range(20):
        recording(tmp_path / f"{k}.mcap", [("/t", k, k, b"x")])
        os.utime(tmp_path / f"{k}.mcap", ns=(k, k))
        assert s.poll() == [(k, k)]
        if k:
            os.unlink(tmp_path / f"{k - 1}.mcap")
    assert s.poll() == [] and s.files() == [(19, "19.mcap")] and len(s.at["files"]) < 300


def test_numbers_outlive_a_restart(tmp_path):
    folder, state = tmp_path / "rec", str(tmp_path / "recordings.json")
    folder.mkdir()
    s = Source(folder, state=state)
    for k in range(3):
        recording(folder / f"{k}.mcap", [("/t", k, k, b"x")])
        os.utime(folder / f"{k}.mcap", ns=(k, k))
    assert s.poll() == [(0, 0), (1, 1), (2, 2)]
    os.unlink(folder / "0.mcap")
    again = Source(folder, state=state)
    again.stream, again.at = datasource._Stream({"path": str(folder), "state": state}), s.at  # Spark asks for no initial offset then
    recording(folder / "3.mcap", [("/t", 3, 3, b"x")])
    assert again.poll() == [(3, 3)] and again.files() == [(1, "1.mcap"), (2, "2.mcap"), (3, "3.mcap")]


def test_recordings_that_vanish_before_they_are_read_give_nothing(tmp_path):
    recording(tmp_path / "a.mcap", [("/t", 1, 1, b"x")])
    s = Source(tmp_path)
    (part,) = s.stream.partitions(s.at, s.stream.latestOffset())
    assert sum(b.num_rows for b in s.stream.read(part)) > 0
    recording(tmp_path / "a.mcap", [("/t", 2, 2, b"another")])
    assert list(s.stream.read(part)) == []
    os.unlink(tmp_path / "a.mcap")
    assert list(s.stream.read(part)) == []


def test_later_starts_skip_older_recordings(tmp_path):
    for k in range(3):
        recording(tmp_path / f"{k}.mcap", [("/t", k, k, b"x")])
        os.utime(tmp_path / f"{k}.mcap", ns=(k, k))
    assert Source(tmp_path, startingOffsets="latest").poll() == [(2, 2)]


def scanned(live, done):
    live.start()
    try:
        until(done)
    finally:
        live.query.stop()


def test_pruning_frees_inodes_for_new_recordings(spark, tmp_path):
    """The live controller deletes what is older than the retention; whatever inodes new recordings get, they are read."""
    folder = tmp_path / "rec"
    folder.mkdir()
    live = Live(spark, Params(record_dir=str(folder), out_dir=str(tmp_path / "out"), retention_ns=15, delete_pruned=True, grace_ns=0), str(tmp_path / "work"))
    live.start()
    try:
        for k in range(6):
            recording(folder / f"{k}.mcap", [("/t", 10 * k, 10 * k, b"x%d" % k)])
            os.utime(folder / f"{k}.mcap", ns=(k, k))
            until(lambda k=k: live.state.coverage["log"] == 10 * k)
            live.prune(10 * k)
    finally:
        live.query.stop()
    assert sorted(live.state.bounds) == ["4", "5"] and sorted(os.listdir(folder)) == ["4.mcap", "5.mcap"]
    live.submit(TRIGGER, log_ns=45, publish_ns=45, now_ns=60)
    (done,) = live.step(65)
    assert [x for f in done["filenames"] for x in clip(spark, f)] == [(40, b"x4"), (50, b"x5")]


# versions of the index

ROWS = T.StructType([T.StructField("recording_id", T.LongType()), T.StructField("offset", T.LongType())])


class Crash(BaseException):
    pass


def held(spark, index, entries=None):
    with index.pinned() as now:
        return sorted((r["recording_id"], r["offset"]) for r in index.read(spark, "t", entries or now).collect())


def filled(spark, folder, batches, first=0):
    index = Snapshots(str(folder), {"t": ROWS})
    for k in range(first, batches):
        rows = [(k % 2, k), (2, 100 + k)]
        index.add("scan", k, {"t": (index.write("t", spark.createDataFrame(rows, ROWS)), {str(r): [k, k, k, k] for r, _ in rows})})
    return index


def rows_of(batches):
    return sorted(x for k in range(batches) for x in [(k % 2, k), (2, 100 + k)])


@pytest.mark.parametrize("step", ["write", "written", "fsync", "replace", "_delete"])
def test_a_crash_in_a_merge_neither_doubles_nor_loses(spark, tmp_path, monkeypatch, step):
    """Crashes before and after the merged file is written, before and after its list is on disk, before old files go."""
    monkeypatch.setattr(snapshots, "MERGE", 4)
    index = filled(spark, tmp_path / "i", 5)

    def die(*_, **__):
        raise Crash

    with monkeypatch.context() as m:
        if step == "written":
            m.setattr(index, "_commit", die)
        elif step in ("write", "_delete"):
            m.setattr(index, step, die)
        else:
            m.setattr(snapshots.os, step, die)
        with pytest.raises(Crash):
            index.merge(spark, "scan", 4)
    for _ in range(2):
        index = Snapshots(str(tmp_path / "i"), {"t": ROWS})
        assert held(spark, index) == rows_of(5)
        files = sorted(os.listdir(tmp_path / "i" / "t"))
        assert files == sorted(f"file={e.file}" for e in index.entries) and [n for n in os.listdir(tmp_path / "i") if n.startswith("list")].count(f"list-{index.version}.json") == 1
        index.merge(spark, "scan", 4)


def test_versions_are_pinned_and_merged_by_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MERGE", 2)
    index = filled(spark, tmp_path / "i", 4)
    with index.pinned() as old:
        index.merge(spark, "scan", 2)  # batch 3 may still be repeated
        assert sorted(e.level for e in index.entries) == [0, 1] and [e.batch for e in index.entries if not e.level] == [3]
        index.prune(["2"])
        assert held(spark, index, old) == rows_of(4) and held(spark, index) == [x for x in rows_of(4) if x[0] != 2]
    assert sorted(os.listdir(tmp_path / "i" / "t")) == sorted(f"file={e.file}" for e in index.entries)
    assert not any(n == "recording_id=2" for _, names, _ in os.walk(tmp_path / "i") for n in names)
    again = filled(spark, tmp_path / "i", 5, first=3)  # a repeated batch replaces itself
    assert held(spark, again) == sorted([x for x in rows_of(3) if x[0] != 2] + [(1, 3), (0, 4), (2, 103), (2, 104)])
    near = lambda r, b: snapshots.overlaps(b, 0, 4, 9)
    with again.pinned() as entries:
        assert {tuple(r) for r in again.read(spark, "t", entries, near).collect()} == {(0, 4), (2, 104)}


# live


def test_coverage_moves_while_a_clip_is_cut_and_pruning_harms_no_cut(spark, tmp_path, monkeypatch):
    folder = tmp_path / "rec"
    folder.mkdir()
    recording(folder / "0.mcap", [("/t", t, t, b"x%d" % t) for t in (10, 20, 30)])
    live = Live(spark, Params(record_dir=str(folder), out_dir=str(tmp_path / "out"), grace_ns=0, retention_ns=5), str(tmp_path / "work"))
    began, go = threading.Event(), threading.Event()
    true = datasource.write_clips
    monkeypatch.setattr(datasource, "write_clips", lambda *a, **k: (began.set(), go.wait(60), true(*a, **k))[-1])
    live.start()
    done = []
    cutter = threading.Thread(target=lambda: done.extend(live.step(40)))
    try:
        until(lambda: live.state.coverage["log"] == 30)
        live.submit(TRIGGER, log_ns=20, publish_ns=20, now_ns=40)
        cutter.start()
        assert began.wait(60)
        os.utime(folder / "0.mcap", ns=(1, 1))
        recording(folder / "1.mcap", [("/t", 1000, 1000, b"y")])
        until(lambda: live.state.coverage["log"] == 1000)  # the cut still stands
        assert cutter.is_alive() and live.prune(1000) == [0] and live.submit(TRIGGER, log_ns=5, publish_ns=5, now_ns=40) is None
        go.set()
        cutter.join(60)
    finally:
        go.set()
        live.query.stop()
    assert clip(spark, done[0]["filenames"][0]) == [(10, b"x10"), (20, b"x20"), (30, b"x30")] and len(live.state.pending) == 1
    assert list(live.state.bounds) == ["1"] and not any(n == "recording_id=0" for _, names, _ in os.walk(tmp_path / "work" / "index") for n in names)


def line(**more):
    return json.dumps({"name": "n", "trigger_time": {"sec": 0, "nanosec": 0}, "preroll": 1, "postroll": 1} | more)


@pytest.mark.parametrize("crash", ["before", "after"])
def test_an_inbox_gives_each_trigger_once(spark, tmp_path, monkeypatch, crash):
    """Crashes before the state is saved and after it, but before Spark has logged the batch."""
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.json").write_text(line(name="a") + "\n" + line(name="b") + "\nnot json\n\n" + line(name="c/d") + "\n" + line(name="e") + "\n")
    make = lambda: Live(spark, Params(out_dir=str(tmp_path / "out"), inbox=str(box), max_active=3), str(tmp_path / "work"))
    live = make()
    save = live._save

    def broken():
        if crash == "after":
            save()
        raise RuntimeError("crash")

    monkeypatch.setattr(live, "_save", broken)
    query = live.listen(module.inbox(spark, str(box)))
    with pytest.raises(Exception, match="crash"):
        query.processAllAvailable()
    for k in range(2):
        live = make()
        query = live.listen(module.inbox(spark, str(box)))
        if k:
            (box / "b.json").write_text(line(name="late"))
        query.processAllAvailable()
        query.stop()
    assert sorted(p["name"] for p in live.state.pending) == ["a", "b", "e"] and live.state.refused == {"undecodable": 1, "separator": 1, "busy": 1}
    dead = sorted((r["reason"] if r["name"] else "json", r["name"], bytes(r["payload"])) for r in live.dead_letters().collect())
    assert [d[:2] for d in dead] == [("busy", "late"), ("json", None), ("separator", "c/d")] and dead[1][2] == b"not json" and live.dead_letters().filter("source <> 'listen' or recording_id is not null").count() == 0


def test_recorded_triggers_that_cant_be_taken_up_are_kept(spark, tmp_path):
    folder = tmp_path / "rec"
    folder.mkdir()
    recording(folder / "a.mcap", [("/trigger", 10, 11, line(name="good").encode()), ("/trigger", 20, 21, b"{}"), ("/trigger", 30, 31, line(name="").encode()), ("/trigger", 40, 41, line(name="more").encode())])
    live = Live(spark, Params(record_dir=str(folder), out_dir=str(tmp_path / "out"), trigger_source="recorded", max_active=1, retention_ns=LONG_MAX), str(tmp_path / "work"))
    scanned(live, lambda: live.state.coverage["log"] == 40)
    assert [p["name"] for p in live.state.pending] == ["good"]
    dead = live.dead_letters().orderBy("log_ns").collect()
    assert [(r["recording_id"], r["log_ns"], r["publish_ns"], r["name"], r["reason"] if r["name"] is not None else None) for r in dead] == [(0, 20, 21, None, None), (0, 30, 31, "", "empty"), (0, 40, 41, "more", "busy")]
    assert "trigger_time" in dead[0]["reason"] and bytes(dead[0]["payload"]) == b"{}" and dead[0]["message_encoding"] == "json"


def test_damage_counts_by_planned_extent(spark, tmp_path):
    """A damaged chunk, a runt and an unknown channel, each told of by the windows whose extents hold it and by no other."""
    folder = tmp_path / "rec"
    folder.mkdir()
    big = b"z" * 600
    rec = [mcap.channel_record(1, 0, "/t", "json")]
    rec += [mcap.message_record(1, 0, t, t, big) for t in (100, 110)] + [mcap.record(mcap.MESSAGE, b"runt")]
    rec += [mcap.message_record(1, 0, t, t, big) for t in (200, 210)] + [mcap.chunk_record(mcap.message_record(1, 0, 205, 205, b"lost"), 205, 205, crc=1)]
    rec += [mcap.message_record(1, 0, t, t, big) for t in (300, 310)] + [mcap.message_record(9, 0, 305, 305, b"nobody's")]
    (folder / "a.mcap").write_bytes(mcap.MAGIC + b"".join(rec))
    live = Live(spark, Params(record_dir=str(folder), out_dir=str(tmp_path / "out"), grace_ns=0, retention_ns=LONG_MAX, extent_bytes=1000), str(tmp_path / "work"))
    scanned(live, lambda: live.state.coverage["log"] == 310)
    for t in (105, 205, 305, 500):
        live.submit(TRIGGER | {"name": str(t)}, log_ns=t, publish_ns=t, now_ns=600)
    got = {d["name"]: (d["messages"], d["bytes"], d["records_skipped"], d["chunks_dropped"], d["extents_read"] > 0) for d in live.step(600)}
    # extents are cut at 1,000 bytes: the runt lies in the second window's first, the damaged chunk in the third's
    assert got == {"105": (2, 1200, 0, 0, True), "205": (2, 1200, 1, 0, True), "305": (2, 1200, 1, 1, True), "500": (0, 0, 0, 0, False)}


def test_a_hung_scan_ends_the_process(spark, tmp_path, monkeypatch):
    (tmp_path / "rec").mkdir()
    recording(tmp_path / "rec" / "a.mcap", [("/t", 1, 1, b"x")])
    go = threading.Event()
    hung = []
    monkeypatch.setattr(Live, "ingest", lambda self, *_: (hung.append(self), go.wait(60)))
    try:
        given = ["--record-dir", str(tmp_path / "rec"), "--out-dir", str(tmp_path / "out"), "--work-dir", str(tmp_path / "work"), "--stall-s", "3", "--seconds", "50"]
        assert module.main(given, spark) == 1 and hung
    finally:
        go.set()
        hung[0].query.stop()


def test_extents_equal_those_of_the_whole_recording(spark, tmp_path, monkeypatch):
    """The extents that a live cut plans by are those of a batch read, whatever the batches and merges were."""
    from tidemark.operators import index

    monkeypatch.setattr(snapshots, "MERGE", 2)
    folder = tmp_path / "rec"
    folder.mkdir()
    raw = mcap.MAGIC + mcap.channel_record(1, 0, "/t", "json") + b"".join(mcap.message_record(1, 0, t, t, b"p" * 100) for t in range(40))
    live = Live(spark, Params(record_dir=str(folder), out_dir=str(tmp_path / "out"), retention_ns=LONG_MAX), str(tmp_path / "work"))
    live.start()
    try:
        for a in range(0, len(raw), 1200):
            with open(folder / "a.mcap", "ab") as f:
                f.write(raw[a : a + 1200])
            live.query.processAllAvailable()
    finally:
        live.query.stop()
    with live.index.pinned() as entries:
        mine = index.extents(live.index.read(spark, "records", entries), limit=500).orderBy("offset").collect()
    assert mine == index.extents(datasource.read(spark, str(folder), "records"), limit=500).orderBy("offset").collect() and len(mine) > 5
    assert max(e.level for e in live.index.entries) >= 1
