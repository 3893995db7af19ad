import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.model import LONG_MAX, SECOND, Params
from tidemark.sources import datasource, mcap
from tidemark.streaming.live import Live

TRIGGER = {"name": "evt", "description": "d", "trigger_time": {"sec": 0, "nanosec": 0}, "preroll_ns": 20, "postroll_ns": 20}


def recording(path, rows, codec="zstd"):
    out = io.BytesIO()
    w = mcap.Writer(out, codec, 64)
    for topic, log, publish, payload in rows:
        w.add(w.channel(topic, "json", {"a": "b"}, ("S", "jsonschema", b"{}")), 1, log, publish, payload)
    w.close()
    path.write_bytes(out.getvalue())


def clip(spark, path):
    return [(r["log_ns"], bytes(r["payload"])) for r in datasource.read(spark, path).orderBy("offset", "inner_seq").collect()]


def test_clips_are_written_once_and_never_over_others(spark, tmp_path):
    rows = [(1, 0, "a.mcap", "/t", "json", {"k": "v"}, None, 0, t, t, b"x", 0, t, 0) for t in (10, 5, 20)] + [(2, 0, "e.mcap", None, None, None, None, None, None, None, None, None, None, None)]
    schema = datasource.CLIP.simpleString()[7:-1] + ",recording_id:bigint,offset:bigint,inner_seq:int"
    df = spark.createDataFrame(rows, "struct<" + schema + ">")
    out = str(tmp_path / "out")
    first, second = datasource.write_clips(df, out), datasource.write_clips(df, out, "lz4")
    assert [os.path.basename(c["path"]) for c in first + second] == ["a.mcap", "e.mcap", "a_1.mcap", "e_1.mcap"]
    assert [c["messages"] for c in first] == [3, 0] and os.listdir(os.path.join(out, ".staging")) == []
    assert [t for t, _ in clip(spark, first[0]["path"])] == [5, 10, 20] and clip(spark, first[1]["path"]) == []
    assert [c["topic"] for c in datasource.read(spark, first[0]["path"], "channels").collect()] == ["/t"]


def test_names_run_out(tmp_path, monkeypatch):
    monkeypatch.setattr(datasource, "MOST_SUFFIXES", 2)
    for k in range(4):
        staged = tmp_path / f"s{k}"
        staged.write_text("x")
        if k < 3:
            datasource.publish(str(staged), str(tmp_path), "c.mcap")
        else:
            with pytest.raises(FileExistsError):
                datasource.publish(str(staged), str(tmp_path), "c.mcap")
    assert sorted(p.name for p in tmp_path.glob("*.mcap")) == ["c.mcap", "c_1.mcap", "c_2.mcap"]


def test_extents_of_chunked_recordings(spark, tmp_path):
    from tidemark.operators import index

    recording(tmp_path / "a.mcap", [("/t", t, 1000 - t, b"x") for t in (30, 10, 20)])
    e = index.extents(datasource.read(spark, str(tmp_path), "records")).collect()
    assert [(tuple(x["log"]), tuple(x["publish"]), x["offset"]) for x in e] == [((10, 30), (970, 990), 8)]


def test_only_planned_extents_are_read(spark, tmp_path):
    from tidemark.operators import index, windows

    for k in range(2):
        recording(tmp_path / f"{k}.mcap", [("/t", t, t, b"x" * 40) for t in range(100 * k, 100 * k + 50)])
        os.utime(tmp_path / f"{k}.mcap", ns=(k, k))
    e = index.extents(datasource.read(spark, str(tmp_path), "records"), limit=200).cache()
    w = spark.createDataFrame([(0, 110, 120)], "trigger_id long, start_ns long, end_ns long")
    plan = index.planned(w, e)
    near = datasource.read_planned(spark, str(tmp_path), plan)
    assert 1 <= plan.count() < e.count() and near.count() < 100
    assert sorted(r["log_ns"] for r in windows.matches(w, near).collect()) == list(range(110, 121))
    assert datasource.read_planned(spark, str(tmp_path), plan.limit(0)).count() == 0
    bad = [[0, str(tmp_path / "0.mcap"), 8, 20]]
    with pytest.raises(Exception, match="doesn't end with a record"):
        datasource.read(spark, str(tmp_path), ranges=bad).collect()


def test_damaged_chunks_are_counted_and_the_rest_is_copied(spark, tmp_path):
    from tidemark.operators import index, windows

    out = io.BytesIO()
    w = mcap.Writer(out, "", 1)
    c = w.channel("/t", "json")
    for t in (10, 20, 30, 40):
        w.add(c, 0, t, t, b"payload")
    w.close()
    raw = bytearray(out.getvalue())
    raw[raw.rindex(b"payload")] ^= 1  # in the last chunk, whose crc no longer holds
    (tmp_path / "a.mcap").write_bytes(raw)
    records = datasource.read(spark, str(tmp_path), "records")
    # the index was made while the chunk was whole
    e = index.extents(records.withColumns({f"{clock}_{end}": F.coalesce(f"{clock}_{end}", F.when(F.col("damaged"), 40)) for clock in ("log", "publish") for end in ("min", "max")}), limit=1)
    spans = spark.createDataFrame([(0, 5, 40), (1, 5, 30)], "trigger_id long, start_ns long, end_ns long")
    channels = datasource.read(spark, str(tmp_path), "channels")
    found = index.with_topics(windows.matches(spans, datasource.read(spark, str(tmp_path))), channels)
    stats = index.clip_stats(spans, found, index.planned(spans, e), records.filter("damaged")).orderBy("trigger_id").collect()
    assert [(r["messages_copied"], r["chunks_dropped"], r["extents_read"], r["records_skipped"]) for r in stats] == [(3, 1, 4, 0), (3, 0, 3, 0)]


def test_triggers_come_from_any_stream(spark, tmp_path):
    from tidemark.sources import producers

    (tmp_path / "in").mkdir()
    producers.rolled(spark, 3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    live = Live(spark, Params(out_dir=str(tmp_path / "out")), str(tmp_path / "work"))
    query = live.listen(spark.readStream.schema(producers.rolled(spark, 1).schema).parquet(str(tmp_path / "in")))
    query.processAllAvailable()
    query.stop()
    assert len(live.state.pending) == 3 and all(SECOND <= p["preroll_ns"] <= 10 * SECOND and p["preroll_ns"] % SECOND == 0 for p in live.state.pending)


def test_pruned_recordings_are_deleted_if_asked(spark, tmp_path):
    folder = tmp_path / "rec"
    folder.mkdir()
    for k in range(2):
        recording(folder / f"{k}.mcap", [("/t", 100 + k, 0, b"x")])
        os.utime(folder / f"{k}.mcap", ns=(k, k))
    live = Live(spark, Params(record_dir=str(folder), out_dir=str(tmp_path / "out"), retention_ns=10, delete_pruned=True), str(tmp_path / "work"))
    live.start()
    end = time.monotonic() + 60
    while live.state.coverage["log"] < 101 and time.monotonic() < end:
        time.sleep(0.1)
    live.query.stop()
    assert live.prune(110) == [] and live.prune(111) == [0] and sorted(os.listdir(folder)) == ["1.mcap"]


def test_a_recorded_trigger_is_cut_over_two_recordings(spark, tmp_path):
    folder = tmp_path / "rec"
    folder.mkdir()
    recording(folder / "a.mcap", [("/t", t, t + 1000, b"x%d" % t) for t in range(10, 60, 10)])
    os.utime(folder / "a.mcap", ns=(1, 1))
    body = json.dumps({"name": "evt", "trigger_time": {"sec": 0, "nanosec": 0}, "preroll": 20, "postroll": 20}).encode()
    recording(folder / "b.mcap", [("/t", 70, 1070, b"y70"), ("/t", 80, 1080, b"y80"), ("/trigger", 60, 1060, body), ("/trigger", 61, 1061, b"{}"), ("/t", 90, 1090, b"z")])
    live = Live(spark, Params(record_dir=str(folder), out_dir=str(tmp_path / "out"), trigger_source="recorded", retention_ns=LONG_MAX), str(tmp_path / "work"))
    live.start()
    try:
        end = time.monotonic() + 60
        while live.state.coverage["log"] < 90 and time.monotonic() < end:
            time.sleep(0.1)
    finally:
        live.query.stop()
    assert live.state.coverage == {"log": 90, "publish": 1090} and [p["anchor_ns"] for p in live.state.pending] == [60]
    (done,) = live.step()
    assert done["status"] == "covered" and [os.path.basename(f) for f in done["filenames"]] == ["60_evt_00.mcap", "60_evt_01.mcap"]
    assert [clip(spark, f) for f in done["filenames"]] == [[(40, b"x40"), (50, b"x50")], [(70, b"y70"), (80, b"y80"), (60, body), (61, b"{}")]]
    assert live.state.pending == [] and live.step() == []
    again = Live(spark, live.params, live.work)  # state outlives the process
    assert again.state.batch == live.state.batch and again.state.next_id == 1
    assert live.prune(10**9) == [] and Live(spark, Params(record_dir=str(folder), out_dir=str(tmp_path / "out"), retention_ns=10), live.work).prune(100) == [0]


def test_grace_cuts_an_empty_clip(spark, tmp_path):
    live = Live(spark, Params(out_dir=str(tmp_path / "out"), grace_ns=30 * SECOND), str(tmp_path / "work"))
    now = 10**18
    assert live.submit(TRIGGER, now_ns=now) is None
    assert live.ready(now + 19) == [] and live.ready(now + 20) == [] and live.ready(now + 20 + 30 * SECOND - 1) == []
    live.state.coverage["log"] = now + 20
    assert len(live.ready(now + 20)) == 1 and live.ready(now + 19) == []
    live.state.coverage["log"] = 0
    (done,) = live.step(now + 20 + 30 * SECOND)
    assert done["status"] == "grace_cut" and clip(spark, done["filenames"][0]) == [] and os.path.basename(done["filenames"][0]) == f"{now}_evt.mcap"


def test_admission_refuses_and_frees(spark, tmp_path):
    live = Live(spark, Params(out_dir=str(tmp_path / "out"), max_active=2), str(tmp_path / "work"))
    assert [live.submit(TRIGGER) for _ in range(3)] == [None, None, "busy"]
    assert live.submit(TRIGGER | {"name": "a/b"}) == "separator" and live.submit(TRIGGER | {"trigger_time": {"sec": 1, "nanosec": 0}}) == "trigger_time"
    live.state.pending.pop()
    assert live.submit(TRIGGER) is None and live.state.refused == {"busy": 1, "separator": 1, "trigger_time": 1}


def test_a_bad_trigger_stops_no_other(spark, tmp_path, monkeypatch):
    live = Live(spark, Params(out_dir=str(tmp_path / "out"), grace_ns=0), str(tmp_path / "work"))
    for name in ("good", "bad", "fine"):
        assert live.submit(TRIGGER | {"name": name}, now_ns=10**18) is None
    true = live.cut
    monkeypatch.setattr(live, "cut", lambda ready, name: (_ for _ in ()).throw(OSError("no space")) if any(p["name"] == "bad" for p in ready) else true(ready, name))
    done = live.step(10**18 + 20)
    assert [(d["name"], d["status"], len(d["filenames"])) for d in done] == [("good", "grace_cut", 1), ("bad", "failed", 0), ("fine", "grace_cut", 1)] and "no space" in done[1]["error"]
    assert live.state.pending == [] and live.state.cutting is None and live.step(10**18 + 30) == []
    assert sorted(n for n in os.listdir(tmp_path / "out") if n.endswith(".mcap")) == [f"{10**18}_fine.mcap", f"{10**18}_good.mcap"]


@pytest.mark.parametrize("crash", ["before", "between", "after"])
def test_a_crash_makes_no_clip_twice(spark, tmp_path, monkeypatch, crash):
    """Crashes before the clips are planned, between two of them, and after all but before they are announced."""
    out, now = tmp_path / "out", 10**18
    live = Live(spark, Params(out_dir=str(out), grace_ns=0), str(tmp_path / "work"))
    for name in ("a", "b"):
        live.submit(TRIGGER | {"name": name}, now_ns=now)

    class Crash(BaseException):
        pass

    def die(*_, **__):
        raise Crash

    if crash == "before":
        monkeypatch.setattr(datasource, "write_clips", die)
    elif crash == "after":
        monkeypatch.setattr(live, "_announce", die)
    else:
        done = datasource.write_clips

        def half(*a, **k):  # as if only the first had been linked, and had not been taken off the staging folder
            clips = done(*a, **k)
            os.unlink(out / f".published-{k['cut']}.jsonl")
            os.link(clips[1]["path"], clips[1]["staged"])
            os.unlink(clips[1]["path"])
            os.link(clips[0]["path"], clips[0]["staged"])
            datasource._durable(str(out / f".plan-{k['cut']}.jsonl"), [{x: c[x] for x in c if x != "path"} for c in clips])
            raise Crash

        monkeypatch.setattr(datasource, "write_clips", half)
    with pytest.raises(Crash):
        live.step(now + 20)
    monkeypatch.undo()
    again = Live(spark, live.params, live.work)
    assert again.state.cutting is None and len(again.state.pending) == (2 if crash == "before" else 0)
    again.step(now + 20)
    Live(spark, live.params, live.work).step(now + 20)
    assert sorted(n for n in os.listdir(out) if n.endswith(".mcap")) == [f"{now}_a.mcap", f"{now}_b.mcap"]
    said = [json.loads(x) for x in (out / "completions.jsonl").read_text().splitlines()]
    assert [(d["name"], [os.path.basename(f) for f in d["filenames"]]) for d in said] == [("a", [f"{now}_a.mcap"]), ("b", [f"{now}_b.mcap"])]
    assert os.listdir(out / ".staging") == [] and not [n for n in os.listdir(out) if n.startswith((".plan", ".published"))]


def test_batches_are_merged_and_unknown_channels_counted(spark, tmp_path, monkeypatch):
    from tidemark.streaming import snapshots

    monkeypatch.setattr(snapshots, "MERGE", 3)
    folder = tmp_path / "rec"
    folder.mkdir()
    out = io.BytesIO()
    w = mcap.Writer(out, "", 0)
    for t in range(10, 60, 10):
        w.add(w.channel("/t", "json"), 0, t, t, b"x%d" % t)
    raw = out.getvalue() + mcap.message_record(9, 0, 35, 35, b"nobody's") + mcap.record(mcap.MESSAGE, b"runt")
    live = Live(spark, Params(record_dir=str(folder), out_dir=str(tmp_path / "out"), grace_ns=0, retention_ns=LONG_MAX), str(tmp_path / "work"))
    live.start()
    try:
        cuts = [len(raw) * k // 6 for k in range(1, 6)] + [len(raw)]
        for a, b in zip([0, *cuts], cuts, strict=False):  # the file grows by pieces
            with open(folder / "a.mcap", "ab") as f:
                f.write(raw[a:b])
            live.query.processAllAvailable()
    finally:
        live.query.stop()
    assert live.state.bounds == {"0": [10, 50, 10, 50]}
    live.index.merge(spark, "scan", live.state.batch)
    files = [e for e in live.index.entries if e.table == "messages"]
    assert len(files) <= 4 and max(e.level for e in files) >= 1 and sorted(os.listdir(tmp_path / "work" / "index" / "messages")) == sorted(f"file={e.file}" for e in files)
    live.submit(TRIGGER, log_ns=30, publish_ns=30, now_ns=60)
    (done,) = live.step(60)
    assert (done["messages"], done["bytes"], done["records_skipped"], done["chunks_dropped"]) == (5, 15, 2, 0)
    assert [t for t, _ in clip(spark, done["filenames"][0])] == [10, 20, 30, 40, 50]


def test_headers_tell_where_records_end():
    """frames() stands where scan() does, reads headers only, and meets the same faults."""
    out = io.BytesIO()
    w = mcap.Writer(out, "zstd", 200_000)
    for t in range(50):
        w.add(w.channel("/t", "json"), 0, t, t, os.urandom(10_000))
    w.close()
    raw = out.getvalue()
    for data in (raw, raw[:-60], raw[:300_000], raw[:20], raw[:8] + mcap.message_record(1, 0, 1, 1, b"x") + b"\x05" + b"\xff" * 8 + b"abc"):
        read, reads = [], []
        for walk, sizes in ((lambda *a: [*mcap.scan(*a)], read), (mcap.frames, reads)):
            state = mcap.Scan()
            walk(lambda at, n, sizes=sizes, data=data: (sizes.append(n), data[at : at + n])[1], len(data), state)
            sizes.append((state.offset, state.ended, str(state.fault)))
        assert read[-1] == reads[-1]
    with pytest.raises(mcap.WrongMagic):
        mcap.frames(lambda at, n: b"not mcap"[at : at + n], 8, mcap.Scan())


def test_exit_codes(spark, tmp_path):
    from tidemark.streaming import live as module

    (tmp_path / "rec").mkdir()
    given = ["--record-dir", str(tmp_path / "rec"), "--out-dir", str(tmp_path / "out"), "--work-dir", str(tmp_path / "work"), "--seconds", "1"]
    assert module.main([*given, "--time-source", "noon"], spark) == 2 and module.main(given, spark) == 0
    (tmp_path / "rec" / "a.mcap").write_bytes(b"not an mcap file")
    assert module.main([*given[:-1], "60"], spark) == 1
