"""Live extraction: recordings are indexed as they grow, and windows are cut when they are covered or their grace is over.

A streaming query adds what it scans to the index (`ingest`; see snapshots.py) and moves the coverage, the largest time
seen on each clock over all recordings; coverage never falls. `step` looks at the pending triggers, of which there are at
most max_active: one is ready once the wall clock has reached its window's end and either coverage has (equality does) or
the grace, which starts when both arrival and end are past, has run out. Ready triggers are cut by the batch operators in
one job and published together; if that fails each is cut alone, and one that fails alone is announced as failed, so no
trigger stops another. Spark's watermarks aren't used: coverage drops no late data, is one for all files, and releases on
equality.

A cut reads a pinned version of the index outside the lock, so indexing, coverage and retention go on while it runs, and
begins when coverage moves, not at the next poll. It plans by extents: their bounds come from the headers of all records,
and what couldn't be read counts for the windows whose planned extents hold it.

Triggers come from recordings (a topic), from any stream of rows (`listen`), such as an inbox folder (`inbox`), or from
`submit`. Those that can't be decoded or are refused are kept with their reasons in the table `dead` (`dead_letters`).

State is a small JSON file that is replaced atomically, once for each batch with all that the batch changes: its number,
coverage, bounds and triggers. So a repeated batch, of recordings or of triggers, changes nothing twice. A cut's name and
figures are in the state before it writes: after a crash its clips are published to the end and announced, each once, or,
if it never came to its plan, cut again. The work and output folders are mounted where the driver and all executors see
them.
"""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.functions import decode
from tidemark.model import LOG, LONG_MAX, MAX_AHEAD_NS, MAX_NAME_BYTES, MAX_ROLL_NS, SECOND, TRIGGER, Params
from tidemark.operators import index, windows
from tidemark.sources import datasource
from tidemark.streaming.snapshots import Entry, Snapshots, joined, overlaps

#: Longest wait between two looks at the pending triggers, whose wall times and grace no coverage tells of.
POLL_S = 0.2
#: Tables of the index by kind of row.
INDEX = {"message": "messages", "channel": "channels", "schema": "schemas", "record": "records"}
#: What became of triggers that weren't taken up; all under one recording_id, -1, so that no retention takes them.
DEAD = T.StructType([
    T.StructField("recording_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("inner_seq", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("of_recording", T.LongType()),
    T.StructField("reason", T.StringType()), T.StructField("name", T.StringType()), T.StructField("log_ns", T.LongType()), T.StructField("publish_ns", T.LongType()), T.StructField("message_encoding", T.StringType()), T.StructField("payload", T.BinaryType()),
])
_WINDOW = T.StructType([T.StructField("trigger_id", T.LongType()), *TRIGGER.fields, T.StructField("anchor_ns", T.LongType()), T.StructField("start_ns", T.LongType()), T.StructField("end_ns", T.LongType()), T.StructField("arrival_ns", T.LongType())])


def refusal(trigger: dict, anchor_ns: int, uses_trigger_time: bool, now_ns: int) -> str | None:
    """Why a trigger is refused, or None; the same checks in the same order as for columns."""
    name, stamp = trigger["name"], trigger["trigger_time"]
    if not uses_trigger_time and (stamp["sec"] or stamp["nanosec"]):
        return "trigger_time"
    for field_ in ("preroll", "postroll"):
        if trigger[f"{field_}_ns"] > MAX_ROLL_NS:
            return field_
    if anchor_ns > now_ns + MAX_AHEAD_NS:
        return "anchor"
    checks = (("empty", not name), ("long", len(name.encode()) > MAX_NAME_BYTES), ("nul", "\0" in name), ("separator", "/" in name or "\\" in name), ("hidden", name.startswith(".")), ("dots", ".." in name))
    return next((why for why, bad in checks if bad), None)


@dataclass
class State:
    batch: int = -1
    #: The last batch of the stream of triggers.
    heard: int = -1
    next_id: int = 0
    coverage: dict[str, int] = field(default_factory=lambda: {"log": 0, "publish": 0})
    pending: list[dict] = field(default_factory=list)
    #: How many triggers were refused, by reason.
    refused: dict[str, int] = field(default_factory=dict)
    #: Paths of the recordings in the index, by id.
    paths: dict[str, str] = field(default_factory=dict)
    #: The first and last time on each clock, log then publish, of recordings with messages.
    bounds: dict[str, list[int]] = field(default_factory=dict)
    #: Encodings of the channels that carry triggers, by recording and channel id.
    taps: dict[str, dict[str, str | None]] = field(default_factory=dict)
    #: The cut under way: its name, its triggers and, once they are known, their figures.
    cutting: dict | None = None


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the triggers in a folder, a line of JSON each; its offsets are Spark's own list of files it has read.

    Files are put there by a rename, whole. Lines that hold no trigger come with an error.
    """
    lines = spark.readStream.schema("value string").text(folder).filter("trim(value) <> ''")
    found = lines.select("value", decode.trigger(F.lit("json"), F.col("value").cast("binary")).alias("d"))
    return found.select("d.trigger.*", "d.error", F.col("value").cast("binary").alias("payload"), F.lit("json").alias("message_encoding"))


class Stalled(RuntimeError):
    """The scan has given no sign of life for too long."""


class _Beats(StreamingQueryListener):
    """When a query last showed progress, or that it has nothing to do."""

    def __init__(self):
        self.last: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = time.monotonic()

    def onQueryProgress(self, event) -> None:
        self.last[str(event.progress.id)] = time.monotonic()

    def onQueryIdle(self, event) -> None:
        self.last[str(event.id)] = time.monotonic()

    def onQueryTerminated(self, event) -> None:
        self.last.pop(str(event.id), None)


class Live:
    def __init__(self, spark: SparkSession, params: Params, work_dir: str):
        self.spark, self.params, self.work = spark, params, work_dir
        datasource.register(spark)
        os.makedirs(work_dir, exist_ok=True)
        os.makedirs(params.out_dir, exist_ok=True)
        self.index = Snapshots(os.path.join(work_dir, "index"), {t: datasource.TABLES[t] for t in INDEX.values()} | {"dead": DEAD})
        self.state = self._load()
        self.query = None
        self.lock = threading.RLock()  # of the state; no cut and no index job runs under it
        self.cutter = threading.Lock()  # of the one cut at a time
        self.moved = threading.Condition(self.lock)
        self.clock = 0 if params.time_source == LOG else 2
        self._recover()
        datasource.reset_staging(params.out_dir)

    def _load(self) -> State:
        try:
            with open(os.path.join(self.work, "state.json")) as f:
                return State(**json.load(f))
        except FileNotFoundError:
            return State()

    def _save(self) -> None:
        path = os.path.join(self.work, "state.json")
        with open(path + ".new", "w") as f:
            json.dump(asdict(self.state), f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(path + ".new", path)

    def start(self) -> None:
        """Begins to scan the recordings."""
        source = self.spark.readStream.format("mcap").option("path", self.params.record_dir).option("table", "all").option("state", os.path.join(self.work, "recordings.json")).load()
        self.query = source.writeStream.foreachBatch(self.ingest).option("checkpointLocation", os.path.join(self.work, "checkpoint")).trigger(processingTime="200 milliseconds").start()

    def ingest(self, batch: DataFrame, batch_id: int) -> None:
        """Indexes a batch, takes up its triggers, and only then moves the coverage that can release them."""
        if batch_id <= self.state.batch:
            return
        self.index.merge(self.spark, "scan", self.state.batch)
        batch = batch.persist()
        try:
            self._ingest(batch, batch_id)
        finally:
            batch.unpersist()

    def _ingest(self, batch: DataFrame, batch_id: int) -> None:
        kinds = F.col("kind")
        of = lambda end, clock: end(F.when(kinds == "message", F.col(clock)))
        met = batch.groupBy("recording_id", "path").agg(
            *[F.count_if(kinds == k).alias(k) for k in INDEX], of(F.min, "log_ns").alias("l0"), of(F.max, "log_ns").alias("l1"), of(F.min, "publish_ns").alias("p0"), of(F.max, "publish_ns").alias("p1"),
        ).collect()  # a row for each recording
        bounds = {str(r["recording_id"]): [r["l0"], r["l1"], r["p0"], r["p1"]] if r["l0"] is not None else [] for r in met}
        written = {}
        for kind, table in INDEX.items():
            if some := {str(r["recording_id"]) for r in met if r[kind]}:
                written[table] = self.index.write(table, batch.filter(kinds == kind)), {r: bounds[r] if kind == "message" else [] for r in some}
        taps = json.loads(json.dumps(self.state.taps))
        if any(r["channel"] for r in met):
            self._tap(batch, taps)
        found = self._recorded(batch, taps) if self.params.trigger_source == "recorded" else None
        with self.lock:
            state = State(**json.loads(json.dumps(asdict(self.state))))
            state.taps = {r: t for r, t in taps.items() if r in state.bounds or r in bounds}
            if found is not None and (dead := self._take(state, found, "scan")) is not None:
                written["dead"] = self.index.write("dead", dead), {"-1": []}
            self.index.add("scan", batch_id, written)
            state.paths |= {str(r["recording_id"]): r["path"] for r in met}
            for rid, b in bounds.items():
                if b:
                    state.bounds[rid] = joined(state.bounds.get(rid, b), b)
                    state.coverage = {"log": max(state.coverage["log"], b[1]), "publish": max(state.coverage["publish"], b[3])}
            state.batch = batch_id
            self.state = state
            self._save()
            self.moved.notify_all()

    def listen(self, triggers: DataFrame):
        """Takes up live triggers from any streaming source of rows with the columns of TRIGGER; error and payload may follow.

        A batch that is repeated after a crash takes up nothing twice, as its number is saved with its triggers.
        """

        def take(batch: DataFrame, batch_id: int) -> None:
            if batch_id <= self.state.heard:
                return
            for name, kind in (("error", "string"), ("payload", "binary"), ("message_encoding", "string")):
                if name not in batch.columns:
                    batch = batch.withColumn(name, F.lit(None).cast(kind))
            none = F.lit(None).cast("long")
            found = batch.select(
                F.when(F.col("error").isNull(), F.struct(*TRIGGER.names)).alias("trigger"), "error", "payload", "message_encoding", none.alias("log_ns"), none.alias("publish_ns"), none.alias("recording_id"), F.monotonically_increasing_id().alias("offset"), F.lit(0).alias("inner_seq")
            ).persist()
            try:
                with self.lock:
                    state = State(**json.loads(json.dumps(asdict(self.state))))
                    if (dead := self._take(state, found, "listen")) is not None:
                        self.index.add("listen", batch_id, {"dead": (self.index.write("dead", dead), {"-1": []})})
                    state.heard = batch_id
                    self.state = state
                    self._save()
                    self.moved.notify_all()
            finally:
                found.unpersist()

        return triggers.writeStream.foreachBatch(take).option("checkpointLocation", os.path.join(self.work, "listen")).start()

    def _tap(self, batch: DataFrame, taps: dict) -> None:
        """Follows a batch's definitions of channels, of which the last one of an id counts, in `taps`."""
        place, what = F.struct("offset", "inner_seq"), F.struct("topic", "message_encoding")
        last = batch.filter("kind = 'channel'").groupBy("recording_id", "channel_id").agg(F.max_by(what, place).alias("d"))
        for r in last.toLocalIterator():  # a row for each channel
            mine = taps.setdefault(str(r["recording_id"]), {})
            if r["d"]["topic"] == self.params.trigger_topic:
                mine[str(r["channel_id"])] = r["d"]["message_encoding"]
            else:
                mine.pop(str(r["channel_id"]), None)

    def _recorded(self, batch: DataFrame, taps: dict) -> DataFrame | None:
        """The trigger records of a batch, decoded, or None if it has none."""
        known = [(int(r), int(c), e) for r, mine in taps.items() for c, e in mine.items()]
        if not known:
            return None
        tapped = batch.filter((F.col("kind") == "message") & F.col("channel_id").isin(sorted({c for _, c, _ in known})))
        if tapped.isEmpty():
            return None
        channels = self.spark.createDataFrame(known, "recording_id long, channel_id int, of_encoding string")
        found = tapped.drop("message_encoding").join(channels.withColumnRenamed("of_encoding", "message_encoding"), ["recording_id", "channel_id"])
        found = found.withColumn("d", decode.trigger(F.col("message_encoding"), F.col("payload")))
        return found.select("d.trigger", "d.error", "payload", "message_encoding", "log_ns", "publish_ns", "recording_id", "offset", "inner_seq").persist()

    def _take(self, state: State, found: DataFrame, source: str) -> DataFrame | None:
        """Takes up triggers in order, in `state`; returns those that aren't, with their reasons, or None."""
        refused, bad = [], 0
        for r in found.coalesce(1).sortWithinPartitions("recording_id", "offset", "inner_seq").toLocalIterator():
            if r["error"] is not None:
                bad += 1
            elif why := self._admit(state, r["trigger"].asDict(recursive=True), r["log_ns"], r["publish_ns"], time.time_ns()):
                refused.append((r["recording_id"], r["offset"], r["inner_seq"], why, r["trigger"]["name"]))
        if bad:
            state.refused["undecodable"] = state.refused.get("undecodable", 0) + bad
        if not bad and not refused:
            return None
        whys = self.spark.createDataFrame(refused, "r long, o long, i int, reason string, name string")
        same = F.col("recording_id").eqNullSafe(F.col("r")) & (F.col("offset") == F.col("o")) & (F.col("inner_seq") == F.col("i"))
        rest = ["log_ns", "publish_ns", "message_encoding", "payload"]
        of = F.col("recording_id").alias("of_recording")
        lost = found.filter("error is not null").select(of, "offset", "inner_seq", F.col("error").alias("reason"), F.lit(None).cast("string").alias("name"), *rest).unionByName(found.filter("error is null").join(whys, same).select(of, "offset", "inner_seq", "reason", "name", *rest))
        return lost.withColumns({"recording_id": F.lit(-1).cast("long"), "source": F.lit(source)})

    def dead_letters(self) -> DataFrame:
        """The triggers that weren't taken up: where they came from, why, and their bodies."""
        with self.index.pinned() as entries:
            return self.index.read(self.spark, "dead", entries).drop("recording_id").withColumnRenamed("of_recording", "recording_id")

    def _admit(self, state: State, trigger: dict, log_ns: int | None, publish_ns: int | None, now: int) -> str | None:
        live, clock = log_ns is None, self.params.time_source
        own = live and clock != LOG
        stamp = trigger["trigger_time"]
        anchor = (now if clock == LOG else max(stamp["sec"], 0) * SECOND + stamp["nanosec"]) if live else log_ns if clock == LOG else publish_ns
        why = refusal(trigger, anchor, own, now)
        if why is None and len(state.pending) >= self.params.max_active:
            why = "busy"
        if why is None:
            window = {"anchor_ns": anchor, "start_ns": max(anchor - trigger["preroll_ns"], 0), "end_ns": min(anchor + trigger["postroll_ns"], LONG_MAX), "arrival_ns": now}
            state.pending.append({"trigger_id": state.next_id} | trigger | window)
            state.next_id += 1
        else:
            state.refused[why] = state.refused.get(why, 0) + 1
        return why

    def submit(self, trigger: dict, log_ns: int | None = None, publish_ns: int | None = None, now_ns: int | None = None) -> str | None:
        """Takes up a trigger: with its record's times if it was recorded. Returns why it was refused, or None."""
        with self.lock:
            why = self._admit(self.state, trigger, log_ns, publish_ns, time.time_ns() if now_ns is None else now_ns)
            self._save()
            self.moved.notify_all()
            return why

    def ready(self, now_ns: int) -> list[dict]:
        covered = self.state.coverage[self.params.time_source]
        return [p for p in self.state.pending if p["end_ns"] <= now_ns and (covered >= p["end_ns"] or now_ns >= max(p["arrival_ns"], p["end_ns"]) + self.params.grace_ns)]

    def step(self, now_ns: int | None = None) -> list[dict]:
        """Cuts what is ready and returns the completions; then forgets what is older than the retention."""
        now = time.time_ns() if now_ns is None else now_ns
        done: list[dict] = []
        with self.cutter:
            with self.lock:
                ready = self.ready(now)
            if ready:
                try:
                    done = self._cut(ready)
                except Exception:  # one of them may be at fault: each alone
                    for p in ready:
                        try:
                            done += self._cut([p])
                        except Exception as e:
                            done += self._announce([p], [self._completion(p, [], "failed") | {"error": str(e)[:500]}])
        self.prune(now)
        return done

    def _cut(self, ready: list[dict]) -> list[dict]:
        """Cuts triggers under a name that a later run can end the cut by."""
        with self.lock:
            self.state.cutting = {"name": uuid.uuid4().hex, "triggers": [p["trigger_id"] for p in ready], "stats": {}}
            self._save()
        context = self.spark.sparkContext
        before = context.getLocalProperty("spark.scheduler.pool")
        context.setLocalProperty("spark.scheduler.pool", "cuts")  # a share of its own beside the scan, under the fair scheduler
        try:
            return self._announce(ready, self.cut(ready, self.state.cutting["name"]))
        finally:
            context.setLocalProperty("spark.scheduler.pool", before)

    def _announce(self, ready: list[dict], done: list[dict]) -> list[dict]:
        """Appends completions, those that aren't there yet, and takes their triggers off."""
        with self.lock:
            path = os.path.join(self.params.out_dir, "completions.jsonl")
            there = {x.get("trigger_id") for x in datasource._lines(path) or []} if self.state.cutting and self.state.cutting.get("again") else set()
            with open(path, "a") as f:
                f.writelines(json.dumps(d) + "\n" for d in done if d["trigger_id"] not in there)
                f.flush()
                os.fsync(f.fileno())
            gone = {p["trigger_id"] for p in ready}
            name = (self.state.cutting or {}).get("name")
            self.state.pending = [p for p in self.state.pending if p["trigger_id"] not in gone]
            self.state.cutting = None
            self._save()
        if name:
            datasource.forget(self.params.out_dir, name)
        return done

    def _recover(self) -> None:
        """Ends a cut that a crash cut off: its clips are published and announced, or its triggers stay pending."""
        if (cutting := self.state.cutting) is None:
            return
        clips = datasource.finish(self.params.out_dir, cutting["name"])
        if clips is None:
            self.state.cutting = None
            self._save()
            return
        cutting["again"] = True
        ready = [p for p in self.state.pending if p["trigger_id"] in cutting["triggers"]]
        self._announce(ready, [self._completion(p, clips) for p in ready])

    def _completion(self, p: dict, clips: list[dict], status: str | None = None) -> dict:
        """A trigger's completion, with the figures of its clips and of its cut."""
        mine = sorted((c for c in clips if c["trigger_id"] == p["trigger_id"]), key=lambda c: c["segment_no"])
        stats = (self.state.cutting or {}).get("stats", {}).get(str(p["trigger_id"]), {})
        covered = self.state.coverage[self.params.time_source] >= p["end_ns"]
        return {
            "trigger_id": p["trigger_id"], "name": p["name"], "filenames": [c["path"] for c in mine], "description": p["description"], "trigger_time": p["trigger_time"], "preroll_ns": p["preroll_ns"],
            "status": status or ("covered" if covered else "grace_cut"), "messages": sum(c["messages"] for c in mine), "bytes": sum(c["bytes"] for c in mine),
            **{k: stats.get(k, 0) for k in ("extents_read", "records_skipped", "chunks_dropped")},
        }

    def cut(self, ready: list[dict], name: str | None = None) -> list[dict]:
        """Writes and publishes the clips of triggers from a pinned version of the index."""
        with self.lock:
            pinned = self.index.pinned()
            entries = pinned.__enter__()
            bounds = {int(r): b for r, b in self.state.bounds.items()}
        try:
            return self._write(ready, name, entries, bounds)
        finally:
            pinned.__exit__(None, None, None)

    def _write(self, ready: list[dict], name: str | None, entries: list[Entry], bounds: dict[int, list[int]]) -> list[dict]:
        clock, at = self.params.time_source, self.clock
        w = self.spark.createDataFrame([{f: p[f] for f in _WINDOW.names} for p in ready], _WINDOW)
        pairs = [(p["trigger_id"], r) for p in ready for r, b in sorted(bounds.items()) if overlaps(b, at, p["start_ns"], p["end_ns"])]
        planned = {str(r) for _, r in pairs}
        near = lambda r, b: r in planned and any(overlaps(b, at, p["start_ns"], p["end_ns"]) for p in ready)
        of = lambda r, _: r in planned
        messages = self.index.read(self.spark, "messages", entries, near)
        stamp = "log_ns" if clock == LOG else "publish_ns"
        messages = messages.filter(F.col(stamp).between(min(p["start_ns"] for p in ready), max(p["end_ns"] for p in ready)))
        records = self.index.read(self.spark, "records", entries, of)
        channels = index.resolved_channels(self.index.read(self.spark, "channels", entries, of), self.index.read(self.spark, "schemas", entries, of))
        every = windows.matches(w, messages, clock=clock).join(channels.select("recording_id", "channel_id", "topic", "message_encoding", "metadata", "schema"), ["recording_id", "channel_id"], "left")
        plan = index.planned(w, index.extents(records, limit=self.params.extent_bytes), clock=clock)
        stats = {str(r["trigger_id"]): r.asDict() for r in index.clip_stats(w, every, plan, records.filter("damaged")).collect()}  # a row for each trigger
        with self.lock:
            if self.state.cutting is not None:
                self.state.cutting["stats"] = stats
                self._save()
        found = every.filter("topic is not null")
        counted = found.groupBy("trigger_id", "recording_id").agg(F.count("*").alias("messages"))
        named = windows.file_names(w, windows.segments(w, self.spark.createDataFrame(pairs, "trigger_id long, recording_id long"), counted))
        body = found.drop("start_ns", "end_ns", "stamp_ns").withColumnRenamed("trigger_id", "of_trigger")
        names = named.select("trigger_id", F.col("recording_id").alias("of_recording"), "segment_no", "filename")
        rows = names.join(body, (F.col("trigger_id") == F.col("of_trigger")) & (F.col("of_recording") == F.col("recording_id")), "left")
        clips = datasource.write_clips(rows, self.params.out_dir, self.params.compression, cut=name, parallelism=self.params.parallelism)
        with self.lock:
            return [self._completion(p, clips) for p in ready]

    def prune(self, now_ns: int) -> list[int]:
        """Recordings, other than the newest, whose last log time is older than the retention leave the index."""
        with self.lock:
            last = {int(r): b[1] for r, b in self.state.bounds.items()}
            gone = [r for r, at in last.items() if r != max(last) and at < max(now_ns - self.params.retention_ns, 0)]
            if not gone:
                return []
            self.index.prune([str(r) for r in gone])
            for r in gone:
                path = self.state.paths.pop(str(r), None)
                self.state.taps.pop(str(r), None)
                del self.state.bounds[str(r)]
                if self.params.delete_pruned and path and path not in self.state.paths.values() and os.path.exists(path):
                    os.unlink(path)
            self._save()
            return gone

    def run(self, seconds: float, on_done=print, stopped=lambda: False) -> None:
        """Scans and cuts for a time, or until it is to stop; a failed scan ends it with its error, a hung one with Stalled."""
        beats = _Beats()
        self.spark.streams.addListener(beats)
        self.start()
        heard = self.listen(inbox(self.spark, self.params.inbox)) if self.params.inbox else None
        end, hung = time.monotonic() + seconds, False
        watched = [q for q in (self.query, heard) if q is not None]
        for q in watched:
            beats.last.setdefault(str(q.id), time.monotonic())
        try:
            while time.monotonic() < end and not stopped():
                for q in watched:
                    if not q.isActive:
                        raise q.exception() or RuntimeError("the scan ended")
                    if time.monotonic() - beats.last.get(str(q.id), end) > self.params.stall_s:
                        hung = True
                        raise Stalled(f"no sign of life for {self.params.stall_s} s")
                for done in self.step():
                    on_done(done)
                with self.moved:
                    self.moved.wait(POLL_S)
        finally:
            self.spark.streams.removeListener(beats)
            for q in watched:
                if not hung:
                    q.stop()


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs until a signal or the time is up. Exit codes: 0 for a stop that was asked for, 1 for a failed scan, 2 for wrong settings."""
    parser = argparse.ArgumentParser(prog="tidemark.streaming.live")
    parser.add_argument("--work-dir", required=True)
    parser.add_argument("--seconds", type=float, default=float("inf"))
    for name, kind in Params.__annotations__.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type={"int": int, "float": float, "bool": lambda x: x.lower() in ("1", "true", "yes")}.get(kind, str))
    given = vars(parser.parse_args(arguments))
    work, seconds = given.pop("work_dir"), given.pop("seconds")
    try:
        params = Params.load(given, dict(os.environ))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    stop = threading.Event()
    before = {s: signal.signal(s, lambda *_: stop.set()) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        Live(spark or SparkSession.builder.getOrCreate(), params, work).run(seconds, lambda d: print(json.dumps(d), flush=True), stop.is_set)
    except Exception as e:
        print(f"the scan failed: {e}", file=sys.stderr)
        return 1
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)
    return 0


if __name__ == "__main__":
    sys.exit(main())
