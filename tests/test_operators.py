import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage, discovery, index, windows
from tidemark.plans import queries

MESSAGE = "recording_id long, offset long, log_ns long, publish_ns long, size long, topic string"


def messages(spark, rows):
    return spark.createDataFrame([(r, k, log, publish, 1, topic) for k, (r, log, publish, topic) in enumerate(rows)], MESSAGE)


def window(spark, *spans):
    return spark.createDataFrame([(k, a, b, a, a, "evt") for k, (a, b) in enumerate(spans)], "trigger_id long, start_ns long, end_ns long, anchor_ns long, log_ns long, name string")


def stamps(df):
    return sorted(r["stamp_ns"] for r in df.collect())


def test_both_ends_belong_to_a_window(spark):
    m = messages(spark, [(0, t, t, "/t") for t in (50, 100, 150, 200, 250)])
    assert stamps(windows.matches(window(spark, (100, 200)), m)) == [100, 150, 200]


def test_the_clock_decides_membership(spark):
    m = messages(spark, [(0, 100, 250, "/t"), (0, 200, 150, "/t"), (0, 300, 350, "/t")])
    w = window(spark, (180, 320))
    assert sorted(r["log_ns"] for r in windows.matches(w, m).collect()) == [200, 300]
    assert sorted(r["log_ns"] for r in windows.matches(w, m, clock="publish").collect()) == [100]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_the_join_equals_brute_force(spark, width):
    random.seed(width)
    spans = [(a := random.randrange(300), a + random.randrange(60)) for _ in range(40)]
    times = [random.randrange(400) for _ in range(200)]
    m = messages(spark, [(0, t, t, "/t") for t in times])
    found = sorted((r["trigger_id"], r["offset"]) for r in windows.matches(window(spark, *spans), m, width=width).collect())
    assert found == sorted((k, i) for k, (a, b) in enumerate(spans) for i, t in enumerate(times) if a <= t <= b)
    inside = windows.envelope(m, window(spark, *spans))
    assert inside.count() == sum(min(a for a, _ in spans) <= t <= max(b for _, b in spans) for t in times)


@pytest.fixture
def conf(spark):
    """Sets the session's settings until the test is over."""
    before = {}

    def put(**values):
        for k, v in values.items():
            k = "spark.sql." + k.replace("_", ".")
            before.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, str(v))

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("least", [windows.LEAST_PAIRS, 0])
def test_clips_come_whole_and_in_file_order(spark, monkeypatch, conf, least):
    """Each window's rows together, by recording and place, equal to brute force for widths and stamps of any size; with
    and without split cells, under adaptive plans that would split or reorder any skewed side of a join that lets them."""
    monkeypatch.setattr(windows, "LEAST_PAIRS", least)
    conf(adaptive_enabled="true", adaptive_skewJoin_enabled="true", adaptive_skewJoin_skewedPartitionThresholdInBytes="1KB", adaptive_skewJoin_skewedPartitionFactor="1.1", adaptive_advisoryPartitionSizeInBytes="1KB")
    random.seed(4)
    far = 2**63 - 1
    spans = [(a := random.randrange(-300, 300), a + random.choice([0, 1, 3, 9, 60, 500])) for _ in range(40)]
    spans += [(0, far), (-far, far), (far - 5, far), (-far, 5 - far), (10, 9), (-5, 5 << 40)]
    times = [random.randrange(-400, 800) for _ in range(200)] + [far, -far, far - 1, 1 << 40, None]
    rows = [(random.randrange(3), t, t, "/t") for t in times]
    got = windows.clips(window(spark, *spans), messages(spark, rows)).select("trigger_id", "recording_id", "offset", "stamp_ns").rdd.glom().collect()
    got = [tuple(r) for part in got for r in part]
    seen = [k for k, _ in itertools.groupby(r[0] for r in got)]
    assert len(seen) == len(set(seen))
    want = sorted((k, r, i, t) for k, (a, b) in enumerate(spans) for i, (r, t, _, _) in enumerate(rows) if t is not None and a <= t <= b)
    assert sorted(got, key=lambda r: r[0]) == want
    assert windows.clips(window(spark, (0, 9)).limit(0), messages(spark, rows)).count() == 0


def test_a_hot_moment_is_joined_in_all_tasks(spark, monkeypatch, conf):
    """Messages of one second in 200 windows, beside others: 16 tasks with about equal work, and whole clips in order."""
    monkeypatch.setattr(windows, "LEAST_PAIRS", 1000)
    conf(shuffle_partitions=16)
    n, at = 2000, 10**9
    rows = spark.range(n + 200).select(F.col("id").alias("offset"), F.pmod("id", F.lit(3)).alias("recording_id"), F.when(F.col("id") < n, at + F.pmod(F.col("id") * 7919, F.lit(1000))).otherwise(F.col("id") * 10**10).alias("log_ns"))
    m = rows.withColumn("publish_ns", F.col("log_ns"))
    spans = [(at - k * 1000, at + 1_000_000 - k) for k in range(200)] + [(k * 10**10, k * 10**10 + 500_000) for k in range(2000, 2100)]
    got = windows.clips(window(spark, *spans), m).select("trigger_id", "recording_id", "offset").rdd.glom().collect()
    sizes = sorted(len(part) for part in got)
    assert len(sizes) == 16 and sum(sizes) == 200 * n + 100 and sizes[-1] < 1.3 * sizes[8]
    rows = [tuple(r) for part in got for r in part]
    clips = [[x[1:] for x in group] for _, group in itertools.groupby(rows, key=lambda r: r[0])]
    assert len(clips) == 300 and all(c == sorted(c) for c in clips) and {len(c) for c in clips} == {1, n}


@pytest.mark.parametrize("least", [windows.LEAST_PAIRS, 0])
def test_clips_without_order_are_the_same_rows(spark, monkeypatch, least):
    monkeypatch.setattr(windows, "LEAST_PAIRS", least)
    random.seed(5)
    far = 2**63 - 1
    spans = [(a := random.randrange(0, 300), a + random.choice([0, 1, 3, 9, 60, 500])) for _ in range(40)]
    spans += [(0, far), (-far, far), (far - 5, far), (-300, 5), (-9, -3), (10, 9), (3, 5 << 40), (16, 31), (15, 16), (31, 47)]
    times = [random.randrange(-400, 800) for _ in range(200)] + [0, 15, 16, 31, 32, far, -far, far - 1, 1 << 40, None]
    rows = [(random.randrange(3), t, t, "/t") for t in times]
    got = windows.clips(window(spark, *spans), messages(spark, rows), ordered=False).select("trigger_id", "recording_id", "offset", "stamp_ns").collect()
    assert sorted(map(tuple, got)) == sorted((k, r, i, t) for k, (a, b) in enumerate(spans) for i, (r, t, _, _) in enumerate(rows) if t is not None and a <= t <= b)


def test_clips_deal_each_side_once(spark):
    """One exchange a side, ordered or not, and a message is one row of it if there is no order to keep."""
    rows = [(0, k * 10, k * 10, "/t") for k in range(50)]
    for ordered, copies in ((True, 2), (False, 1)):
        found = windows.clips(window(spark, (0, 50), (100, 160)), messages(spark, rows), ordered=ordered)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        plan = plan.initialPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
        assert str(plan.toString()).count("Exchange ") == 2
        assert str(plan.toString()).count("array(struct(level") == 1 and str(plan.toString()).split("array(struct(level")[1].split(")]")[0].count("struct(") == copies - 1


def test_clips_without_order_come_message_by_message(spark):
    """A message's rows are together, so that what repeats in them takes little room where they are written."""
    rows = [(0, k * 7 % 50, k * 7 % 50, "/t") for k in range(50)]
    parts = windows.clips(window(spark, (0, 49), (0, 45), (5, 49)), messages(spark, rows), ordered=False).select("recording_id", "offset").rdd.glom().collect()
    runs = [k for part in parts for k, _ in itertools.groupby(map(tuple, part))]
    assert len(runs) == len(set(runs)) == 50


def test_a_hot_moment_without_order_is_joined_in_all_tasks(spark, monkeypatch, conf):
    monkeypatch.setattr(windows, "LEAST_PAIRS", 1000)
    conf(shuffle_partitions=16)
    n, at = 2000, 10**9
    m = spark.range(n).select(F.col("id").alias("offset"), F.lit(0).alias("recording_id"), (at + F.pmod(F.col("id") * 7919, F.lit(1000))).alias("log_ns")).withColumn("publish_ns", F.col("log_ns"))
    sizes = sorted(len(part) for part in windows.clips(window(spark, *[(at - k * 1000, at + 1_000_000 - k) for k in range(200)]), m, ordered=False).select("trigger_id", "offset").rdd.glom().collect())
    assert len(sizes) == 16 and sum(sizes) == 200 * n and sizes[-1] < 1.3 * sizes[8]


def test_hot_cells_are_bounded_in_number(spark, monkeypatch):
    monkeypatch.setattr(windows, "LEAST_PAIRS", 0)
    timed = spark.createDataFrame([(k, 0, 0, 0, k % 50) for k in range(500)], "trigger_id long, start_ns long, end_ns long, level int, cell long")
    cells = spark.range(5000).select(F.lit(0).alias("level"), F.pmod("id", F.lit(50)).alias("cell"))
    hot = windows._hot(timed, cells, 4)
    assert len(hot) <= windows.PARTS * 4 and sum(r["groups"] for r in hot) <= 2 * windows.PARTS * 4
    assert len(windows._hot(timed, cells, 100)) == 50


@pytest.mark.parametrize("name", ["clip_messages", "clip_messages_publish"])
def test_joined_clips_are_not_shuffled(spark, sf, name):
    """The rows of overlapping windows grow with the square of the input, so only the join's inputs may be."""
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Exchange" not in plan[: plan.index("Join")]


def test_places_are_numbered_without_a_shuffle_of_clips(spark, sf, conf):
    """The rows above the join stay where they are; clips over many small batches, against a count by clip."""
    conf(execution_arrow_maxRecordsPerBatch=3)
    found = queries.clip_order(spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Exchange" not in plan[: plan.index("Join")]
    rows = sorted(tuple(r) for r in found.collect())
    assert rows and all(r[3] == k for _, group in itertools.groupby(rows, key=lambda r: r[0]) for k, r in enumerate(group))


def test_channels_are_counted_without_a_sort_of_joined_rows(spark):
    """Copies of windows and messages: each clip's channels by brute force; above the join rows are hashed, not sorted."""
    random.seed(6)
    rows = [(random.randrange(2), t := random.randrange(60), t, random.choice("abc")) for _ in range(150)]
    spans = [random.choice([(0, 9), (5, 30), (40, 70)]) for _ in range(12)] + [(100, 110)]
    w, m = window(spark, *spans), messages(spark, rows)
    found = windows.once_each(w, lambda one: windows.used_channels(windows.matches(one, m)))
    want = []
    for k, (a, b) in enumerate(spans):
        inside = sorted((r, i, topic) for i, (r, t, _, topic) in enumerate(rows) if a <= t <= b)
        order = list(dict.fromkeys(x[2] for x in inside))
        want += [(k, topic, n, sum(x[2] == topic for x in inside)) for n, topic in enumerate(order)]
    assert sorted(tuple(r) for r in found.select("trigger_id", "topic", "channel_no", "messages").collect()) == sorted(want)
    plan = windows.used_channels(windows.matches(w, m))._jdf.queryExecution().executedPlan().toString()
    lines = plan[: plan.index("Join")].splitlines()
    last = next(x for x in reversed(lines) if "Aggregate" in x)
    assert "HashAggregate" in last and "partial_min(offset" in last


@pytest.mark.parametrize("name", ["late_loss", "pruned_equals_full", "unknown_channel_skips", "clip_stats"])
def test_joined_rows_are_counted_where_they_are(spark, sf, name):
    """Above the join of windows and messages comes a count before anything is moved or joined again."""
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*0123456789()"))
    joins = [k for k, x in enumerate(plan) if "Join" in x and "stamp_ns" in x]
    assert joins
    for k in joins:
        above, at = [], depth(plan[k])
        for x in reversed(plan[:k]):
            if depth(x) < at:
                at = depth(x)
                above.append(x.lstrip(" :+-*0123456789()"))
        assert next(x for x in above if not x.startswith(("Project", "Filter"))).startswith("HashAggregate"), above[:3]


def test_late_messages_are_counted_by_both_times(spark):
    """Copies of messages and windows, windows that aren't released, and messages at the release itself, by brute force."""
    random.seed(8)
    rows = [(0, random.randrange(100), random.randrange(100), "/t") for _ in range(120)] * 2
    w = spark.createDataFrame([(k, a := random.randrange(90), a + random.randrange(20), random.choice([None, 30, 60])) for k in range(30)], "trigger_id long, start_ns long, end_ns long, release_ns long")
    want = {r["trigger_id"]: n for r in w.collect() if r["release_ns"] and (n := sum(r["start_ns"] <= p <= r["end_ns"] and log > r["release_ns"] for _, log, p, _ in rows))}
    assert {r["trigger_id"]: r["late"] for r in coverage.late(w, messages(spark, rows), clock="publish").collect()} == want


def test_overlaps_come_once(spark):
    ranges = spark.createDataFrame([(0, 100, 200), (1, 0, 1000), (2, None, None)], "recording_id long, min_ns long, max_ns long")
    w = window(spark, (200, 500), (0, 100), (201, 500), (0, 99))
    found = sorted((r["trigger_id"], r["recording_id"]) for r in windows.overlapping(w, ranges, ["recording_id"], width=30).collect())
    assert found == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 1), (3, 1)]


def segments(spark, files, span):
    m = messages(spark, [(r, t, t, "/t") for r, times in enumerate(files) for t in times])
    w = window(spark, span)
    ranges = index.bounds(m).select("recording_id", F.col("log_min").alias("min_ns"), F.col("log_max").alias("max_ns"))
    counted = windows.matches(w, m).groupBy("trigger_id", "recording_id").agg(F.count("*").alias("messages"))
    named = windows.file_names(w, windows.segments(w, windows.overlapping(w, ranges, ["recording_id"]), counted))
    return [(r["filename"], r["recording_id"], r["messages"]) for r in named.orderBy("segment_no").collect()]


def test_segments(spark):
    files = [[1000, 2000], [5000, 6000]]
    assert segments(spark, files, (1500, 5500)) == [("1500_evt_00.mcap", 0, 1), ("1500_evt_01.mcap", 1, 1)]
    assert segments(spark, files, (100, 600)) == [("100_evt.mcap", None, 0)]
    assert segments(spark, files, (1200, 1300)) == [("1200_evt.mcap", 0, 0)]
    assert segments(spark, [[1000, 3000], [2500, 9000]], (2600, 2700)) == [("2600_evt.mcap", 0, 0)]
    assert segments(spark, [[1000, 2000], [1400, 9000]], (1500, 5500)) == [("1500_evt.mcap", 0, 1)]


def test_colliding_names(spark):
    names = spark.createDataFrame([(0, "a.mcap"), (1, "a.mcap"), (2, "b.mcap")], "trigger_id long, filename string")
    assert [r["published_name"] for r in windows.without_collisions(names, ["trigger_id"]).orderBy("trigger_id").collect()] == ["a.mcap", "a_1.mcap", "b.mcap"]


def extents(spark, rows, limit):
    r = spark.createDataFrame(rows, "recording_id long, offset long, len long, log_ns long, publish_ns long")
    return index.extents(r, limit=limit).orderBy("recording_id", "extent_no").collect()


def test_extents_tile_and_close_once_full(spark):
    mib = 1 << 20
    e = extents(spark, [(0, 8 + k * mib, mib, 10 * k, 10 * k) for k in range(9)], 4 * mib)
    assert [(x["offset"], x["len"], x["records"]) for x in e] == [(8, 4 * mib, 4), (8 + 4 * mib, 4 * mib, 4), (8 + 8 * mib, mib, 1)]
    e = extents(spark, [(0, 8 + k * 5 * mib, 5 * mib, k, k) for k in range(3)], 4 * mib)
    assert [x["records"] for x in e] == [1, 1, 1]
    e = extents(spark, [(0, 8, 5, None, None), (0, 13, 5, 100, 7), (0, 18, 5, 50, 9), (1, 8, 5, None, None)], 1000)
    assert [(x["log"] and tuple(x["log"]), x["publish"] and tuple(x["publish"])) for x in e] == [((50, 100), (7, 9)), (None, None)]


def test_overlap_is_in_the_chosen_clock(spark):
    e = index.extents(spark.createDataFrame([(0, 8, 5, 100, 900), (0, 13, 5, 200, 1000), (0, 18, 5, 300, 1100)], "recording_id long, offset long, len long, log_ns long, publish_ns long"))
    w = window(spark, (250, 400), (950, 1050))
    assert [r["trigger_id"] for r in index.planned(w, e, clock="log").collect()] == [0]
    assert [r["trigger_id"] for r in index.planned(w, e, clock="publish").collect()] == [1]


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_running_maximum_never_falls(spark, chunk):
    random.seed(chunk)
    times = [random.randrange(1000) for _ in range(50)]
    m = messages(spark, [(k // 20, t, t, "/t") for k, t in enumerate(times)])
    found = [r["high_ns"] for r in index.running_high(m, F.col("log_ns"), chunk=chunk).orderBy("offset").collect()]
    assert found == [max(times[: k + 1]) for k in range(50)]
    assert tuple(index.high_water(m).first()) == (max(times), max(times))
    assert tuple(index.high_water(m.limit(0)).first()) == (0, 0)


def test_channels_resolve_their_schemas(spark):
    c = spark.createDataFrame([(0, 1, "/old", 5, 1), (0, 1, "/new", 5, 2), (0, 2, "/raw", 0, 3), (0, 3, "/dangling", 9, 4)], "recording_id long, channel_id int, topic string, schema_id int, offset long")
    s = spark.createDataFrame([(0, 5, "S", "e", b"", 9), (0, 0, "zero", "e", b"", 9)], "recording_id long, schema_id int, name string, encoding string, data binary, offset long")
    found = {r["topic"]: r["schema"] and r["schema"]["name"] for r in index.resolved_channels(c, s).collect()}
    assert found == {"/new": "S", "/raw": None, "/dangling": None}


@pytest.mark.parametrize("width", [1, 10, 10_000])
def test_first_passage_equals_brute_force(spark, width):
    random.seed(width)
    rows = [(random.randrange(500), k) for k in range(80)]
    points = [random.randrange(-5, 520) for _ in range(40)]
    m = spark.createDataFrame(rows, "v long, at long")
    p = spark.createDataFrame(list(enumerate(points)), "trigger_id long, at_ns long")
    found = [r["passed_ns"] for r in coverage.first_passage(p, m, F.col("v"), F.col("at"), width=width).orderBy("trigger_id").collect()]
    assert found == [min((a for v, a in rows if v >= x), default=None) for x in points]


def test_status(spark):
    w = window(spark, (0, 100))
    status = lambda covered, now: coverage.cut_status(w, F.lit(covered), F.lit(now), 30).first()["status"]
    assert [status(100, 99), status(100, 100), status(99, 100), status(99, 129), status(99, 130)] == ["pending", "covered", "pending", "pending", "grace_cut"]


def test_retention_keeps_the_current_and_the_empty(spark):
    f = spark.createDataFrame([(0, 1000), (1, None), (2, 5000), (3, 10)], "recording_id long, log_max long")
    s = coverage.states(f, F.col("recording_id") < 3)
    gone = lambda now: [r["recording_id"] for r in s.filter(coverage.pruned(s, F.lit(now), 1000)).orderBy("recording_id").collect()]
    assert gone(2000) == [] and gone(2001) == [0] and gone(2**62) == [0, 2]
    assert [(r["state"], r["has_successor"], r["is_current"]) for r in s.orderBy("recording_id").collect()] == [("Ended", True, False)] * 3 + [("Tailing", False, True)]


def test_admission(spark):
    rows = [(0, k, k, 100, None) for k in range(17)] + [(0, 17, 100, 200, None), (0, 18, 101, 300, "name")]
    t = spark.createDataFrame(rows, "recording_id long, trigger_id long, log_ns long, finish_ns long, reject_reason string")
    assert [r["admitted"] for r in coverage.admitted(t).orderBy("trigger_id").collect()] == [True] * 16 + [False, True, False]


@pytest.mark.parametrize(("limit", "part", "sizes"), [(100, 64, (7,)), (100, 1000, (7, 30, 1)), (50, 333, (10,)), (10**9, 100, (9, 90)), (1, 200, (5, 40)), (500, 10**9, (3, 200, 700)), (40, 1, (20, 60, 13))])
def test_extents_of_parts_equal_the_fold(spark, limit, part, sizes):
    """Recordings cut into parts of any size, with extents that span parts and parts that span extents; record by record."""
    random.seed(limit)
    rows, want = [], []
    for r in range(4):
        at, number, held = 8, 0, []
        for k in range(random.choice([1, 3, 300])):
            size = random.choice(sizes)
            times = (k * 3 % 50, 100 - k) if k % 5 else (None, None)
            rows.append((r, at, size, *times))
            held.append(rows[-1])
            at += size
            if sum(x[2] for x in held) >= limit:
                want.append((r, number, held))
                number, held = number + 1, []
        want += [(r, number, held)] if held else []
    span = lambda held, k: (min(x), max(x)) if (x := [h[k] for h in held if h[k] is not None]) else None
    want = [(r, n, held[0][1], sum(h[2] for h in held), len(held), span(held, 3), span(held, 4)) for r, n, held in want]
    df = spark.createDataFrame(rows, "recording_id long, offset long, len long, log_ns long, publish_ns long")
    got = index.extents(df, limit=limit, part=part)
    assert sorted((*r[:5], r[5] and tuple(r[5]), r[6] and tuple(r[6])) for r in got.collect()) == want
    assert index.extents(df.limit(0), limit=limit, part=part).collect() == []


@pytest.mark.parametrize("spell", [3, 40, 10**6])
def test_one_admission_count_over_all_sources(spark, conf, spell):
    """Ranges of arrival, busy spells shorter and longer than a range, against the fold over all triggers."""
    conf(shuffle_partitions=8, adaptive_coalescePartitions_enabled="false")
    random.seed(spell)
    rows = []
    for k in range(400):
        at = random.randrange(1000)
        rows.append((k % 3, k, at, at + random.randrange(1, spell + 2), "name" if k % 11 == 0 else None))
    t = spark.createDataFrame(rows, "recording_id long, trigger_id long, log_ns long, finish_ns long, reject_reason string")
    active, want = [], {}
    for _, k, at, finish, reason in sorted(rows, key=lambda r: (r[2], r[1])):
        active = [x for x in active if x > at]
        want[k] = reason is None and len(active) < 3
        active += [finish] if want[k] else []
    found = coverage.admitted(t, limit=3, by=None)
    assert {r["trigger_id"]: r["admitted"] for r in found.collect()} == want and found.rdd.getNumPartitions() == 8
    assert coverage.admitted(t.limit(0), by=None).collect() == []


def test_admission_rounds_do_not_grow_with_partitions(spark, conf):
    """Slots that stay taken throughout: ranges never forget, and there are at most as many jobs as ranges, however many partitions."""
    conf(shuffle_partitions=64, adaptive_coalescePartitions_enabled="false")
    random.seed(9)
    rows = [(0, k, k // 2 * 10, k // 2 * 10 + random.randrange(190, 210), None) for k in range(600)]
    t = spark.createDataFrame(rows, "recording_id long, trigger_id long, log_ns long, finish_ns long, reject_reason string").coalesce(1)
    active, want = [], {}
    for _, k, at, finish, _ in rows:
        active = [x for x in active if x > at]
        want[k] = len(active) < 3
        active += [finish] if want[k] else []
    spark.sparkContext.setJobGroup("admission", "admission")
    try:
        got = {r["trigger_id"]: r["admitted"] for r in coverage.admitted(t, limit=3, by=None).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("admission"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == want and jobs <= 3 * coverage.LEAST_RANGES + 6


def test_discovery(spark):
    f = spark.createDataFrame([("a", 1, 5), ("b", 2, 3), ("b2", 2, 3), ("c", 3, 9)], "path string, inode long, mtime long")
    assert discovery.newest(f, "mtime", "path").first()["path"] == "c"
    assert discovery.oldest(f, "mtime", "path").first()["path"] == "b"
    assert discovery.oldest(f.limit(0), "mtime", "path").count() == 0
    assert sorted(r["inode"] for r in discovery.unseen(f, f.filter("inode = 3"), ["inode"]).collect()) == [1, 2]


def test_wild_ranges_meet_their_windows(spark):
    """Ranges of any width, from a stamp of 0 to the largest long, against pair by pair."""
    import random

    from tidemark.model import LONG_MAX, MINUTE
    from tidemark.operators import windows

    rng = random.Random(7)
    now = 1_700_000_000_000_000_000
    spans = [(0, now), (0, 0), (0, LONG_MAX), (LONG_MAX, LONG_MAX), (now, LONG_MAX), (now, now), (None, None)]
    spans += [(now + a, now + a + rng.choice([0, MINUTE, 500 * MINUTE, 10**6 * MINUTE])) for a in (rng.randrange(-(10**6), 10**6) * MINUTE for _ in range(60))]
    starts = [0, LONG_MAX - MINUTE, now, now - MINUTE] + [now + rng.randrange(-(10**6), 10**6) * MINUTE for _ in range(40)]
    given = [(k, s, min(s + rng.randrange(60) * MINUTE, LONG_MAX)) for k, s in enumerate(starts)]
    w = spark.createDataFrame(given, "trigger_id long, start_ns long, end_ns long")
    r = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(spans)], "recording_id long, min_ns long, max_ns long")
    found = sorted((x["trigger_id"], x["recording_id"]) for x in windows.overlapping(w, r, ["recording_id"]).collect())
    assert found == sorted((t, k) for t, s, e in given for k, (a, b) in enumerate(spans) if a is not None and b >= s and a <= e)


def test_first_passage_equals_brute_force(spark, width):
    random.seed(width)
    rows = [(random.randrange(500), k) for k in range(80)]
    points = [random.randrange(-5, 520) for _ in range(40)]
    m = spark.createDataFrame(rows, "v long, at long")
    p = spark.createDataFrame(list(enumerate(points)), "trigger_id long, at_ns long")
    found = [r["passed_ns"] for r in coverage.first_passage(p, m, F.col("v"), F.col("at"), width=width).orderBy("trigger_id").collect()]
    assert found == [min((a for v, a in rows if v >= x), default=None) for x in points]


def test_wild_ranges_meet_their_windows(spark):
    """Ranges of any width, from a stamp of 0 to the largest long, against pair by pair."""
    import random

    from tidemark.model import LONG_MAX, MINUTE
    from tidemark.operators import windows

    rng = random.Random(7)
    now = 1_700_000_000_000_000_000
    spans = [(0, now), (0, 0), (0, LONG_MAX), (LONG_MAX, LONG_MAX), (now, LONG_MAX), (now, now), (None, None)]
    spans += [(now + a, now + a + rng.choice([0, MINUTE, 500 * MINUTE, 10**6 * MINUTE])) for a in (rng.randrange(-(10**6), 10**6) * MINUTE for _ in range(60))]
    starts = [0, LONG_MAX - MINUTE, now, now - MINUTE] + [now + rng.randrange(-(10**6), 10**6) * MINUTE for _ in range(40)]
    given = [(k, s, min(s + rng.randrange(60) * MINUTE, LONG_MAX)) for k, s in enumerate(starts)]
    w = spark.createDataFrame(given, "trigger_id long, start_ns long, end_ns long")
    r = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(spans)], "recording_id long, min_ns long, max_ns long")
    found = sorted((x["trigger_id"], x["recording_id"]) for x in windows.overlapping(w, r, ["recording_id"]).collect())
    assert found == sorted((t, k) for t, s, e in given for k, (a, b) in enumerate(spans) if a is not None and b >= s and a <= e)
    leveled = windows.overlapping(w, r, ["recording_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in leveled


def test_first_passage_equals_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    from tidemark.model import LONG_MAX
    from tidemark.operators import coverage

    rng = random.Random(8)
    now = 1_700_000_000_000_000_000
    value = lambda: rng.choice([0, LONG_MAX, now + rng.randrange(10**14), rng.randrange(LONG_MAX)])
    for wild in (False, True):
        rows = [(value() if wild else now + rng.randrange(10**13), k) for k in range(200)]
        points = [(k, rng.choice(rows)[0] if k % 2 else value() if wild else now + rng.randrange(10**13)) for k in range(40)]
        m = spark.createDataFrame(rows, "v long, t long")
        p = spark.createDataFrame(points, "trigger_id long, at_ns long")
        found = {r["trigger_id"]: r["passed_ns"] for r in coverage.first_passage(p, m, F.col("v"), F.col("t")).collect()}
        assert found == {k: min((t for v, t in rows if v >= at), default=None) for k, at in points}


def test_runts_are_skipped_and_chunks_dropped(spark):
    from tidemark.operators import index

    w = spark.createDataFrame([(0, 5, 40), (1, 5, 30)], "trigger_id long, start_ns long, end_ns long")
    plan = spark.createDataFrame([(0, 7, 8, 100), (0, 7, 108, 5 << 20), (1, 7, 8, 100)], "trigger_id long, recording_id long, offset long, len long")
    bad = spark.createDataFrame([(7, 8, 5), (7, 60, 6), (7, 70, 4), (7, 5 << 20, 6), (8, 8, 5), (7, 6 << 20, 5)], "recording_id long, offset long, opcode int")
    found = spark.createDataFrame([(0, "/t", 3), (0, None, 9)], "trigger_id long, topic string, size long")
    stats = index.clip_stats(w, found, plan, bad).orderBy("trigger_id").collect()
    assert [(r["extents_read"], r["messages_copied"], r["bytes_copied"], r["records_skipped"], r["chunks_dropped"]) for r in stats] == [(2, 1, 3, 2, 2), (1, 0, 0, 1, 1)]
