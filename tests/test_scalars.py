from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as S
from tidemark.model import LONG_MAX, MAX_AHEAD_NS, MAX_ROLL_NS


def values(spark, column, rows, *types):
    schema = T.StructType([T.StructField(f"c{k}", t) for k, t in enumerate(types)])
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


LONG, TEXT = T.LongType(), T.StringType()


def test_arithmetic_saturates(spark):
    rows = [(5, 7), (7, 5), (LONG_MAX, 1), (0, 0)]
    assert values(spark, S.sat_sub("c0", "c1"), rows, LONG, LONG) == [0, 2, LONG_MAX - 1, 0]
    assert values(spark, S.sat_add("c0", "c1"), rows, LONG, LONG) == [12, 12, LONG_MAX, 0]
    assert values(spark, S.checked_sub("c0", "c1"), rows, LONG, LONG) == [None, 2, LONG_MAX - 1, 0]


def test_stamps(spark):
    assert values(spark, S.stamp_ns("c0", "c1"), [(2, 500), (-5, 250), (0, 4_000_000_000)], LONG, LONG) == [2_000_000_500, 250, 4_000_000_000]
    assert [tuple(r) for r in values(spark, S.ns_to_stamp("c0"), [(1_700_000_000_123_456_789,), (999,)], LONG)] == [(1_700_000_000, 123_456_789), (0, 999)]


def test_names(spark):
    assert values(spark, S.sanitized("c0"), [("a/b c",), ("../escape",), ("",), ("été",)], TEXT) == ["a_b_c", ".._escape", "unnamed", "_t_"]
    assert values(spark, S.clip_name(F.lit(7), F.col("c0")), [("a b",)], TEXT) == ["7_a_b.mcap"]
    assert values(spark, S.segment_name("c0", F.lit(3)), [("7_a.b.mcap",), ("bare",)], TEXT) == ["7_a.b_03.mcap", "bare_03"]
    assert values(spark, S.suffixed_name(F.lit("x.mcap"), F.col("c0")), [(0,), (12,)], LONG) == ["x.mcap", "x_12.mcap"]
    assert values(spark, S.parsed_anchor("c0"), [("42_x.mcap",), ("x.mcap",)], TEXT) == [42, None]


def test_name_checks_at_their_bounds(spark):
    good = ["evt-1", "x" * 128, "é" * 64]
    bad = {"": "empty", "x" * 129: "long", "é" * 65: "long", "a\0b": "nul", "a/b": "separator", "a\\b": "separator", ".hidden": "hidden", "..": "hidden", "../escape": "separator", "a..b": "dots"}
    assert values(spark, S.name_reason("c0"), [(n,) for n in good], TEXT) == [None] * 3
    assert values(spark, S.name_reason("c0"), [(n,) for n in bad], TEXT) == list(bad.values())


def test_trigger_checks_at_their_bounds(spark):
    now = 10**18
    cases = [
        ((0, MAX_ROLL_NS, MAX_ROLL_NS, now + MAX_AHEAD_NS, False), None),
        ((0, MAX_ROLL_NS + 1, 0, now, False), "preroll"),
        ((0, 0, MAX_ROLL_NS + 1, now, False), "postroll"),
        ((0, 0, 0, now + MAX_AHEAD_NS + 1, False), "anchor"),
        ((0, 0, 0, 0, False), None),
        ((5, MAX_ROLL_NS + 1, 0, now, False), "trigger_time"),
        ((5, 0, 0, 5, True), None),
    ]
    reason = S.reject_reason(F.lit("evt"), "c0", "c1", "c2", "c3", "c4", F.lit(now))
    assert values(spark, reason, [c for c, _ in cases], LONG, LONG, LONG, LONG, T.BooleanType()) == [r for _, r in cases]


def test_anchors(spark):
    rows = [("recorded", "log"), ("recorded", "publish"), ("live", "log"), ("live", "publish")]
    anchor = S.anchor("c0", "c1", F.lit(100), F.lit(900), F.lit(7_000_000_250), F.lit(42))
    assert values(spark, anchor, rows, TEXT, TEXT) == [100, 900, 42, 7_000_000_250]
    assert values(spark, S.from_trigger_time("c0", "c1"), rows, TEXT, TEXT) == [False, False, False, True]


def test_backoff_and_integers(spark):
    assert values(spark, S.backoff_ms("c0"), [(k,) for k in (1, 2, 3, 4, 5, 6, 40)], LONG) == [200, 400, 800, 1600, 3200, 3200, 3200]
    data = bytes([1, 2, 0, 0, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF])
    assert values(spark, S.little_endian("c0", 0, 2), [(data,)], T.BinaryType()) == [513]
    assert values(spark, S.little_endian("c0", 4, 4), [(data,)], T.BinaryType()) == [2**32 - 1]
    assert values(spark, S.little_endian("c0", 4, 8), [(data,)], T.BinaryType()) == [LONG_MAX]


def test_params():
    import pytest

    from tidemark.model import Params

    assert Params.load({"out_dir": "x"}, {"TIDEMARK_OUT_DIR": "y", "TIDEMARK_GRACE_NS": "5", "TIDEMARK_DELETE_PRUNED": "true"}) == Params(out_dir="x", grace_ns=5, delete_pruned=True)
    with pytest.raises(ValueError):
        Params(time_source="wall")
    with pytest.raises(ValueError):
        Params.load({}, {"TIDEMARK_COMPRESSION": "gzip"})
