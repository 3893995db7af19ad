"""Column builders: saturating time arithmetic, names, anchors and validation. All run inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import LOG, LONG_MAX, MAX_AHEAD_NS, MAX_NAME_BYTES, MAX_ROLL_NS, SECOND


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, int) else F.col(x)


def sat_sub(a, b) -> Column:
    """a - b, not below 0."""
    return F.greatest(F.coalesce(F.try_subtract(_c(a), _c(b)), F.lit(0)), F.lit(0)).cast("long")


def sat_add(a, b) -> Column:
    """a + b, not above the largest long."""
    return F.coalesce(F.try_add(_c(a), _c(b)), F.when(_c(a).isNotNull() & _c(b).isNotNull(), F.lit(LONG_MAX))).cast("long")


def checked_sub(a, b) -> Column:
    """a - b, or null where that is negative."""
    return F.when(_c(a) >= _c(b), _c(a) - _c(b)).cast("long")


def stamp_ns(sec, nanosec) -> Column:
    """Nanoseconds of seconds (negative ones count as 0) and nanoseconds, which may exceed a second."""
    return (F.greatest(_c(sec).cast("long"), F.lit(0)) * SECOND + _c(nanosec).cast("long")).cast("long")


def ns_to_stamp(ns) -> Column:
    return F.struct(F.call_function("div", _c(ns), F.lit(SECOND)).cast("int").alias("sec"), (_c(ns) % SECOND).alias("nanosec"))


def now_ns() -> Column:
    return F.unix_micros(F.current_timestamp()) * 1000


def stamp(clock: str, log="log_ns", publish="publish_ns") -> Column:
    """The time of a message on the chosen clock."""
    return _c(log if clock == LOG else publish)


def mib(n) -> Column:
    return _c(n) / (1024.0 * 1024.0)


def sanitized(name) -> Column:
    """The name as part of a file name: characters other than letters, digits, `-`, `_` and `.` become `_`."""
    return F.coalesce(F.nullif(F.regexp_replace(_c(name), "[^A-Za-z0-9._-]", "_"), F.lit("")), F.lit("unnamed"))


def clip_name(anchor, name) -> Column:
    return F.concat(_c(anchor).cast("string"), F.lit("_"), sanitized(name), F.lit(".mcap"))


def _insert(base, part: Column) -> Column:
    """A part put before the extension of a file name, or at the end of one without."""
    stem = F.regexp_extract(_c(base), r"^(.+)(\.[^.]*)$", 1)
    return F.when(stem == "", F.concat(_c(base), part)).otherwise(F.concat(stem, part, F.regexp_extract(_c(base), r"^(.+)(\.[^.]*)$", 2)))


def segment_name(base, number) -> Column:
    return _insert(base, F.format_string("_%02d", _c(number)))


def suffixed_name(base, number) -> Column:
    """The name after `number` collisions; with none, the name itself."""
    return F.when(_c(number) == 0, _c(base)).otherwise(_insert(base, F.concat(F.lit("_"), _c(number).cast("string"))))


def parsed_anchor(filename) -> Column:
    """The anchor at the head of a clip's file name, or null."""
    return F.nullif(F.regexp_extract(_c(filename), r"^(\d+)_", 1), F.lit("")).cast("long")


def backoff_ms(faults) -> Column:
    """The pause after so many consecutive faults: 200 ms, doubling to at most 3200."""
    return F.least(F.lit(200) * F.pow(F.lit(2), F.least(_c(faults) - 1, F.lit(10))).cast("long"), F.lit(3200)).cast("long")


def anchor(interface, clock, record_log, record_publish, trigger_time_ns, now) -> Column:
    """The centre of a trigger's window: for recorded triggers their record's stamp, for live ones now or their own time."""
    recorded = F.when(_c(clock) == LOG, _c(record_log)).otherwise(_c(record_publish))
    live = F.when(_c(clock) == LOG, _c(now)).otherwise(_c(trigger_time_ns))
    return F.when(_c(interface) == "recorded", recorded).otherwise(live).cast("long")


def from_trigger_time(interface, clock) -> Column:
    return (_c(interface) == "live") & (_c(clock) != LOG)


def name_reason(name) -> Column:
    """Why a name is refused, or null. The first check that fails names the reason."""
    n = _c(name)
    return (
        F.when(n == "", "empty")
        .when(F.octet_length(n) > MAX_NAME_BYTES, "long")
        .when(F.contains(n, F.lit("\0")), "nul")
        .when(F.contains(n, F.lit("/")) | F.contains(n, F.lit("\\")), "separator")
        .when(F.startswith(n, F.lit(".")), "hidden")
        .when(F.contains(n, F.lit("..")), "dots")
    )


def reject_reason(name, trigger_time_ns, preroll, postroll, anchor_ns, uses_trigger_time, now) -> Column:
    """Why a trigger is refused, or null: a time where none is used, rolls, an anchor too far ahead, the name."""
    return (
        F.when(~_c(uses_trigger_time) & (_c(trigger_time_ns) != 0), "trigger_time")
        .when(_c(preroll) > MAX_ROLL_NS, "preroll")
        .when(_c(postroll) > MAX_ROLL_NS, "postroll")
        .when(_c(anchor_ns) > sat_add(now, MAX_AHEAD_NS), "anchor")
        .otherwise(name_reason(name))
    )


def producer_stamps(kind, time_ns, start_ns, epoch_offset, log) -> Column:
    """The publish time of a producer's record: its validity time or start moved to the epoch, else its log time."""
    moved = lambda t: F.greatest(F.lit(0), _c(t) + _c(epoch_offset))
    return F.when(_c(kind) == "time", moved(time_ns)).when(_c(kind) == "range", moved(start_ns)).otherwise(_c(log)).cast("long")


def validity(kind, time_ns, start_ns, end_ns) -> Column:
    """A producer's time-of-validity envelope: only the fields of its kind are set."""
    return F.struct(_c(kind).alias("kind"), F.when(_c(kind) == "time", _c(time_ns)).alias("time_ns"), F.when(_c(kind) == "range", _c(start_ns)).alias("start_ns"), F.when(_c(kind) == "range", _c(end_ns)).alias("end_ns"))


def plausible(ns) -> Column:
    """Whether a time is an absolute one: 2020-01-01 or later."""
    return _c(ns) >= 1_577_836_800 * SECOND


def little_endian(data, at: int, width: int) -> Column:
    """An unsigned little-endian integer of 1, 2, 4 or 8 bytes in a binary column; 64-bit values clamp to the largest long."""
    digits = F.hex(F.substring(_c(data), at + 1, width))
    swapped = F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(width, 0, -1)])
    wide = F.conv(swapped, 16, 10).cast("decimal(20,0)")
    return F.least(wide, F.lit(LONG_MAX).cast("decimal(20,0)")).cast("long")
