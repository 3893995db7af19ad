"""Schemas and parameters of the engine.

Times are nanoseconds since the epoch in signed longs; larger unsigned values are clamped to the largest long when read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LONG_MAX = 2**63 - 1
SECOND = 1_000_000_000
MINUTE = 60 * SECOND

#: The clock that decides anchors, membership, overlap and coverage.
LOG, PUBLISH = "log", "publish"
CLOCKS = (LOG, PUBLISH)
CODECS = {"none": "", "zstd": "zstd", "lz4": "lz4"}

# Fixed values of the trigger protocol.
MAX_ROLL_NS = 30 * MINUTE
MAX_AHEAD_NS = 30 * MINUTE
MAX_NAME_BYTES = 128
MAX_ACTIVE = 16
EXTENT_BYTES = 4 << 20
MESSAGE_HEADER = 22
RECORD_HEADER = 9
MAX_RECORD = 1 << 31
TRIGGER_TOPIC = "/trigger"


@dataclass(frozen=True)
class Params:
    """What a run can be told; each field can come from TIDEMARK_<FIELD> too."""

    record_dir: str = "./record"
    out_dir: str = "./clips"
    grace_ns: int = 30 * SECOND
    compression: str = "zstd"
    trigger_source: str = "live"
    time_source: str = LOG
    retention_ns: int = 600 * SECOND
    delete_pruned: bool = False
    extent_bytes: int = EXTENT_BYTES
    max_active: int = MAX_ACTIVE
    trigger_topic: str = TRIGGER_TOPIC
    #: Tasks that write clips at a time; 0 leaves it to Spark.
    parallelism: int = 0
    #: A folder of live triggers, read as it fills; empty: none.
    inbox: str = ""
    #: Seconds without a sign of life after which a scan counts as hung; an idle one gives one every 10 s.
    stall_s: int = 600

    def __post_init__(self):
        for field, allowed in (("time_source", CLOCKS), ("compression", CODECS), ("trigger_source", ("live", "recorded"))):
            if getattr(self, field) not in allowed:
                raise ValueError(f"{field} is one of {', '.join(allowed)}, not {getattr(self, field)!r}")

    @classmethod
    def load(cls, given: dict | None = None, env: dict | None = None) -> Params:
        """Given values first, then the environment's, then the defaults."""
        values = {}
        for name, kind in cls.__annotations__.items():
            if (raw := (env or {}).get(f"TIDEMARK_{name.upper()}")) is not None:
                values[name] = raw.lower() in ("1", "true", "yes") if kind == "bool" else int(raw) if kind == "int" else raw
        return cls(**values | {k: v for k, v in (given or {}).items() if v is not None})


STAMP = T.StructType([T.StructField("sec", T.IntegerType()), T.StructField("nanosec", T.LongType())])
SPAN = T.StructType([T.StructField("min", T.LongType()), T.StructField("max", T.LongType())])
MESSAGES = T.StructType([
    T.StructField("recording_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("chunk_offset", T.LongType()), T.StructField("inner_seq", T.IntegerType()),
    T.StructField("channel_id", T.IntegerType()), T.StructField("sequence", T.LongType()), T.StructField("log_ns", T.LongType()), T.StructField("publish_ns", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("payload", T.BinaryType()),
])
CHANNELS = T.StructType([
    T.StructField("recording_id", T.LongType()), T.StructField("channel_id", T.IntegerType()), T.StructField("topic", T.StringType()), T.StructField("message_encoding", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("schema", T.StructType([T.StructField("name", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("data", T.BinaryType())])),
])
EXTENTS = T.StructType([
    T.StructField("recording_id", T.LongType()), T.StructField("extent_no", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("len", T.LongType()),
    T.StructField("records", T.LongType()), T.StructField("log", SPAN), T.StructField("publish", SPAN),
])
TRIGGER = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("trigger_time", STAMP),
    T.StructField("preroll_ns", T.LongType()), T.StructField("postroll_ns", T.LongType()),
])
