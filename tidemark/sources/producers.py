"""Producers as generators: ticks of two channels, sensor envelopes, and triggers with a rolled window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import producer_stamps, validity
from tidemark.model import SECOND


def ticks(spark: SparkSession, n: int, *, start_ns: int, period_ns: int) -> DataFrame:
    """A pose on a circle and a size for each tick, as JSON payloads; sequence numbers run over both channels."""
    t = F.col("id") * 0.02
    pose = F.to_json(F.struct(F.cos(t).alias("x"), F.sin(t).alias("y"), t.alias("theta")))
    size = F.to_json(F.struct(F.abs(F.sin(t)).alias("size")))
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("/pose").alias("topic"), pose.alias("payload")), F.struct(F.lit(1).alias("k"), F.lit("/size").alias("topic"), size.alias("payload"))))
    log = F.lit(start_ns) + F.col("id") * period_ns
    made = spark.range(n).select("id", log.alias("log_ns"), both.alias("c"))
    return made.select("c.topic", F.lit("json").alias("message_encoding"), (F.col("id") * 2 + F.col("c.k")).alias("sequence"), "log_ns", F.col("log_ns").alias("publish_ns"), F.col("c.payload").cast("binary").alias("payload"))


def envelopes(samples: DataFrame, *, epoch_offset_ns: int) -> DataFrame:
    """samples (seq, value, kind, time_ns, start_ns, end_ns, begun_ns, done_ns, status) with their publish time and envelope.

    A sample without a value has a meta envelope, which says that the payload is missing.
    """
    tov = validity("kind", "time_ns", "start_ns", "end_ns")
    process = F.struct(F.col("begun_ns").alias("start"), F.col("done_ns").alias("end"))
    data = F.to_json(F.struct(F.struct("seq", "value").alias("payload"), tov.alias("tov"), process.alias("process_time"), F.col("status").alias("status_txt")))
    meta = F.to_json(F.struct(tov.alias("tov"), process.alias("process_time"), F.col("status").alias("status_txt"), F.lit(True).alias("payload_missing")))
    has = F.col("value").isNotNull()
    log = F.col("done_ns") + F.lit(epoch_offset_ns)
    return samples.select(
        "seq", F.when(has, "/sensor").otherwise("/sensor/__meta").alias("topic"), log.alias("log_ns"), producer_stamps("kind", "time_ns", "start_ns", F.lit(epoch_offset_ns), log).alias("publish_ns"), F.when(has, data).otherwise(meta).alias("payload"),
    )


def rolled(spark: SparkSession, n: int, *, seed: int = 0, low: int = 1, high: int = 10) -> DataFrame:
    """Triggers whose preroll and postroll are whole seconds from low to high, rolled by a seed."""
    roll = lambda k: (F.floor(F.rand(seed + k) * (high - low + 1)) + low).cast("long") * SECOND
    return spark.range(n).select(F.concat(F.lit("roll-"), F.col("id").cast("string")).alias("name"), F.lit("").alias("description"), F.struct(F.lit(0).alias("sec"), F.lit(0).cast("long").alias("nanosec")).alias("trigger_time"), roll(0).alias("preroll_ns"), roll(1).alias("postroll_ns"))
