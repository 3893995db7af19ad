"""The driver's tables as messages and triggers.

`events`: each day is a recording, the event id is the place in it, the event type the topic and props the payload. The
publish clock runs up to 50 minutes before or after the log clock. Errors are triggers.
`orders` and `lineitem`: ship dates are messages and order dates triggers, two unrelated clocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import MINUTE, SECOND

DAY = 86_400 * SECOND


def nanos(ts):
    return (F.unix_micros(F.col(ts).cast("timestamp")) * 1000).cast("long")


def events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # event times carry no zone
    found = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(found.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if stream else found


def messages(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    log = nanos("ts")
    return events(spark, sf_dir, stream).select(
        F.call_function("div", log, F.lit(DAY)).alias("recording_id"), F.col("event_id").alias("offset"), F.col("event_type").alias("topic"), log.alias("log_ns"),
        (log - ((F.col("event_id") * 37) % 101 - 50) * MINUTE).alias("publish_ns"), F.octet_length("props").cast("long").alias("size"), F.col("props").alias("payload"),
    )


def triggers(spark: SparkSession, sf_dir: str, topic: str = "error", stream: bool = False) -> DataFrame:
    log = nanos("ts")
    return events(spark, sf_dir, stream).filter(F.col("event_type") == topic).select(
        F.col("event_id").alias("trigger_id"), F.concat(F.lit("evt "), (F.col("user_id") % 7).cast("string")).alias("name"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("description"),
        log.alias("log_ns"), (log - ((F.col("event_id") * 37) % 101 - 50) * MINUTE).alias("publish_ns"), ((F.col("user_id") % 10 + 1) * MINUTE).alias("preroll_ns"), ((F.col("user_id") % 5 + 1) * MINUTE).alias("postroll_ns"),
        F.call_function("div", log, F.lit(DAY)).alias("recording_id"),
    )


def records(found: DataFrame, header: int = 31) -> DataFrame:
    """Messages as records of a file: len with headers, and offsets in bytes from their order."""
    return found.withColumn("len", (F.col("size") + header).cast("long"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", nanos("l_shipdate").alias("log_ns"), F.col("l_extendedprice"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", nanos("o_orderdate").alias("publish_ns"))
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select("l_orderkey", "l_linenumber", "log_ns", "publish_ns", "l_extendedprice")
