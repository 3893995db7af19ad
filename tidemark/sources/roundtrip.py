"""Events as MCAP recordings and back."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import adapters, datasource


def as_clips(messages: DataFrame) -> DataFrame:
    """Messages (topic, log_ns, publish_ns, payload text) as one clip for each recording."""
    return messages.select(
        F.col("recording_id").alias("trigger_id"), F.lit(0).alias("segment_no"), F.concat(F.lit("day_"), F.col("recording_id").cast("string"), F.lit(".mcap")).alias("filename"), "topic", F.lit("json").alias("message_encoding"),
        F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("struct<name:string,encoding:string,data:binary>").alias("schema"), F.col("offset").alias("sequence"), "log_ns", "publish_ns",
        F.col("payload").cast("binary").alias("payload"), "recording_id", "offset", F.lit(0).alias("inner_seq"),
    )


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder that the driver and all executors see, until this process ends."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    where = urlparse(given or "")
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if not local and (not where.path or where.scheme not in ("", "file")):
        raise ValueError("this needs a mounted folder that the driver and all executors share: set spark.checkpoint.dir to one")
    shared = where.path if where.path and where.scheme in ("", "file") else None
    if shared:
        os.makedirs(shared, exist_ok=True)
    folder = tempfile.mkdtemp(prefix=prefix, dir=shared)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as recordings, one for each day, and read back: counts and bounds per day."""
    folder = shared_folder(spark, "mcap-")
    datasource.write_clips(as_clips(adapters.messages(spark, sf_dir)), folder)
    found = datasource.read(spark, folder)
    topics = datasource.read(spark, folder, "channels").select("recording_id", "channel_id", "topic")
    named = found.join(topics, ["recording_id", "channel_id"])
    day = F.call_function("div", F.col("log_ns"), F.lit(adapters.DAY))
    return named.groupBy(day.alias("recording_id")).agg(
        F.count("*").alias("messages"), F.sum("size").alias("bytes"), F.min("log_ns").alias("log_min"), F.max("log_ns").alias("log_max"), F.min("publish_ns").alias("publish_min"), F.max("publish_ns").alias("publish_max"), F.countDistinct("topic").alias("topics")
    )
