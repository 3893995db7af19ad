"""Relational forms of file discovery: which recording comes next, which is newest, which are unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unseen(files: DataFrame, seen: DataFrame, identity: list[str]) -> DataFrame:
    """Files whose identity hasn't been seen, each once."""
    return files.dropDuplicates(identity).join(seen.select(*identity).distinct(), identity, "left_anti")


def oldest(files: DataFrame, order: str, *columns: str) -> DataFrame:
    """The oldest file, as one row (none without files)."""
    least = F.min_by(F.struct(*columns), F.struct(order, *columns))
    return files.agg(least.alias("f")).filter("f is not null").select("f.*")


def newest(files: DataFrame, order: str, *columns: str) -> DataFrame:
    """The newest file, as one row (none without files)."""
    most = F.max_by(F.struct(*columns), F.struct(order, *columns))
    return files.agg(most.alias("f")).filter("f is not null").select("f.*")


def numbered(files: DataFrame, *order: str) -> DataFrame:
    """Files with recording_id, from 0 in the order of discovery. One row per file: a single ordered window."""
    return files.withColumn("recording_id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
