"""What the operators of this subpackage share: tables in the shared folder and Arrow batches of texts."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark import on_workers

#: Bytes of one Arrow batch sent to a Python worker, so that long texts can't pile up by row count.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, where the session doesn't do so more tightly itself, and lets workers import us."""
    on_workers(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    if not (own := getattr(spark, "_tidemark_dir", None)):
        own = spark._tidemark_dir = tempfile.mkdtemp(prefix="tidemark-")
    return own


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{tag}-{uuid.uuid4().hex}"
    fs, where = _hadoop(spark, path)
    fs.deleteOnExit(where)
    return path


def cut(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later step reads."""
    for path in paths:
        fs, where = _hadoop(spark, path)
        fs.delete(where, True)


def column(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows as one struct column `row`, so that results beside it clash with no column of the input."""
    return docs.select(F.struct(*[column(c) for c in columns or docs.columns]).alias("row"))


def annotate(rows: DataFrame, text: str, make, fields: T.StructType, keep: bool = True) -> DataFrame:
    """Adds the columns `fields` to packed rows, computed batch by batch from the column `text` inside `row`.

    make() is called once for each task and returns a function from a list of UTF-8 texts (bytes, or None for null)
    to a list with one value list for each field. Batches are bounded in bytes, so a worker holds a batch at a time.
    """
    prepare(rows.sparkSession)
    kinds = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
    row = rows.schema["row"]

    def run(batches):
        work = make()
        for batch in batches:
            whole = batch.column(batch.schema.get_field_index("row"))
            texts = whole.field(text).cast(pa.binary()).to_pylist()
            made = [pa.array(v, type=k.type) for v, k in zip(work(texts), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(([whole] if keep else []) + made, names=(["row"] if keep else []) + [k.name for k in kinds])

    return rows.mapInArrow(run, T.StructType(([row] if keep else []) + list(fields)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
