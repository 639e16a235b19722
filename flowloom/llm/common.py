"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import uuid

import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that `[\x20\x09-\x0D]` names; bytes.split() and bytes.strip() use the same six.
WHITE = b" \t\n\r\x0b\x0c"
#: Lower-cases A-Z in bytes and leaves all else, UTF-8 sequences included.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows that go to Python at once; texts can be long, so batches are short.
ARROW_ROWS = 512
#: crc32 of the id as text deals rows to folds; the same in Spark SQL and in zlib.crc32.
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session that names none has its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file:///tmp/checkpoints/flowloom"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, computes once."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_of(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and path of a folder; Spark's names for S3 are taken too."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def python_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small: the session's setting is lowered to ARROW_ROWS and stays so, for plans run later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def fold(column: str, parts: int):
    """crc32 of a column's text form, modulo parts (null: -1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(-1))


class Files:
    """Compressed blobs in a folder that all executors share, by names that are new for every attempt of a task."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.folder = new_folder(spark, name)

    def write(self, data: bytes) -> str:
        store, root = folder_of(self.folder)
        store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(zstandard.ZstdCompressor(level=1).compress(data))
        return name

    def read(self, name: str) -> bytes:
        store, root = folder_of(self.folder)
        with store.open_input_stream(f"{root}/{name}") as stream:
            return zstandard.ZstdDecompressor().decompress(stream.read())
