"""Storage of intermediate tables.

``materialise`` cuts lineage: it writes a Parquet table below
``spark.checkpoint.dir``, which every executor shares, and reads it again, so a
lost executor costs a re-read, and stages that run side by side don't compute
the same rows twice, as they may with a cached table.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Files of one run stand together, so that they can be removed together.
FOLDER = "wayfold-scratch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where none is named and driver and tasks are one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's folder, which goes when the application ends."""
    root = f"{shared_dir(spark)}/{FOLDER}/{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{root}/{label}-{uuid.uuid4().hex}"


#: Bytes of input that a file of an intermediate table stands for, about.
FILE_BYTES = 256 << 20


def input_bytes(df: DataFrame) -> int:
    """What the tables that a plan reads have in bytes, as Spark knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(min(int(str(leaves.apply(i).stats().sizeInBytes())), 1 << 60) for i in range(leaves.size()))


#: Rows of whole texts that go to a Python worker at once.
TEXT_ROWS = 1024


@contextmanager
def text_batches(spark: SparkSession):
    """What runs inside sends texts to Python in batches of ``TEXT_ROWS`` at most: a batch stands in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), TEXT_ROWS) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise_texts(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """``materialise`` for a kernel that reads texts."""
    with text_batches(df.sparkSession):
        return materialise(df, label, files)


def materialise(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    It has ``files`` files at most, or four a core and more where its input is large.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    most = files or max(4 * spark.sparkContext.defaultParallelism, input_bytes(df) // FILE_BYTES)
    df.coalesce(min(most, 1 << 30)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a materialised table that nothing will read again."""
    spark = table.sparkSession
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of input that an output partition stands for, about.
OUTPUT_BYTES = 64 << 20


def sized(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` in no more partitions than its source's size calls for, so that small inputs don't end as many tiny files.

    Large inputs keep the partitions they have.
    """
    spark = df.sparkSession
    return df.coalesce(min(1 << 30, max(2 * spark.sparkContext.defaultParallelism, input_bytes(source) // OUTPUT_BYTES)))
