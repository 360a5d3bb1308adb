"""Shared helpers of the training-data operators: scratch tables and word rules."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this package.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; F.lower folds more."""
    return F.translate(c, _UPPER, _LOWER)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Only a local session without such a folder gets a temporary one; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="sonorant-")
            spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/sonorant/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended already
        return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    Shuffle files of earlier steps are released before, so that disk holds one step's. A caller that goes on to a large
    step without another write calls release() when it no longer holds df.
    """
    spark = df.sparkSession
    release(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, which nobody reads again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of DataFrames that nobody holds any more."""
    for _ in range(2):  # the second pass finds what the first one's finalizers let go
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


@cache
def _trimmer():
    """glibc's malloc_trim; None where there is none."""
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except OSError:
        return None


def trim() -> None:
    """Give the memory that this worker has freed back to the system, between pieces of work: malloc and Arrow keep it otherwise,
    in idle workers too."""
    pa.default_memory_pool().release_unused()
    if _trimmer() is not None:
        _trimmer()(0)


def lighten(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage, after which they give free heap back to the system.

    A heap that earlier steps filled otherwise stays as large as it may be, beside the Python workers of the next step.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')").collect()


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Let Python workers get at most so many rows and bytes at once: texts are long, and a worker holds a batch several
    times. Settings of the caller that are smaller stay; operators are lazy, so the settings outlive this call."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, most)


def id_in(name: str = "doc_id") -> Column:
    """A long column on its way into Python: as a string, since pandas makes long columns with nulls doubles."""
    return F.col(name).cast("long").cast("string").alias(name)


def id_out(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """df, from Python, with the column a long again."""
    return df.withColumn(name, F.col(name).cast("long"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
