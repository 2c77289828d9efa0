"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch on its way to a Python worker, unless the session has a setting of its own: a batch stands in
#: the executor's memory several times, beside its heap.
BATCH_BYTES = "4m"
_BATCH_SETTING, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes; texts of ten thousand rows, Spark's bound, may be any size."""
    now = spark.conf.get(_BATCH_SETTING)
    if now is not None and now.rstrip("b") == str(_SPARK_DEFAULT):
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a new local one, but only
    if driver and executors are one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lodestone.shared.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.lodestone.shared.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors.

    The files live under <shared folder>/<application id>; remove that folder when the application is done.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for root in roots:
        if shared_dir(spark).split("://")[-1] in root:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_shuffles(spark: SparkSession) -> None:
    """Has the driver notice that exchanges are done with: Spark deletes their files when it collects its garbage, which
    for a small driver may be much later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Gives the memory of what was dropped back to the system: the driver is small, and a Python worker stays alive
    between tasks, beside the executor's heap."""
    textkit.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For a function over a partition's batches: when it ends, the worker keeps none of its memory."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns that most operators read, under fixed names, so that other columns cannot clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


#: A key is hot if it holds more than one in so many rows; so there are at most that many hot keys, whatever the data.
HOT_ONE_IN = 1000


def look_up(rows: DataFrame, found: DataFrame, keys: list[str], n: int, count: str = "n_rows") -> DataFrame:
    """rows left join found, where `found` has one row a key and, in `count`, the key's number of rows.

    Hot keys, of which there can only be HOT_ONE_IN, go by broadcast, so that no task gets a hot key's rows; the others
    are joined by shuffle.  n: the number of rows.  Rows with a null key find nothing.
    """
    limit = max(64, n // HOT_ONE_IN)
    marked = rows.join(F.broadcast(found.filter(F.col(count) > limit).withColumn("__hot", F.lit(True))), keys, "left")
    hot = marked.filter(F.col("__hot")).drop("__hot")
    cold = marked.filter(F.col("__hot").isNull()).select(*rows.columns)
    return cold.join(found.filter(F.col(count) <= limit), keys, "left").select(*hot.columns).unionByName(hot)
