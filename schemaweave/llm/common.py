"""Scratch tables and small helpers that the operators share.

Lineage is cut by writing Parquet tables below ``spark.checkpoint.dir``, the folder that the driver and all executors
share, so a lost executor only costs the tasks it ran. Nothing here is kept on one executor's disk.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import shared_folder

#: Paths of scratch tables by application and scope.
_STAGED: dict[tuple[str, str], list[str]] = {}
_SCOPE = [""]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; one of our own only in a local run without that setting."""
    return shared_folder(spark)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/schemaweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault((spark.sparkContext.applicationId, _SCOPE[-1]), []).append(path)
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """Rows that run inside go to Python in batches of ``most`` bytes, so that a JVM and its workers hold that much a task, not 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Scratch tables written inside belong to ``name`` and go when it is released."""
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def release(spark: SparkSession, name: str = "") -> None:
    """Delete a scope's scratch tables; call it once the results that read them have been written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _STAGED.pop((spark.sparkContext.applicationId, name), []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, null texts as empty; extra columns of any name don't get in the way."""
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches in slices with about ``most`` bytes in ``column``, or one row: what is made of texts is a multiple of that in memory."""
    for batch in batches:
        start, total = 0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64))
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


#: Python workers serve one operator after another; what an operator keeps between partitions goes when the next one comes.
_OWNER: list[str] = [""]
CLEAR: dict[str, Callable[[], object]] = {}


def claim(owner: str) -> None:
    """Called in a worker before an operator's work: drops what other operators have kept there and gives the memory back."""
    if _OWNER[0] != owner:
        for name, clear in CLEAR.items():
            if name != owner:
                clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _OWNER[0] = owner
