"""Cutting the lineage of iterative operators in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where the setting is absent and everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='schemaweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Rounds:
    """Tables that an iterative operator writes round by round below one folder of the shared file system.

    Every table is a folder with a subfolder per round, so a plan reads as much as it needs of what is written and never grows
    with the number of rounds; whether a round found anything is seen from its folder, without a job."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/schemaweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def _path(self, path: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def write(self, number: int, **tables: DataFrame) -> None:
        """The tables of one round in one job; they must have their columns' names and types in common or lack them."""
        rows = None
        for name, df in tables.items():
            df = df.withColumn("__table", F.lit(name))
            rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
        rows.write.partitionBy("__table").parquet(f"{self.root}/{number}")

    def deal(self, number: int, rows: DataFrame, table: Column) -> None:
        """The rows of one round, each to the table that it names; what makes them runs once, however many tables there are."""
        rows.withColumn("__table", table).write.partitionBy("__table").parquet(f"{self.root}/{number}")

    def has(self, number: int, name: str) -> bool:
        fs, p = self._path(f"{self.root}/{number}/__table={name}")
        return fs.exists(p)

    def read(self, name: str, schema: str | StructType, *numbers: int) -> DataFrame:
        """One table of some rounds."""
        found = [f"{self.root}/{n}/__table={name}" for n in numbers if self.has(n, name)]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def drop(self, *numbers: int) -> None:
        for n in numbers:
            fs, p = self._path(f"{self.root}/{n}")
            fs.delete(p, True)
