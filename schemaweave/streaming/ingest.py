"""Sources as a stream of files: every micro-batch goes through the same table functions and replaces its sources' rows in one step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import Snapshots
from ..plans.lifecycle import Project
from ..sources.imports import input_sources, relative_to


def follow(spark: SparkSession, path: str, root: str, checkpoint: str, project_id: str, source_project_id: str) -> StreamingQuery:
    """Read new files below ``path`` until none is left; objects, columns, issues and risks land in the snapshots at ``root``, once per batch even if it is run again."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(path)

    def each(batch: DataFrame, number: int) -> None:
        named = batch.select(F.lit(str(number)).alias("batch_id"), relative_to(path, F.col("path")).alias("relative_path"), "content")
        sources = input_sources(named, project_id, source_project_id)
        p = Project(sources)
        try:
            Snapshots(spark, root).commit({"db_object": p.objects, "db_column": p.columns, "parse_issue": p.issues, "risk_issue": p.risks}, sources, "files", number)
        finally:
            p.release()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
