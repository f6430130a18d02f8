"""State tables as Parquet partitioned by project, replaced by partition; enumerations as dimension tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.convert import LEVELS as CONVERSION_LEVELS
from ..operators.risk import LEVELS as RISK_LEVELS

# Codes in the order of their rank.
ENUMS = {
    "risk_level": list(RISK_LEVELS),
    "conversion_level": list(CONVERSION_LEVELS),
    "object_type": "TABLE COLUMN PRIMARY_KEY UNIQUE_CONSTRAINT CHECK_CONSTRAINT FOREIGN_KEY INDEX SEQUENCE VIEW TRIGGER FUNCTION PROCEDURE PACKAGE PACKAGE_BODY SYNONYM GRANT COMMENT PARTITION UNKNOWN".split(),
    "dependency_type": "TABLE_REFERENCES_TABLE TABLE_USES_SEQUENCE INDEX_ON_TABLE VIEW_REFERENCES_TABLE TRIGGER_ON_TABLE ROUTINE_REFERENCES_OBJECT PACKAGE_BODY_FOR_SPEC CROSS_SOURCE_DEPENDENCY".split(),
    "version_status": "GENERATED EDITED BASELINE STALE".split(),
    "review_decision": "APPROVED CONDITIONALLY_APPROVED REJECTED CHANGES_REQUESTED".split(),
}


def dimension(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ENUMS[name])), "ordinal int, code string").select("code", "ordinal")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def replace(self, name: str, rows: DataFrame, by: tuple[str, ...] = ("project_id",)) -> None:
        """Partitions that ``rows`` have take the place of those stored; others stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame, by: tuple[str, ...] = ("project_id",)) -> None:
        rows.write.mode("append").partitionBy(*by).parquet(f"{self.root}/{name}")

    def read(self, name: str, project_id: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}")
        return df if project_id is None else df.where(df["project_id"] == project_id)


SOURCE = ["project_id", "input_source_id"]


def replaced(stored: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of the sources that came in give way to the fresh ones."""
    return stored.join(sources, SOURCE, "left_anti").unionByName(fresh)


class Snapshots:
    """State tables that change together: versioned folders and one manifest that says which of them count.

    A table's rows lie in ``buckets`` by a hash of their source. A commit writes the buckets of the sources that came in anew, under a
    name of its own, and then publishes a manifest under the next number, by a rename that fails if another writer was first. A
    reader takes the manifest with the greatest number; so it sees all tables before a commit or all after it, whatever is
    lost in between. What goes is told by the sources, not by the rows, so a source that yields nothing any more keeps nothing.

    A commit may name its stream and batch; one that is in already changes nothing. The manifest holds a folder per table and
    bucket and a number per stream, whatever the size of the tables."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/_manifests")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> dict:
        numbers = self._numbers() if number is None else [number]
        if not numbers:
            return {"number": 0, "buckets": self.buckets, "tables": {}, "schemas": {}, "applied": {}}
        lines = self.spark.read.text(f"{self.root}/_manifests/{numbers[-1]}.json", wholetext=True).first()[0]
        return json.loads(lines)

    def _publish(self, manifest: dict) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, draft = self._fs(f"{self.root}/_manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._fs(f"{self.root}/_manifests/{manifest['number']}.json")
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, final, self.spark.sparkContext._gateway.new_array(kind, 0))

    def read(self, name: str, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as the newest manifest has it, or another one."""
        m = manifest or self.manifest()
        schema = StructType.fromJson(m["schemas"][name])
        paths = [f"{self.root}/{name}/{folder}/__bucket={b}" for b, folder in sorted(m["tables"][name].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame], sources: DataFrame, stream: str = "", batch: int | None = None, merge: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] | None = None) -> bool:
        """Put the fresh rows of the ``sources`` that came in (SOURCE columns) in the place of the stored ones, in all tables at once.

        ``merge`` says for a table how stored, fresh and sources become its rows, where that isn't ``replaced``. False if this batch was in already."""
        m = self.manifest()
        if batch is not None and m["applied"].get(stream, -1) >= batch:
            return False
        place = F.pmod(F.xxhash64(*SOURCE), F.lit(m["buckets"])).cast("int")
        came = sources.select(*SOURCE).distinct()
        touched = sorted(r[0] for r in came.select(place.alias("b")).distinct().collect())  # as many as there are buckets at most
        folder = uuid.uuid4().hex
        new = {**m, "number": m["number"] + 1, "tables": dict(m["tables"]), "schemas": dict(m["schemas"]), "applied": dict(m["applied"])}
        for name, df in tables.items():
            fresh = df.join(came, SOURCE, "left_semi").select(df.columns)
            rows = fresh if name not in m["tables"] else (merge or {}).get(name, replaced)(self.read(name, m, touched), fresh, came).select(df.columns)
            rows.withColumn("__bucket", place).write.partitionBy("__bucket").parquet(f"{self.root}/{name}/{folder}")
            fs, p = self._fs(f"{self.root}/{name}/{folder}")
            written = {x.getPath().getName().split("=")[1] for x in fs.listStatus(p) if x.getPath().getName().startswith("__bucket=")}
            kept = {b: f for b, f in m["tables"].get(name, {}).items() if int(b) not in touched}
            new["tables"][name], new["schemas"][name] = kept | dict.fromkeys(sorted(written), folder), json.loads(df.schema.json())
        if batch is not None:
            new["applied"][stream] = batch
        self._publish(new)
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the newest ``keep``, and folders that none of those names; only while nobody writes."""
        numbers = self._numbers()
        used = {(t, f) for n in numbers[-keep:] for t, places in self.manifest(n)["tables"].items() for f in places.values()}
        for n in numbers[:-keep]:
            fs, p = self._fs(f"{self.root}/_manifests/{n}.json")
            fs.delete(p, False)
        for table in {t for n in numbers[-1:] for t in self.manifest(n)["tables"]}:
            fs, p = self._fs(f"{self.root}/{table}")
            for x in fs.listStatus(p) if fs.exists(p) else []:
                if (table, x.getPath().getName()) not in used:
                    fs.delete(x.getPath(), True)
