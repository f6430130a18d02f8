"""The digest of a group's texts as one, however large the group is."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_md5(df: DataFrame, by: str, text: str, separator: str = ",") -> DataFrame:
    """(by, md5): of each group's texts, ascending and joined by ``separator``, as md5(array_join(array_sort(collect_list))) gives it; null texts don't count.

    Texts are dealt by ranges, sorted there and joined to pieces of an Arrow batch each. A digest is a chain, so the pieces of a group pass
    through one task in order, but one at a time: no value, task or executor holds a group."""
    mark, kind = separator.encode(), df.schema[by].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            runs = [(group, separator.join(t for _, t in rows).encode()) for group, rows in itertools.groupby(zip(batch["group"].to_pylist(), batch["text"].to_pylist(), strict=True), lambda r: r[0])]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in runs], batch["group"].type), pa.array([at] * len(runs), pa.int32()), pa.array([next(n) for _ in runs], pa.int64()), pa.array([p for _, p in runs], pa.binary())], ["group", "at", "n", "piece"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = digest = of = None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], of), pa.array([digest.hexdigest()])], ["group", "md5"])
        for batch in batches:
            of = batch["group"].type
            for group, piece in zip(batch["group"].to_pylist(), batch["piece"], strict=True):
                if digest is not None and group == now:
                    digest.update(mark)
                    digest.update(piece.as_buffer())
                    continue
                if digest is not None:
                    yield done()
                now, digest = group, hashlib.md5(piece.as_buffer(), usedforsecurity=False)
        if digest is not None:
            yield done()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(by).alias("group"), F.col(text).alias("text")).where("text is not null")
    cut = rows.repartitionByRange(parts, "group", "text").sortWithinPartitions("group", "text").mapInArrow(pieces, f"group {kind}, at int, n long, piece binary")
    found = cut.repartition("group").sortWithinPartitions("group", "at", "n").mapInArrow(chained, f"group {kind}, md5 string")
    return found.select(F.col("group").alias(by), "md5")
