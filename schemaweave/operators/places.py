"""The place of every row in an order within a group, however large the group is."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Rounds


@dataclasses.dataclass(frozen=True)
class Falling:
    """A key of an order with the greatest first."""

    key: Column | str


def placed(df: DataFrame, by: list[str], *order: Column | str | Falling) -> DataFrame:
    """Adds ``position``: a row's place from 1 among those that agree in ``by``; ties share a place, nulls are the least and equal.

    Rows of equal keys are counted where they lie, so however many tie, one row of them moves. The distinct keys are dealt by ranges; a
    row's place is the number of rows in the ranges before its own, plus those before it in its range. No task holds a group."""
    keys = [f"__key{i}" for i in range(len(order))]
    named = [(k.key if isinstance(k, Falling) else k) for k in order]
    d = df.select("*", *((F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(named, keys, strict=True)))
    along = [F.desc(n) if isinstance(k, Falling) else F.asc(n) for k, n in zip(order, keys, strict=True)]
    counts = d.groupBy(*by, *keys).agg(F.count("*").alias("__n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(parts, *map(F.asc, by), *along).withColumn("__range", F.spark_partition_id())
    rounds = Rounds(df.sparkSession, "ranked")  # written, as both sums must see the same ranges
    rounds.write(0, keys=dealt)
    dealt = rounds.read("keys", dealt.schema, 0)
    earlier = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy(*by, "__range").agg(F.sum("__n").alias("__n"))  # a row per range and group in it
    before = totals.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__range").alias("__r"), earlier(Window.partitionBy(*by).orderBy("__range")).alias("__before"))
    inside = dealt.withColumn("__inside", earlier(Window.partitionBy(*by, "__range").orderBy(*along)))
    same = lambda: functools.reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"__by_{c}")), by, F.lit(True))
    found = inside.join(before.hint("merge"), same() & (F.col("__range") == F.col("__r")))
    found = found.select(*(F.col(c).alias(f"__by_{c}") for c in by), *(F.col(k).alias(f"{k}_") for k in keys), (F.col("__before") + F.col("__inside") + 1).alias("position"))
    on = same()
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return d.join(found.hint("merge"), on).select(*(d[c] for c in df.columns), "position")
