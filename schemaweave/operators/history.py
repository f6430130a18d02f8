"""What was so when: logs of changes, and their state as of a time.

A log has key columns, ``at`` and value columns; a row says what the values are from then on. Times come from the caller's clock."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Rounds


def created(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The first entries of a log: rows as they were when they came in (created_at)."""
    return rows.select(*keys, F.col("created_at").alias("at"), *values)


def changed(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], at: Column) -> DataFrame:
    """Entries for the rows whose values differ after a step that was taken at ``at``, or that are new."""
    now, was = after.select(*keys, *values).alias("now"), before.select(*keys, *values).alias("was")
    on = functools.reduce(lambda x, k: x & F.col(f"now.{k}").eqNullSafe(F.col(f"was.{k}")), keys, F.lit(True))
    same = functools.reduce(lambda x, v: x & F.col(f"now.{v}").eqNullSafe(F.col(f"was.{v}")), values, on)
    return now.join(was.hint("merge"), same, "left_anti").select(*keys, at.alias("at"), *values)


def effective(log: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``until``: when the next entry of the same key begins; null for what still holds."""
    return log.withColumn("until", F.lead("at").over(Window.partitionBy(*keys).orderBy("at")))


def as_of(questions: DataFrame, log: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The questions (keys, ``at`` and any others) with the values of the last entry of their key that isn't later; null before the first.

    Of entries of one key and time the greatest values count. Both sides are dealt by ranges of key and time; within a range each question
    takes the last entry before it, and what a range can't know, the last entries of the ranges before it tell: a row for each range
    and key in it. So a key with a third of all entries is spread over many tasks, and no pair of entry and question is made."""
    packed = F.struct(*values)
    entries = log.where(F.col("at").isNotNull()).groupBy(*keys, "at").agg(F.max(packed).alias("__value")).withColumn("__asked", F.lit(0))
    rows = questions.select(*keys, "at", F.struct(*questions.columns).alias("__question")).withColumn("__asked", F.lit(1))
    both = entries.unionByName(rows, allowMissingColumns=True)
    parts = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartitionByRange(parts, *keys, "at", "__asked", F.xxhash64("__question")).withColumn("__range", F.spark_partition_id())
    rounds = Rounds(questions.sparkSession, "as-of")  # written, as both steps must see the same ranges
    rounds.write(0, rows=dealt)
    dealt = rounds.read("rows", dealt.schema, 0)
    up_to = Window.partitionBy(*keys, "__range").orderBy("at", "__asked").rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("__inside", F.last("__value", True).over(up_to))
    latest = dealt.groupBy(*keys, "__range").agg(F.max(F.when(F.col("__asked") == 0, F.struct("at", "__value"))).alias("m"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(*(F.col(k).alias(f"__by_{k}") for k in keys), F.col("__range").alias("__r"), F.last("m.__value", True).over(earlier).alias("__carried"))
    on = functools.reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"__by_{k}")), keys, F.col("__range") == F.col("__r"))
    found = inside.where("__asked = 1").join(carried.hint("merge"), on).withColumn("__found", F.coalesce("__inside", "__carried"))
    return found.select("__question.*", *(F.col(f"__found.{v}").alias(v) for v in values))
