"""SQL version chain: generated versions, edits, baselines. All by windows and aggregates per object."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textops as T

KEYS = ["project_id", "source_project_id", "input_source_id", "object_id"]
COLUMNS = ["version_id", *KEYS, "conversion_id", "parent_version_id", "version_number", "source", "status", "source_sql", "target_sql", "created_at"]


def _id() -> F.Column:
    return F.sha2(F.concat_ws("|", F.lit("version"), "object_id", F.col("version_number").cast("string")), 256)


def marked(column: str, level: str) -> F.Column:
    """Whether SQL still begins, white space aside, with the marker of a draft or of manual work."""
    return F.ltrim(F.col(column), F.lit(T.WHITE)).startswith(f"-- {level}")


def generated(conversions: DataFrame, at: F.Column | None = None) -> DataFrame:
    """Version 1 of every conversion, made at ``at`` (now)."""
    at = F.current_timestamp() if at is None else at
    v = conversions.withColumn("version_number", F.lit(1)).withColumn("parent_version_id", F.lit(None).cast("string"))
    return v.select(_id().alias("version_id"), *KEYS, "conversion_id", "parent_version_id", "version_number", F.lit("AUTO_CONVERSION").alias("source"), F.lit("GENERATED").alias("status"), F.col("original_sql").alias("source_sql"), "target_sql", at.alias("created_at"))


def with_edits(versions: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (project_id, parent_version_id, target_sql, edit_order and, where it isn't now, created_at) as children of their parents; blank ones and those without a parent in their project don't count."""
    at = F.col("created_at") if "created_at" in edits.columns else F.current_timestamp()
    kept = edits.where(~T.is_blank(F.col("target_sql"))).select("project_id", "parent_version_id", F.col("target_sql").alias("edited"), "edit_order", at.alias("created_at"))
    parents = versions.withColumnRenamed("version_id", "parent").drop("parent_version_id", "target_sql", "created_at")
    found = kept.join(parents.hint("merge"), (kept["parent_version_id"] == parents["parent"]) & (kept["project_id"] == parents["project_id"])).drop(kept["project_id"])
    last = versions.groupBy("object_id").agg(F.max("version_number").alias("last"))
    order = Window.partitionBy("object_id").orderBy("edit_order", "parent_version_id")
    rows = found.join(last.hint("merge"), "object_id").withColumn("version_number", F.col("last") + F.row_number().over(order))
    rows = rows.withColumn("version_id", _id()).withColumn("source", F.lit("USER_EDIT")).withColumn("status", F.lit("EDITED")).withColumnRenamed("edited", "target_sql")
    return versions.select(COLUMNS).unionByName(rows.select(COLUMNS))


def freeze(versions: DataFrame) -> DataFrame:
    """The latest version of each object becomes BASELINE, older baselines STALE."""
    newest = F.max("version_number").over(Window.partitionBy("project_id", "object_id")) == F.col("version_number")
    return versions.withColumn("status", F.when(newest, "BASELINE").when(F.col("status") == "BASELINE", "STALE").otherwise(F.col("status")))


def replace_generated(stored: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """Generated versions of the ``sources`` that came in give way to the fresh ones; edits stay."""
    again = sources.select("input_source_id").distinct().withColumn("again", F.lit(True))
    kept = stored.join(again.hint("merge"), "input_source_id", "left").where("again is null or source <> 'AUTO_CONVERSION'").drop("again")
    return kept.unionByName(fresh)


def freeze_approved(versions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Projects with an approving review (project_id, decision, rejection) are frozen, the others stay as they are."""
    approved = reviews.where("rejection is null and decision in ('APPROVED', 'CONDITIONALLY_APPROVED')").select("project_id").distinct().withColumn("approved", F.lit(True))
    frozen = freeze(versions.withColumn("before", F.col("status")).join(approved, "project_id", "left"))
    return frozen.withColumn("status", F.when(F.col("approved"), F.col("status")).otherwise(F.col("before"))).select(versions.columns)


def latest_usable(versions: DataFrame) -> DataFrame:
    """(project_id, object_id, version_number, target_sql) of each object's newest version that isn't STALE."""
    return versions.where("status <> 'STALE'").groupBy("project_id", "object_id").agg(F.max("version_number").alias("version_number"), F.max_by("target_sql", "version_number").alias("target_sql"))
