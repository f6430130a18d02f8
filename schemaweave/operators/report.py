"""Precheck reports: conditional counts per fact, one status rule, two renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import latest_usable, marked

COUNTS = ["object_count", "parse_issue_count", "risk_count", "blocker_count", "high_risk_count", "conversion_count", "sql_version_count"]

# Labels of the counts in the rendered report, in order.
LABELS = ["Objects", "Parse Issues", "Risks", "Blockers", "High Risks", "Conversions", "SQL Versions"]
HTML = ('<!doctype html><html><head><meta charset="utf-8"><title>Precheck Report</title></head><body><h1>Precheck Report</h1><dl>', "</dl></body></html>")


def _counts(objects: DataFrame, issues: DataFrame, risks: DataFrame, conversions: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """One union of slim rows and one aggregate: no fact is joined with another."""
    facts = None
    for name, df in (("object_count", objects), ("parse_issue_count", issues), ("risk_count", risks), ("conversion_count", conversions), ("sql_version_count", versions)):
        level = F.col("level") if name == "risk_count" else F.lit(None).cast("string")
        part = df.select(*keys, F.lit(name).alias("fact"), level.alias("level"))
        facts = part if facts is None else facts.unionByName(part)
    is_fact = lambda n: F.count_if(F.col("fact") == n).alias(n)
    return facts.groupBy(*keys).agg(is_fact("object_count"), is_fact("parse_issue_count"), is_fact("risk_count"), F.count_if(F.col("level") == "BLOCKER").alias("blocker_count"), F.count_if(F.col("level") == "HIGH").alias("high_risk_count"), is_fact("conversion_count"), is_fact("sql_version_count"))


def unedited(conversions: DataFrame, versions: DataFrame) -> DataFrame:
    """Drafts and manual conversions whose newest usable version is missing or still says so."""
    usable = latest_usable(versions).select("project_id", "object_id", F.col("target_sql").alias("usable_sql"))
    left = conversions.where("level in ('DRAFT', 'MANUAL_REQUIRED')").join(usable.hint("merge"), ["project_id", "object_id"], "left")
    return left.where(F.col("usable_sql").isNull() | marked("usable_sql", "MANUAL_REQUIRED") | marked("usable_sql", "DRAFT"))


def precheck(objects: DataFrame, issues: DataFrame, risks: DataFrame, conversions: DataFrame, versions: DataFrame, at: Column | None = None) -> DataFrame:
    """Per project: the seven counts, status, json_content and html_content; with a clock ``at`` also created_at."""
    counts = _counts(objects, issues, risks, conversions, versions, ["project_id"])
    open_work = unedited(conversions, versions).groupBy("project_id").agg(F.count("*").alias("open_conversions"))
    r = counts.join(open_work, "project_id", "left").withColumn("open_conversions", F.coalesce("open_conversions", F.lit(0)))
    r = r.withColumn("status", F.when((F.col("blocker_count") > 0) | (F.col("parse_issue_count") > 0) | (F.col("open_conversions") > 0), "BLOCKED").otherwise("CURRENT"))
    named = [F.col(c).alias(n) for c, n in zip(COUNTS, ("objectCount", "parseIssueCount", "riskCount", "blockerCount", "highRiskCount", "conversionCount", "sqlVersionCount"), strict=True)]
    r = r.withColumn("json_content", F.to_json(F.struct(F.col("project_id").alias("projectId"), F.lit("PRECHECK").alias("type"), "status", *named)))
    entries = [("Project", "project_id"), ("Status", "status"), *zip(LABELS, COUNTS, strict=True)]
    lines = F.concat(*[F.concat(F.lit(f"<dt>{label}</dt><dd>"), F.col(c).cast("string"), F.lit("</dd>")) for label, c in entries])
    r = r.withColumn("html_content", F.concat(F.lit(HTML[0]), lines, F.lit(HTML[1])))
    return r if at is None else r.withColumn("created_at", at)


def rolled_up(objects: DataFrame, issues: DataFrame, risks: DataFrame, conversions: DataFrame, versions: DataFrame) -> DataFrame:
    """The counts per source project and, with a null source project, per project; score: 100 less 25, 10 and 1 per blocker, high risk and other risk and object, at least 0."""
    base = _counts(objects, issues, risks, conversions, versions, ["project_id", "source_project_id"])
    up = base.rollup("project_id", "source_project_id").agg(*[F.sum(c).alias(c) for c in COUNTS]).where("project_id is not null")
    cost = (25 * F.col("blocker_count") + 10 * F.col("high_risk_count") + (F.col("risk_count") - F.col("blocker_count") - F.col("high_risk_count"))) / F.greatest(F.col("object_count"), F.lit(1))
    return up.withColumn("score", F.greatest(F.lit(0), F.floor(100 - cost)).cast("long"))


def with_staleness(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """Reports older than the last change of their project are STALE, in their rendered contents too; changes: project_id, changed_at."""
    last = changes.groupBy("project_id").agg(F.max("changed_at").alias("changed_at"))
    old = F.coalesce(F.col("created_at") < F.col("changed_at"), F.lit(False))
    r = reports.join(last, "project_id", "left")
    for column, start, end in (("json_content", '"status":"', '"'), ("html_content", "<dt>Status</dt><dd>", "</dd>")):
        if column in reports.columns:
            was = F.concat(F.lit(start), F.col("status"), F.lit(end))
            r = r.withColumn(column, F.when(old, F.replace(column, was, F.lit(f"{start}STALE{end}"))).otherwise(F.col(column)))
    return r.withColumn("status", F.when(old, "STALE").otherwise(F.col("status"))).drop("changed_at")
