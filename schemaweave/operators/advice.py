"""Deterministic advice over a project's tables, and its call log."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts of the deterministic provider.
TITLES = {"RISK_EXPLANATION": "Risk explanation draft", "SQL_REWRITE": "SQL rewrite draft", "VALIDATION_PLAN": "Validation plan draft", "REPORT_SUMMARY": "Precheck report summary draft"}
SUMMARY = "Detected %d objects, %d dependencies, %d risks and %d conversion results."
CHANGE_PLAN = ["Review HIGH/BLOCKER risks first.", "Apply deterministic rules before manual edits.", "Keep edited SQL as a new version instead of overwriting generated SQL."]
VALIDATION_PLAN = ["Run PostgreSQL syntax precheck.", "Validate converted object dependencies.", "Regenerate precheck report before approval."]
NO_RISKS, HUMAN = "No risks were available in context; suggestion is limited to current assets.", "This is a deterministic mock suggestion; human approval is still required."


class AdviceProvider(Protocol):
    """Extension point."""

    name: str

    def suggest(self, kind: str, objects: DataFrame, dependencies: DataFrame, risks: DataFrame, conversions: DataFrame) -> DataFrame: ...


class RuleProvider:
    name = "rules"

    def suggest(self, kind: str, objects: DataFrame, dependencies: DataFrame, risks: DataFrame, conversions: DataFrame) -> DataFrame:
        """Per project: type, title, summary, rule hits, distinct rule codes and affected objects, plans, uncertainty."""
        count = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
        o = count(objects, "n_objects").join(count(dependencies, "n_dependencies"), "project_id", "left").join(count(conversions, "n_conversions"), "project_id", "left")
        r = risks.groupBy("project_id").agg(F.count("*").alias("n_risks"), F.collect_list("rule_hit").alias("rule_hits"), F.array_sort(F.collect_set("code")).alias("rule_codes"), F.array_sort(F.collect_set("object_id")).alias("affected_objects"))
        a = o.join(r, "project_id", "left").fillna(0, ["n_risks", "n_dependencies", "n_conversions"])
        summary = F.format_string(SUMMARY, "n_objects", "n_dependencies", "n_risks", "n_conversions")
        unsure = F.when(F.col("n_risks") == 0, NO_RISKS).otherwise(HUMAN)
        listed = lambda texts: F.array(*map(F.lit, texts))
        return a.select("project_id", F.lit(kind).alias("type"), F.lit("DRAFT").alias("status"), F.lit(TITLES[kind]).alias("title"), summary.alias("summary"), "rule_hits", "rule_codes", "affected_objects", listed(CHANGE_PLAN).alias("change_plan"), listed(VALIDATION_PLAN).alias("validation_plan"), unsure.alias("uncertainty"), "n_objects", "n_risks")


def stamped(suggestions: DataFrame, at: Column | None = None) -> DataFrame:
    """Suggestions with created_at from a clock (now)."""
    return suggestions.withColumn("created_at", F.current_timestamp() if at is None else at)


def call_log(suggestions: DataFrame, provider: str) -> DataFrame:
    """A call per suggestion, at the time of the suggestion if it has one."""
    at = ["created_at"] if "created_at" in suggestions.columns else []
    return suggestions.select("project_id", F.lit(provider).alias("provider"), "type", F.col("n_objects").alias("object_count"), F.col("n_risks").alias("risk_count"), *at)
