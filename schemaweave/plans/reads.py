"""Read queries: filter by project, order as the API promises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import convert, risk
from ..operators.places import Falling, placed


def risk_order() -> tuple:
    return risk.level_rank(F.col("level")).desc(), F.col("code")


def conversion_order() -> tuple:
    return convert.level_rank(F.col("level")), F.col("object_id")


def ranked(df: DataFrame, *order: Column | str | Falling) -> DataFrame:
    """The place of every row in its project's order as a column, for readers that can't rely on the order of rows; ties share a place."""
    return placed(df, ["project_id"], *order)


def _of(df: DataFrame, project_id: str | None) -> DataFrame:
    return df if project_id is None else df.where(F.col("project_id") == project_id)


def objects(df: DataFrame, project_id: str | None = None, source_project_id: str | None = None) -> DataFrame:
    d = _of(df, project_id)
    d = d if source_project_id is None else d.where(F.col("source_project_id") == source_project_id)
    return d.orderBy("type", "object_name")


def parse_issues(df: DataFrame, project_id: str | None = None) -> DataFrame:
    return _of(df, project_id).orderBy("start_offset")


def risks(df: DataFrame, project_id: str | None = None) -> DataFrame:
    return _of(df, project_id).orderBy(*risk_order())


def conversions(df: DataFrame, project_id: str | None = None) -> DataFrame:
    return _of(df, project_id).orderBy(*conversion_order())


def dependencies(df: DataFrame, project_id: str | None = None) -> DataFrame:
    return _of(df, project_id).orderBy("type")


def versions(df: DataFrame, project_id: str | None = None) -> DataFrame:
    return _of(df, project_id).orderBy("object_id", "version_number")


def newest_first(df: DataFrame, project_id: str | None = None) -> DataFrame:
    """Reports, reviews, advice, call log."""
    return _of(df, project_id).orderBy(F.desc("created_at"))


def oldest_first(df: DataFrame, project_id: str | None = None) -> DataFrame:
    """Batches, sources, source projects."""
    return _of(df, project_id).orderBy("created_at")


def report_content(df: DataFrame, project_id: str, report_id: str, kind: str = "json_content") -> DataFrame:
    return _of(df, project_id).where(F.col("report_id") == report_id).select(kind)
