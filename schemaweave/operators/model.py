"""Classifier, object model and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textops as T

CREATE = r"(?is)^create\s+(?:or\s+replace\s+)?(?:(?:no\s+)?force\s+)?(?:(?:non)?editionable\s+)?(?:(?:unique|bitmap)\s+)?(package\s+body|package|(?:global\s+temporary\s+|private\s+temporary\s+)?table|index|view|sequence|trigger|function|procedure)\s+(.*)$"
NAME = r'(?s)^((?:"[^"]*"?|[^\s("])+)'
CONSTRAINT = r"(?i)^(?:constraint |primary key|unique |check |foreign key)"
TYPE_END = r"(?is)^(.*?)(?: default | not null| null| constraint | primary key| unique| check | references | generated |$)"


def object_type(sql: Column) -> Column:
    """Of a create statement without leading comments; UNKNOWN for anything else."""
    token = F.regexp_replace(F.lower(F.regexp_extract(sql, CREATE, 1)), r"\s+", " ")
    return F.when(token == "", "UNKNOWN").when(token.endswith("table"), "TABLE").otherwise(F.upper(F.replace(token, F.lit(" "), F.lit("_"))))


def qualified(sql: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(sql, CREATE, 2), NAME, 1)


def classify(statements: DataFrame) -> DataFrame:
    """Adds original_sql, blank_sql, type, schema_name and object_name; statements that are only comments go."""
    s = statements.withColumn("blank_sql", T.blank(F.col("text"))).where(~T.is_blank(T.blank_comments(F.col("text"))))
    s = s.withColumn("head", T.strip_leading_comments(F.col("text"))).withColumn("type", object_type(F.col("head")))
    s = s.withColumn("identifier", qualified(F.col("head")))
    split = r'(?s)^((?:"(?:""|[^"])*"|[^."])*)\.(.*)$'
    dotted = F.col("identifier").rlike(split)
    s = s.withColumn("schema_name", F.when(dotted, T.unquote(T.trimmed(F.regexp_extract("identifier", split, 1)))))
    return s.withColumn("object_name", T.unquote(T.trimmed(F.when(dotted, F.regexp_extract("identifier", split, 2)).otherwise(F.col("identifier"))))).withColumnRenamed("text", "original_sql")


def object_id() -> Column:
    return F.sha2(F.concat_ws("|", "project_id", "source_project_id", "input_source_id", F.col("start_offset").cast("string")), 256)


def objects(classified: DataFrame) -> DataFrame:
    """db_object rows: statements with a known type and a name."""
    keep = classified.where((F.col("type") != "UNKNOWN") & ~T.is_blank(F.col("object_name")))
    return keep.select(object_id().alias("object_id"), "project_id", "source_project_id", "input_source_id", "type", "schema_name", "object_name", F.lit("PARSED").alias("status"), "source_path", "start_line", "end_line", "start_offset", "end_offset", "original_sql", "blank_sql")


def parse_issues(classified: DataFrame) -> DataFrame:
    lost = classified.where((F.col("type") == "UNKNOWN") | T.is_blank(F.col("object_name")))
    return lost.select(object_id().alias("issue_id"), "project_id", "source_project_id", "input_source_id", F.lit("UNSUPPORTED_STATEMENT").alias("code"), F.lit("Statement is not supported by the object model.").alias("message"), "source_path", "start_line", "end_line", "start_offset", "end_offset", F.col("original_sql").alias("original_text"))


def table_parts(objs: DataFrame) -> DataFrame:
    """Parts of every table's parentheses in order, parsed once for the model and the converter."""
    body = T.first_paren(T.blank_comments(T.strip_leading_comments(F.col("original_sql"))))
    parts = objs.where("type = 'TABLE'").select("object_id", "project_id", "source_project_id", "input_source_id", F.posexplode(T.top_commas(body)).alias("pos", "part")).where(~T.is_blank(F.col("part")))
    parts = parts.withColumn("is_constraint", F.col("part").rlike(CONSTRAINT))
    name = F.regexp_extract("part", rf'(?s)^("(?:""|[^"])*"|[^{T.WHITE}]+)', 1)
    rest = T.stripped(F.substring(F.col("part"), F.length(name) + 1, F.length("part")))
    parts = parts.withColumn("name", name).withColumn("rest", rest).withColumn("source_type", T.stripped(F.regexp_extract(F.col("rest"), TYPE_END, 1)))
    parts = parts.withColumn("suffix", T.stripped(F.substring(F.col("rest"), F.length("source_type") + 1, F.length("rest"))))
    return parts.withColumn("quoted", F.col("name").startswith('"')).withColumn("nullable", ~F.lower("part").contains(" not null"))


def columns(parts: DataFrame) -> DataFrame:
    """db_column rows; ordinals count the columns of a table from 1."""
    from pyspark.sql import Window

    order = Window.partitionBy("object_id").orderBy("pos")
    return parts.where("not is_constraint").select("object_id", "project_id", "source_project_id", "input_source_id", "pos", T.unquote(F.col("name")).alias("name"), "source_type", "nullable", "suffix", "quoted", F.row_number().over(order).alias("ordinal_position"))


def replace_by_source(stored: DataFrame, fresh: DataFrame, sources: DataFrame, key: str = "input_source_id") -> DataFrame:
    """The stored rows of the ``sources`` that came in give way to the fresh ones; a source that yields no row any more keeps none."""
    return stored.join(sources.select(key).distinct().hint("merge"), key, "left_anti").unionByName(fresh)
