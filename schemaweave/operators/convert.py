"""Converter: objects and table parts to target SQL, level, rule hits and notes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import textops as T
from ..functions.typemap import map_type
from .model import qualified

LEVELS = {"AUTO": 0, "REVIEW_REQUIRED": 1, "DRAFT": 2, "MANUAL_REQUIRED": 3, "UNSUPPORTED": 4}
_ID = r'(?:"(?:[^"]|"")+"|[\w$#]+)'
# The clauses that the conversion rules know.
SEQUENCE_DEFAULT = re.compile(rf"(?i)\bdefault\s+({_ID}(?:\.{_ID})*)\.nextval\b", re.A)
NOW = re.compile(r"(?i)\bsysdate\b", re.A)
USING_INDEX = re.compile(r"(?is)\s+using\s+index\b.*$", re.A)
STATES = re.compile(r"(?i)(?:\s+(?:enable|disable|validate|novalidate|rely|norely)\b)+\s*$", re.A)
TEMPORARY, ON_COMMIT = r"(?is)^\s*create\s+(?:global|private)\s+temporary\s+table\b", r"(?i)\bon\s+commit\s+(delete|preserve)\s+rows\b"
HIT = "struct<rule_code:string,title:string,source_fragment:string,explanation:string>"

# Notes and explanations of the conversion rules.
TEMPORARY_HIT = ("ORACLE_TEMPORARY_TABLE_REVIEW", "Review Oracle temporary table semantics", "temporary table", "Oracle temporary table lifetime and ON COMMIT behavior need explicit PostgreSQL review before export.")
TEMPORARY_NOTE = "Review Oracle temporary table lifetime and ON COMMIT behavior before freezing the SQL baseline."
COLUMN_HIT = ("ORACLE_INLINE_COLUMN_CLAUSE_REVIEW", "Review Oracle inline column clause", "Oracle-specific inline defaults or constraint modifiers were rewritten conservatively; review the generated PostgreSQL clause before export.")
COLUMN_NOTE = "Review rewritten Oracle inline column clauses before freezing the SQL baseline."
CONSTRAINT_HIT = ("ORACLE_TABLE_CONSTRAINT_REVIEW", "Review Oracle table constraint clause", "Oracle-specific table constraint clauses were rewritten conservatively; review the generated PostgreSQL constraint before export.")
CONSTRAINT_NOTE = "Review rewritten Oracle table constraints before freezing the SQL baseline."
MANUAL_NOTE = "Only conservative DDL conversion is available in the P0 automatic path."
DRAFT_NOTES = {
    "INDEX": "Review index method, expression syntax, and tablespace/storage clauses before execution.",
    "SEQUENCE": "Review sequence min/max/cache/cycle semantics and reset position after data load.",
    "VIEW": "Simple view SQL is carried forward as a draft; Oracle functions and outer joins still need precheck.",
}


def _regclass(name: str) -> str:
    parts = re.findall(_ID, name)
    return ".".join(p if p.startswith('"') else p.lower() for p in parts).replace("'", "''")


def rewritten(text: str, column: bool) -> str:
    """A column's suffix (defaults too) or a table constraint without clauses of the source dialect."""
    out = text
    if column:
        out = T.replace_outside(out, SEQUENCE_DEFAULT, lambda m: f"default nextval('{_regclass(text[m.start(1) : m.end(1)])}'::regclass)")
        out = T.replace_outside(out, NOW, lambda m: "clock_timestamp()")
    for pattern in (USING_INDEX, STATES):
        out = T.replace_outside(out, pattern, lambda m: "")
    return out.strip(T.WHITE) if out != text else text


@pandas_udf(StringType())
def rewrite_suffix(text: pd.Series) -> pd.Series:
    return text.map(lambda t: rewritten(t or "", True))


@pandas_udf(StringType())
def rewrite_constraint(text: pd.Series) -> pd.Series:
    return text.map(lambda t: rewritten(t or "", False))


def _hit(code, title, fragment, explanation) -> Column:
    values = [F.lit(x) if isinstance(x, str) else x for x in (code, title, fragment, explanation)]
    return F.struct(*(v.alias(n) for v, n in zip(values, ("rule_code", "title", "source_fragment", "explanation"), strict=True)))


_NO_HITS, _NO_NOTES = f"cast(array() as array<{HIT}>)", "cast(array() as array<string>)"


def _lines(parts: DataFrame) -> DataFrame:
    """One line of a table's body per part: columns in order, then constraints in order."""
    own = parts.withColumn("t", map_type(F.col("source_type"))).withColumn("new", F.when(F.col("is_constraint"), rewrite_constraint(F.col("part"))).otherwise(rewrite_suffix(F.col("suffix"))))
    changed = F.col("new") != F.when(F.col("is_constraint"), F.col("part")).otherwise(F.col("suffix"))
    type_code = F.concat(F.lit("TYPE_MAPPING_"), F.regexp_replace(F.upper("source_type"), "[^A-Z0-9]+", "_"))
    type_hit = _hit(type_code, F.concat(F.lit("Map Oracle type "), F.col("source_type")), F.col("source_type"), F.concat(F.lit("Mapped to PostgreSQL "), F.col("t.target_type")))
    tail = F.when(~T.is_blank(F.col("new")), F.concat(F.lit(" "), F.col("new"))).when(F.col("nullable"), "").otherwise(" not null")
    column = F.concat(F.lit("    "), T.quote_identifier(T.unquote(F.col("name")), F.col("quoted")), F.lit(" "), F.col("t.target_type"), tail)
    column_hits = F.when(changed, F.array(type_hit, _hit(COLUMN_HIT[0], COLUMN_HIT[1], F.col("suffix"), COLUMN_HIT[2]))).otherwise(F.array(type_hit))
    constraint_hits = F.when(changed, F.array(_hit(CONSTRAINT_HIT[0], CONSTRAINT_HIT[1], F.col("part"), CONSTRAINT_HIT[2]))).otherwise(F.expr(_NO_HITS))
    c = F.col("is_constraint")
    return own.select(
        "object_id",
        F.struct(
            c.cast("int").alias("kind"),
            "pos",
            F.when(c, F.concat(F.lit("    "), F.col("new"))).otherwise(column).alias("line"),
            F.when(c, constraint_hits).otherwise(column_hits).alias("hits"),
            F.when(c, F.when(changed, F.array(F.lit(CONSTRAINT_NOTE))).otherwise(F.expr(_NO_NOTES))).otherwise(F.concat(F.col("t.notes"), F.when(changed, F.array(F.lit(COLUMN_NOTE))).otherwise(F.expr(_NO_NOTES)))).alias("notes"),
            (changed | (~c & F.col("t.review_required"))).alias("review"),
        ).alias("x"),
    )


def output_name(sql: Column) -> Column:
    """The last two parts of a table's name as the header spells them, quoted for output."""
    parts = F.filter(T.identifier_parts(qualified(T.strip_leading_comments(sql))), lambda p: p != "")
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2)
    return F.array_join(F.transform(last, lambda p: T.quote_identifier(T.unquote(p), p.startswith('"'))), ".")


def convert(objs: DataFrame, parts: DataFrame) -> DataFrame:
    """conversion_result rows of all objects; a table's parts are gathered per table, other types are projections."""
    keys = ["object_id", "project_id", "source_project_id", "input_source_id", "type", "original_sql"]
    body = _lines(parts).groupBy("object_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    tables = objs.where("type = 'TABLE'").select(*keys, "blank_sql").join(body.hint("merge"), "object_id", "left")
    temporary = T.strip_leading_comments(F.col("original_sql")).rlike(TEMPORARY)
    commit = F.lower(F.regexp_extract("blank_sql", ON_COMMIT, 1))
    end = F.when(temporary, F.concat(F.lit(" on commit "), F.when(commit == "", "delete").otherwise(commit), F.lit(" rows"))).otherwise("")
    sql = F.concat(F.when(temporary, "create temporary table ").otherwise("create table "), output_name(F.col("original_sql")), F.lit(" (\n"), F.coalesce(F.array_join(F.col("x.line"), ",\n"), F.lit("")), F.lit("\n)"), end, F.lit(";"))
    hits = F.concat(F.when(temporary, F.array(_hit(*TEMPORARY_HIT))).otherwise(F.expr(_NO_HITS)), F.coalesce(F.flatten("x.hits"), F.expr(_NO_HITS)))
    notes = F.concat(F.when(temporary, F.array(F.lit(TEMPORARY_NOTE))).otherwise(F.expr(_NO_NOTES)), F.coalesce(F.flatten("x.notes"), F.expr(_NO_NOTES)))
    review = temporary | F.coalesce(F.exists("x", lambda r: r["review"]), F.lit(False))
    done = tables.select(*keys, sql.alias("target_sql"), F.when(review, "REVIEW_REQUIRED").otherwise("AUTO").alias("level"), hits.alias("rule_hits"), F.array_distinct(notes).alias("notes"))
    note = F.element_at(F.create_map(*[F.lit(x) for kv in DRAFT_NOTES.items() for x in kv]), F.col("type"))
    draft = F.col("type").isin(*DRAFT_NOTES)
    others = objs.where("type <> 'TABLE'").select(*keys).select(
        *keys,
        F.when(draft, F.concat(F.lit("-- DRAFT: "), note, F.lit("\n"), T.ensure_terminator(F.col("original_sql")))).otherwise(F.concat(F.lit(f"-- MANUAL_REQUIRED: {MANUAL_NOTE}\n"), F.col("original_sql"))).alias("target_sql"),
        F.when(draft, "DRAFT").otherwise("MANUAL_REQUIRED").alias("level"),
        F.array(F.when(draft, _hit(F.concat(F.lit("CONSERVATIVE_"), F.col("type"), F.lit("_DRAFT")), "Conservative DDL draft", F.col("type"), note)).otherwise(_hit("MANUAL_REQUIRED_OBJECT", "Manual conversion required", F.col("type"), MANUAL_NOTE))).alias("rule_hits"),
        F.array(F.when(draft, note).otherwise(MANUAL_NOTE)).alias("notes"),
    )
    both = done.unionByName(others)
    return both.select(F.sha2(F.concat(F.lit("conversion|"), F.col("object_id")), 256).alias("conversion_id"), *keys, "target_sql", "level", "rule_hits", "notes")


def level_rank(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), level)


#: Extension point: converters of further types; a function from objects to conversion_result rows per type.
CONVERTERS: dict = {}


def convert_with_extensions(objs: DataFrame, parts: DataFrame) -> DataFrame:
    own = [f(objs.where(F.col("type") == t)) for t, f in CONVERTERS.items()]
    out = convert(objs.where(~F.col("type").isin(*CONVERTERS)) if CONVERTERS else objs, parts)
    for x in own:
        out = out.unionByName(x)
    return out
