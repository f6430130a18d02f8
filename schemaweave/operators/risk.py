"""Risk rules as a table: one projection, one explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textops as T

LEVELS = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "BLOCKER": 3}
# What makes a package's global state, and the narrow number types.
PACKAGE = r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:editionable\s+|noneditionable\s+)?package\b"
GLOBAL = r"(?im)^\s*[a-z_][\w$#]*\s+(?:constant\s+)?(?:number|varchar2|date|timestamp|boolean|clob|blob)\b.*;"
NARROW = r"(?i)number\s*\(\s*(?:10|19)\s*,\s*0\s*\)"

# Code, level, pattern on the blanked text (None: see predicate), message, evidence (None: the matched text).
RULES = [
    ("NUMBER_INTEGER_NARROWING_REVIEW", "HIGH", NARROW, "NUMBER(10,0) and NUMBER(19,0) must not be narrowed to integer or bigint without value profile evidence.", None),
    ("SYSDATE_TIME_SEMANTICS", "HIGH", r"(?i)\bsysdate\b", "SYSDATE needs explicit review: PostgreSQL transaction time, statement time, and real current time are different choices.", "SYSDATE"),
    ("NUMBER_WITHOUT_PRECISION", "MEDIUM", r"(?i)\bnumber\b(?!\s*\()", "NUMBER without precision should map to numeric and remain review-required.", "NUMBER"),
    ("ORACLE_DATE_TIME_SEMANTICS", "MEDIUM", r"(?i)\bdate\b", "Oracle DATE stores date and time; PostgreSQL target type needs explicit semantic review.", "DATE"),
    ("ORACLE_EMPTY_STRING_AS_NULL", "HIGH", None, "Oracle treats empty string as NULL, while PostgreSQL distinguishes empty string and NULL.", "''"),
    ("QUOTED_IDENTIFIER_CASE_SENSITIVE", "MEDIUM", T.QUOTED, "Quoted identifiers become case-sensitive and should be reviewed for application SQL compatibility.", '"identifier"'),
    ("ROWNUM_REWRITE_REQUIRED", "MEDIUM", r"(?i)\brownum\b", "ROWNUM needs PostgreSQL rewrite with LIMIT or window functions depending on ordering semantics.", "ROWNUM"),
    ("CONNECT_BY_REWRITE_REQUIRED", "HIGH", r"(?i)\bconnect\s+by\b", "CONNECT BY hierarchical queries need recursive CTE rewrite.", "CONNECT BY"),
    ("DECODE_REWRITE_REQUIRED", "MEDIUM", r"(?i)\bdecode\s*\(", "DECODE should be rewritten to CASE with NULL comparison semantics reviewed.", "DECODE"),
    ("NVL_REWRITE_REQUIRED", "MEDIUM", r"(?i)\bnvl\s*\(", "NVL should be rewritten to COALESCE after checking datatype coercion behavior.", "NVL"),
    ("ORACLE_HINT_IGNORED", "LOW", None, "Oracle optimizer hints are not portable and should be removed or replaced with PostgreSQL tuning evidence.", "/*+ hint */"),
    ("DYNAMIC_SQL_REVIEW_REQUIRED", "HIGH", r"(?i)\bexecute\s+immediate\b", "Dynamic SQL needs manual review because dependencies and generated syntax cannot be fully inferred statically.", "EXECUTE IMMEDIATE"),
    ("AUTONOMOUS_TRANSACTION_UNSUPPORTED", "BLOCKER", r"(?i)\bpragma\s+autonomous_transaction\b", "Oracle autonomous transactions have no direct PostgreSQL equivalent and require application-level redesign.", "PRAGMA AUTONOMOUS_TRANSACTION"),
    ("PACKAGE_GLOBAL_STATE_REVIEW_REQUIRED", "HIGH", None, "Package global variables carry session state and need explicit redesign in PostgreSQL.", "package global variable"),
]


def predicate(code: str, pattern: str | None, sql: Column, blanked: Column) -> Column:
    if pattern:
        return blanked.rlike(pattern)
    return {
        "ORACLE_EMPTY_STRING_AS_NULL": lambda: T.has_empty_literal(sql),
        "ORACLE_HINT_IGNORED": lambda: sql.rlike(r"(?s)/\*\+.*?\*/"),
        "PACKAGE_GLOBAL_STATE_REVIEW_REQUIRED": lambda: blanked.rlike(PACKAGE) & blanked.rlike(GLOBAL),
    }[code]()


def detect(sql: Column, blanked: Column) -> Column:
    """array<struct(code, level, message, evidence)>, each rule at most once, in the order of the table."""
    hits = []
    for code, level, pattern, message, evidence in RULES:
        found = F.regexp_extract(blanked, NARROW, 0) if evidence is None else F.lit(evidence)
        hits.append(F.when(predicate(code, pattern, sql, blanked), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), F.lit(message).alias("message"), found.alias("evidence"))))
    return F.array_compact(F.array(*hits))


def assess(objs: DataFrame) -> DataFrame:
    """risk_issue rows of objects that carry original_sql and blank_sql."""
    rows = objs.select("project_id", "source_project_id", "input_source_id", "object_id", F.inline(detect(F.col("original_sql"), F.col("blank_sql"))))
    hit = F.struct(F.col("code").alias("rule_code"), F.col("message").alias("title"), F.col("evidence").alias("source_fragment"), F.col("message").alias("explanation"))
    return rows.withColumn("rule_hit", hit)


def level_rank(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), level)
