"""Source types to target types, and two expressions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textops import trimmed

PARAMETERS, LENGTH = r"^(\w+)\s*\(([^)]*)\)$", r"(?i)^(\d+)\s*(CHAR|BYTE)?$"

# The notes of the mapping rules.
NOTE_NARROW = "Do not narrow NUMBER(p,0) to integer or bigint without value profile evidence."
NOTE_RAW = "Verify RAW length constraints separately."
NOTE_NONE = "No automatic mapping is defined."
NOTE_LENGTH = "Character length could not be mapped automatically."
NOTE_NUMBER = "NUMBER without precision needs review."
NOTE_DATE = "Oracle DATE includes time; confirm timezone and application semantics."
NOTE_UNIT = ("Review Oracle ", " length semantics against PostgreSQL character length semantics.")


def _result(target, review: bool, *notes) -> Column:
    listed = F.array(*(F.lit(n) if isinstance(n, str) else n for n in notes)) if notes else F.array().cast("array<string>")
    return F.struct((F.lit(target) if isinstance(target, str) else target).alias("target_type"), F.lit(review).alias("review_required"), listed.alias("notes"))


def map_type(source: Column) -> Column:
    """struct(target_type, review_required, notes)."""
    s = trimmed(source)
    base, inside = F.upper(F.regexp_extract(s, PARAMETERS, 1)), trimmed(F.regexp_extract(s, PARAMETERS, 2))
    length = F.regexp_replace(inside, r"\s+", " ")
    n, unit = F.regexp_extract(length, LENGTH, 1), F.upper(F.regexp_extract(length, LENGTH, 2))
    chars = F.concat(F.lit("varchar("), n, F.lit(")"))
    text = F.when(n == "", _result(s, True, NOTE_LENGTH)).when(unit == "", _result(chars, False)).otherwise(_result(chars, True, F.concat(F.lit(NOTE_UNIT[0]), unit, F.lit(NOTE_UNIT[1]))))
    number = _result(F.concat(F.lit("numeric("), F.regexp_replace(inside, r"\s+", ""), F.lit(")")), False, NOTE_NARROW)
    with_parameters = F.when(base.isin("VARCHAR2", "NVARCHAR2"), text).when(base == "NUMBER", number).when(base == "RAW", _result("bytea", False, NOTE_RAW)).otherwise(_result(s, True, NOTE_NONE))
    u = F.upper(s)
    plain = F.when(u == "NUMBER", _result("numeric", True, NOTE_NUMBER)).when(u == "DATE", _result("timestamp", True, NOTE_DATE)).when(u == "TIMESTAMP", _result("timestamp", False))
    plain = plain.when(u.isin("CLOB", "NCLOB"), _result("text", False)).when(u == "BLOB", _result("bytea", False)).otherwise(_result(s, True, NOTE_NONE))
    return F.when(s.rlike(PARAMETERS), with_parameters).otherwise(plain)


def rewrite_expression(expression: Column) -> Column:
    """struct(target, review_required) of an expression that is just the current time; others stay."""
    now = F.upper(trimmed(expression)).isin("SYSDATE", "SYSTIMESTAMP")
    return F.struct(F.when(now, "clock_timestamp()").otherwise(expression).alias("target"), now.alias("review_required"))
