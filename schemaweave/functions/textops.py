"""Column functions over source text: literals, comments, identifiers, parentheses.

Everything that a regular expression can say stays in the JVM. The three functions that need a running depth or splicing by
offset are Arrow functions over whole batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: One token: a q-quote, a literal, a line or block comment, a run of plain text, or any other character.
TOKEN = r"(?s)[qQ]'(?:\[.*?(?:\]'|\z)|\(.*?(?:\)'|\z)|\{.*?(?:\}'|\z)|<.*?(?:>'|\z)|([^\[({<]).*?(?:\1'|\z))|'[^']*+(?:''[^']*+)*+(?:'|\z)|--[^\n]*+(?:\n|\z)|/\*.*?(?:\*/|\z)|[^qQ'/\-]++|."
LITERAL_OR_COMMENT, COMMENT = r"(?s)^(?:[qQ]'.|'|--|/\*)", r"^(?:--|/\*)"
LEADING_COMMENTS = r"(?s)^(?:\s++|--[^\n]*+(?:\n|\z)|/\*.*?(?:\*/|\z))++"
QUOTED = r'"(?:""|[^"])+"'
IDENTIFIER = rf"(?:{QUOTED}|[\w$#]+)"

# The white space that stripping takes away, and what trimming does (all up to the space).
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"
CONTROLS = "".join(map(chr, range(33)))

PY_TOKEN = re.compile(TOKEN.replace(r"\z", r"\Z"))
PY_MASKED = re.compile(LITERAL_OR_COMMENT)


def stripped(text: Column) -> Column:
    """Without the white space at both ends, of any kind."""
    return F.btrim(text, F.lit(WHITE))


def trimmed(text: Column) -> Column:
    """Without what isn't above the space at both ends: for type names, names of things and expressions."""
    return F.btrim(text, F.lit(CONTROLS))


def is_blank(text: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(stripped(text), F.lit("")) == ""


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _masked(text: Column, which: str) -> Column:
    return F.array_join(F.transform(tokens(text), lambda t: F.when(t.rlike(which), F.regexp_replace(t, r"\S", " ")).otherwise(t)), "")


def blank(text: Column) -> Column:
    """Literals and comments as white space of the same length, line ends kept."""
    return _masked(text, LITERAL_OR_COMMENT)


def blank_comments(text: Column) -> Column:
    """Comments as white space of the same length; literals stay."""
    return _masked(text, COMMENT)


def strip_leading_comments(text: Column) -> Column:
    return F.regexp_replace(text, LEADING_COMMENTS, "")


def has_empty_literal(text: Column) -> Column:
    return F.array_contains(tokens(text), "''")


def unquote(name: Column) -> Column:
    inner = F.substring(name, 2, F.length(name) - 2)
    return F.when(name.rlike(r'(?s)^".*"$') & (F.length(name) > 1), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(name)


def identifier_parts(name: Column) -> Column:
    """A qualified name at its dots outside quotes, parts trimmed."""
    return F.transform(F.regexp_extract_all(name, F.lit(r'((?:"(?:""|[^"])*"|[^."])+)'), F.lit(1)), stripped)


def normalise(name: Column) -> Column:
    """Unquoted parts joined by dots, in lower case; quoted case is folded too."""
    return F.lower(F.array_join(F.transform(identifier_parts(name), unquote), "."))


def quote_identifier(name: Column, quoted: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.when(quoted, name).otherwise(F.lower(name)), F.lit('"'), F.lit('""')), F.lit('"'))


def ensure_terminator(text: Column) -> Column:
    t = stripped(text)
    return F.when(t.endswith(";"), t).otherwise(F.concat(t, F.lit(";")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def illegal_path(path: Column) -> Column:
    """Blank, absolute, climbing or with a drive; a trailing ``/..`` is let through."""
    p = normal_path(path)
    return F.coalesce(is_blank(p) | p.startswith("/") | p.contains("../") | (p == "..") | p.contains(":/"), F.lit(True))


def allowed_extension(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(sql|ddl|pls|pks|pkb)$")


# ---- with a running depth or by offset


def mask(text: str) -> str:
    """``blank`` for one Python string."""
    return "".join(re.sub(r"\S", " ", t) if PY_MASKED.match(t) else t for t in (m[0] for m in PY_TOKEN.finditer(text)))


def paren_block(text: str) -> str:
    """What stands inside the first parentheses; empty if there are none or they don't close."""
    depth, start = 0, -1
    for m in re.finditer(r"[()]", mask(text)):
        if m[0] == "(":
            if not depth:
                start = m.end()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                return text[start : m.start()]
    return ""


def comma_parts(text: str) -> list[str]:
    """Parts between commas outside parentheses and literals, trimmed; the last one always."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"[(),]", mask(text)):
        if m[0] == ",":
            if not depth:
                out.append(text[start : m.start()].strip(WHITE))
                start = m.end()
        else:
            depth += 1 if m[0] == "(" else -1
    return [*out, text[start:].strip(WHITE)]


def replace_outside(text: str, pattern: re.Pattern, put) -> str:
    """Replace where the pattern matches the masked text, by the offsets of the match; ``put`` gets the original groups' offsets."""
    out, at = [], 0
    for m in pattern.finditer(mask(text)):
        out += [text[at : m.start()], put(m)]
        at = m.end()
    return "".join([*out, text[at:]])


@pandas_udf(StringType())
def first_paren(text: pd.Series) -> pd.Series:
    """First parenthesised block of a text whose comments are blank already."""
    return text.map(lambda t: None if t is None else paren_block(t))


@pandas_udf(ArrayType(StringType()))
def top_commas(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else comma_parts(t))
