"""Statement splitter: one row of text in, one row per statement out.

The text is cut into tokens once (literals, q-quotes, comments, semicolons, line ends). From them every line knows its live
semicolons and whether it ends inside a token; statements are then put together line by line: up to a semicolon, or, once a
line makes the statement a procedural block, up to a line that holds just a slash. Lines that are empty vanish from plain
statements and stay in procedural ones; offsets are those of the text with unified line ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StructType

SCAN = re.compile(r"(?s)[qQ]'(?:\[.*?(?:\]'|\Z)|\(.*?(?:\)'|\Z)|\{.*?(?:\}'|\Z)|<.*?(?:>'|\Z)|([^\[({<\n]).*?(?:\1'|\Z))|'[^']*(?:''[^']*)*(?:'|\Z)|--[^\n]*|/\*.*?(?:\*/|\Z)|;|\n")
LEADING = re.compile(r"(?s)(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z))*")
BLOCK = re.compile(r"(?i)create\s+(?:or\s+replace\s+)?(?:(?:non)?editionable\s+)?(?:trigger|function|procedure|package)\b|declare|begin")
ROW = StructType().add("text", "string").add("start_line", "integer").add("end_line", "integer").add("start_offset", "integer").add("end_offset", "integer")


def _lines(text: str) -> Iterator[tuple[int, str, list[int], bool]]:
    """(offset, line, ends of its live semicolons, whether it ends inside a token)."""
    ends, breaks = [], set()
    for m in SCAN.finditer(text):
        if m[0] == ";":
            ends.append(m.end())
        elif m[0] == "\n":
            breaks.add(m.start())
    at = k = 0
    for line in text.split("\n"):
        stop, own = at + len(line), []
        while k < len(ends) and ends[k] <= stop:
            own.append(ends[k] - at)
            k += 1
        yield at, line, own, stop < len(text) and stop not in breaks
        at = stop + 1


def split(text: str | None) -> list[tuple[str, int, int, int, int]]:
    original, text = text or "", re.sub(r"\r\n?", "\n", text or "")
    out: list[tuple[str, int, int, int, int]] = []
    parts: list[str] = []
    line_no = first_line = first_offset = 0
    block = False

    def add(piece: str, offset: int) -> None:
        nonlocal first_line, first_offset
        if not parts:
            first_line, first_offset = line_no, offset
        parts.append(piece)

    def is_block() -> bool:
        joined = "\n".join(parts)
        return bool(BLOCK.match(joined, LEADING.match(joined).end()))

    def flush(end_line: int, end_offset: int) -> None:
        if statement := "\n".join(parts).strip():
            out.append((statement, first_line, end_line, first_offset, end_offset))
        parts.clear()

    for line_no, (offset, line, ends, inside) in enumerate(_lines(text), 1):
        if block:
            add(line, offset)
            if not inside and line.strip() == "/":
                flush(line_no, offset + len(line))
                block = False
            continue
        done = 0
        for end in ends:
            add(line[done:end], offset + done)
            if is_block():
                parts[-1] += line[end:] if line[end:].strip() else ""
                block = True
                break
            flush(line_no, offset + end)
            done = end
        if not block and (rest := line[done:]) and (parts or rest.strip()):
            add(rest, offset + done)
            block = is_block()
    flush(line_no, len(original))
    return out


@udtf(returnType=ROW)
class SplitStatements:
    """split_statements(text) for SQL: a row per statement."""

    def eval(self, text: str):
        yield from split(text)


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_statements", SplitStatements)


def split_statements(sources: DataFrame, text_col: str = "original_text", keys: tuple[str, ...] = ("project_id", "source_project_id", "input_source_id", "source_path")) -> DataFrame:
    """Statements of every source with its keys; an array per source, so that a source's rows stay in its task."""
    cut = F.udf(split, ArrayType(ROW), useArrow=True)
    return sources.select(*keys, F.inline(cut(F.col(text_col))))
