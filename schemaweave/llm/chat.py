r"""Chat formatting over typed content parts.

A visitor walks the parts of a turn in order. Text is kept; an image, an audio clip or a document becomes a placeholder
``<kind:n>`` (n counts the attachments of the turn from 0) and an attachment row with its reference and the number of
tokens it expands to. The template wraps a turn as ``### role:\n`` text ``</turn>\n``; inside roles and texts each of
``\ # < :`` (the colon in roles only) gets a backslash before it, so that no text can hold a live marker and every text
can be read back exactly. The loss mask covers an assistant turn's text and nothing else.

Contract: turns are ordered by turn, ties by role and text, null turns first; null role or text is empty; a null list of
parts is no parts; repeated rows are repeated turns; extra columns are ignored; an empty table gives no rows. A
conversation is hashed as a stream in order, so one of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parallelism

HEAD, MID, TAIL = "### ", ":\n", "</turn>\n"
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*):\n((?:[^\\#<]|\\.|<\w+:\d+>)*)</turn>\n", re.S)
_TEXT, _ROLE, _BACK = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.S)
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<position:int,kind:string,ref:string,n_tokens:bigint>>"


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _TEXT).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


class PartVisitor:
    """Flattens parts: one method per kind; subclass it for other expansion rules or further kinds."""

    patch, tokens_per_second, tokens_per_page = 28, 25, 1024

    def __init__(self):
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        """Kinds without a method of their own are kept as their text and, where they refer to something, as an attachment of no known size."""
        getattr(self, f"visit_{part.get('kind')}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_other(self, part: dict) -> None:
        self.visit_text(part)
        if part.get("ref") is not None:
            self._attach(part | {"kind": re.sub(r"\W", "_", part.get("kind") or "") or "file"}, 0)

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("seconds") or 0) * self.tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * self.tokens_per_page)

    def _attach(self, part: dict, n_tokens: int) -> None:
        position = len(self.attachments)
        self.out.append(f"<{part['kind']}:{position}>")
        self.attachments.append({"position": position, "kind": part["kind"], "ref": part.get("ref"), "n_tokens": n_tokens})


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", visitor: type[PartVisitor] = PartVisitor, loss_role: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss_start, loss_end (code points in ``formatted``), attachments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attachments = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())]))
        for batch in batches:
            formatted, start, end, files = [], [], [], []
            for role, parts in zip(batch["role"].to_pylist(), batch["parts"].to_pylist(), strict=True):
                v = visitor()
                for part in parts or []:
                    if part is not None:
                        v.visit(part)
                head, body = f"{HEAD}{escape(role or '', True)}{MID}", "".join(v.out)
                formatted.append(f"{head}{body}{TAIL}")
                start.append(len(head))
                end.append(len(head) + len(body) * (role == loss_role))
                files.append(v.attachments)
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], pa.array(formatted), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(files, attachments)], ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"])

    own = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[parts_col].cast(PARTS).alias("parts"))
    kinds = {k: t for k, t in own.dtypes}
    return own.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, loss_start int, loss_end int, attachments {ATTACHMENTS}")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted text; raises ValueError if anything lies between turns."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from what ``format_turns`` made: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def begin(conv) -> dict:
            return {"conv": conv, "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0}

        def end(x: dict) -> tuple:
            return x["conv"], x["turns"], x["sha"].hexdigest(), x["loss"], x["loss_sha"].hexdigest(), x["chars"]

        def flush() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch["conv_id"].type
            for conv, formatted, start, stop in zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist(), batch["loss_start"].to_pylist(), batch["loss_end"].to_pylist(), strict=True):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        rows.append(end(now))
                    now = begin(conv)
                for role, text in read_back(formatted):
                    now["turns"] += 1
                    now["sha"].update(f"{role}\n{text}\n".encode())
                loss = unescape(formatted[start:stop])
                now["loss"] += len(loss)
                now["loss_sha"].update(loss.encode())
                now["chars"] += len(formatted)
            if len(rows) >= 1000:
                yield flush()
                rows.clear()
        if now is not None:
            rows.append(end(now))
        if rows:
            yield flush()

    plain = lambda c: F.regexp_replace(c, r"(?s)\\(.)", "$1")
    role = plain(F.substring(F.col("formatted"), len(HEAD) + 1, F.col("loss_start") - len(HEAD) - len(MID)))
    text = plain(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.length("formatted") - F.col("loss_start") - len(TAIL)))
    dealt = turns.repartition(parallelism(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", role, text).select("conv_id", "formatted", "loss_start", "loss_end")
    return dealt.mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
