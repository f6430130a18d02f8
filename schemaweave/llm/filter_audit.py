"""Filter interaction audit: what each order of five text filters removes, from additive counters.

A row is failed by A (fewer than MIN_WORDS words), B (100 * distinct words < 50 * words), C (100 * ``[A-Z]`` > 3 * code points), D (one of
``#$%&*|``) and E (its text stands under a smaller id). A to D are properties of the text. E is found by sorting: rows are
dealt by ranges of fingerprint and id, sorted by fingerprint, full text and id, and each is compared with the row before it
(``marked``). The rows of one text need not end up in one partition, however many they are; what a partition can't know of its
first fingerprint, the ends of the partitions before it tell: one row per partition and text at its border, at most a few times
the number of partitions, and only these are broadcast (``failures``).

What five filters do in any order follows from how many rows fail which set of them. So the rows of a part are reduced to one
counter for each of the 32 sets before anything is shuffled, and the 120 orders are laid over the counters (``audit``).

Contract: null text is empty text, empty texts are equal to each other; words are maximal runs of characters other than ASCII
white space, by case. Rows that repeat an id and text fail E if a smaller id has the text, not by each other; a null id is
smaller than none and fails E if the text stands under any id. Null lang and '' are one part. Repeated labels of an id count
once, a 1 before others. Extra columns of any name are ignored. No documents, no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, parallelism, slices, staged
from .words import coded, runs, text_bytes

FILTERS = "ABCDE"
MIN_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
_NO_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_SYMBOL = np.array([b in SYMBOLS for b in range(256)])
_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])  # not a continuation byte


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def text_failures(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3 for A to D of every text."""
    raw, offsets = text_bytes(texts)
    mask, starts, ends = runs(raw, offsets, _NO_SPACE)
    vocabulary, ids = coded(raw, mask, starts, ends)
    n = np.diff(np.searchsorted(starts, offsets))
    pairs = np.unique(np.repeat(np.arange(len(texts)), n) * (len(vocabulary) + 1) + ids)
    distinct = np.bincount(pairs // (len(vocabulary) + 1), minlength=len(texts))
    failed = [n < MIN_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * _sums(_CAPITAL[raw], offsets) > MOST_CAPITALS * _sums(_POINT[raw], offsets), _sums(_SYMBOL[raw], offsets) > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted by fingerprint, text and id (nulls behind): which repeat a text of a smaller id."""
    claim("filter_audit")
    first_fp, last_fp, text, least = None, None, None, None  # of the partition, of the row before, of the run of its text
    open_run: list[dict] = []  # what stands behind the last fingerprint so far
    names = ["doc_id", "part", "failed", "fp", "digest", "border"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    for whole in batches:
        for batch in slices(iter([whole])):
            failed, n = text_failures(batch["text"]), len(batch)
            fps, texts, ids = batch["fp"].to_pylist(), batch["text"], batch["doc_id"].to_pylist()
            digests = [None] * n
            for k in range(n):
                own = None  # the text is made a Python string only where fingerprints are equal or a border begins
                if fps[k] != last_fp:
                    if first_fp is None:
                        first_fp = fps[k]
                    text, least, last_fp, open_run = texts[k].as_py(), ids[k], fps[k], []
                    open_run.append({"text": text, "least": least})
                else:
                    own = texts[k].as_py()
                    if own == text:
                        if least is not None and (ids[k] is None or ids[k] > least):
                            failed[k] |= 16
                    else:
                        text, least = own, ids[k]
                        open_run.append({"text": text, "least": least})
                if fps[k] == first_fp:
                    digests[k] = digest(text)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array(failed, pa.int32()), batch["fp"], pa.array(digests, pa.binary()), pa.array(np.zeros(n, bool))], names)
    if open_run:
        rows = [[r["least"] for r in open_run], [None] * len(open_run), [0] * len(open_run), [last_fp] * len(open_run), [digest(r["text"]) for r in open_run], [True] * len(open_run)]
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names)


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per document (border false) with what is known in its partition, and a row per text of each partition's last fingerprint (border true); ``digest`` is set where another partition may know more."""
    d = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[part_col], F.lit("")).alias("part"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    d = d.withColumn("fp", F.xxhash64("text"))
    dealt = d.repartitionByRange(parallelism(docs.sparkSession), "fp", F.asc_nulls_last("doc_id")).sortWithinPartitions("fp", "text", F.asc_nulls_last("doc_id"))
    return dealt.mapInArrow(_marks, "doc_id bigint, part string, failed int, fp bigint, digest binary, border boolean")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, failed): the set of failed filters as bits, A the lowest."""
    rows = staged(marked(docs, id_col, text_col, part_col), "audit-marks")
    ends = rows.where("border").groupBy("fp", "digest").agg(F.min("doc_id").alias("least")).where("least is not null")
    ends = F.broadcast(ends.select(F.col("fp").alias("f"), F.col("digest").alias("d"), "least"))  # one row per partition, more only where fingerprints collide
    known = rows.where("not border").join(ends, (F.col("fp") == F.col("f")) & (F.col("digest") == F.col("d")), "left")
    again = F.coalesce(F.col("least") < F.col("doc_id"), F.col("least").isNotNull() & F.col("doc_id").isNull())
    return known.select("doc_id", "part", F.when(again, F.col("failed").bitwiseOR(F.lit(16))).otherwise(F.col("failed")).alias("failed"))


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): how many rows of a part fail exactly this set; all that the audit needs, and additive."""
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int").alias(c)
    marks = labels.select(labels["doc_id"], labels["quality"], labels["toxic"]).where("doc_id is not null").groupBy("doc_id").agg(yes("quality"), yes("toxic"))
    return failed.join(marks, "doc_id", "left").groupBy("part", "failed").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """Every order of the filters over the counters: 600 rows per part."""
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    steps = counts.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = [F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {k}, 1)) - 1)") for k in range(1, len(FILTERS) + 1)]
    before, own = F.lit(0), F.lit(0)
    for k, b in enumerate(bits, 1):
        before = before + F.when(F.col("step") > k, b).otherwise(0)
        own = own + F.when(F.col("step") == k, b).otherwise(0)
    x = steps.select("*", own.alias("own"), F.col("failed").bitwiseAND(before).alias("earlier")).withColumn("fails", F.col("failed").bitwiseAND(F.col("own")) > 0)
    here = F.col("fails") & (F.col("earlier") == 0)
    total = lambda of, when: F.sum(F.when(when, F.col(of)).otherwise(0))
    # over all orders a row goes by each of the filters that it fails equally often
    share = F.when(F.col("fails"), F.col("n") * (len(orders) / F.greatest(F.bit_count("failed"), F.lit(1))).cast("bigint")).otherwise(0)
    return x.groupBy("part", "filter_order", "step").agg(
        total("n", ~F.col("fails") & (F.col("earlier") == 0)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", F.col("fails") & (F.col("earlier") > 0)).alias("redundant"),
        total("n", F.col("failed") == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.sum(share).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(counters(failures(docs), labels))
