"""Token-ID files under a canonical, length-limited Huffman code.

Format: a folder with ``segments`` (Parquet rows, one per independent block) and ``code`` (Parquet rows: id, length; canonical
codes follow from the lengths). Nothing else is needed to read it. A block holds whole documents in ascending doc_id order:

* ``doc_ids``, ``doc_tokens``: the documents of the block and how many ids each has, the end id included;
* ``payload``: big-endian bit stream of the ids' codes; ``checkpoints``: the bit offset of every EVERY-th id, so that a
  reader can begin at any checkpoint and decode all intervals side by side with one table look-up per id;
* ``part``, ``segment``, ``block``: place in the file order.

How it is built: texts are dealt to ranges of doc_id and tokenised there once (scratch table); the tasks' counts of ids are summed
by id (one row per id reaches the driver: bounded by the vocabulary); package-merge gives code lengths of at most LIMIT
bits; every range is then coded where it lies, without a further shuffle.

Contract: null text is empty text (just the end id); strings of special tokens in a text give their ids, as the library has it (such texts are encoded whole by it); repeated doc_ids stay separate rows, ordered by id, then by their
text, and a hot id is dealt to several ranges by how its texts begin; null doc_ids come first; an empty table gives empty files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pretok
from .common import CLEAR, claim, id_text, new_path, parallelism, slices, staged

LIMIT, EVERY, BLOCK = 16, 128, 1 << 16
CACHE, BLOCK_CHARS = 1_200_000, 1 << 20


def _byte_level() -> dict[int, str]:
    """The character that spells each byte in a byte-level vocabulary: printable ones spell themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LEVEL = _byte_level()


def _found(index: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """The numbers of ``words``, -1 for those that ``index`` lacks."""
    return np.fromiter(map(index.get, words, itertools.repeat(-1)), np.int64, len(words))


class PieceIds:
    """Ids of pieces by the tokenizers library; distinct pieces are encoded once per worker until the cache is full."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.old: tuple = {}, None, None
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)  # a piece's ids end where the next one's begin

    def remember(self, words: list[bytes]) -> list[bytes]:
        """Take over what the older half of the cache knows; the rest comes back."""
        index, flat, ends = self.old
        at = _found(index, words)
        own = at[at >= 0]
        if len(own):
            begin = np.where(own > 0, ends[own - 1], 0)
            size = ends[own] - begin
            self.append([words[i] for i in np.flatnonzero(at >= 0).tolist()], size, flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))])
        return [words[i] for i in np.flatnonzero(at < 0).tolist()]

    def append(self, words: list[bytes], sizes: np.ndarray, added: np.ndarray) -> None:
        n = len(self.index)
        begin = int(self.ends[n - 1]) if n else 0
        while begin + len(added) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[begin : begin + len(added)] = added
        self.ends[n : n + len(words)] = begin + np.cumsum(sizes)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def learn(self, new: list[bytes]) -> None:
        """Take in pieces that the index lacks. They are split already, so the library's model gets each as the byte level spells it, without the work on offsets that its encodings need."""
        tokens = self.tokenizer.model.tokenize
        found = [[t.id for t in tokens(w.decode("latin-1").translate(BYTE_LEVEL))] for w in new]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.append(new, sizes, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())))

    def ids(self, words: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the distinct ``words`` at ``places`` in turn, and how many each place has."""
        if not len(places):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        own = _found(self.index, words)
        gaps = np.flatnonzero(own < 0)
        if len(self.index) + len(gaps) > CACHE // 2 and self.index:
            self.old = self.index, self.flat, self.ends
            self.clear()
            gaps = np.arange(len(words))
        if len(gaps):
            new = [words[i] for i in gaps.tolist()]
            self.learn(self.remember(new))
            own[gaps] = _found(self.index, new)
        end = self.ends[own]
        begin = np.where(own > 0, self.ends[own - 1], 0)
        size = (end - begin)[places]
        return self.flat[np.repeat(begin[places] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size


@functools.cache
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


CLEAR["token-ids"] = piece_ids.cache_clear


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, counted: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, the end id last), narrow over ``docs`` (doc_id, text).

    ``counted``: with ``seen`` and ``times``, null in these rows; each task adds one row that has only them, how often it met each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token-ids")
        p = piece_ids(tokenizer_path)
        end, total, kind = np.array([end_id], np.uint32), np.zeros(1, np.int64), None
        for batch in slices(batches):
            texts, kind = batch["text"].to_pylist(), batch["doc_id"].type
            whole = {i: np.array(p.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if any(x in t for x in p.special)}
            for first, last, words, places, ends in pretok.pieces(["" if i in whole else t for i, t in enumerate(texts)], BLOCK_CHARS):
                ids, sizes = p.ids(words, places)
                cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
                out = [np.concatenate([whole.get(first + n, ids[i:j]), end]).tobytes() for n, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]
                rows = [batch["doc_id"].slice(first, last - first), pa.array(out, pa.binary())]
                if counted:
                    total = _added(total, np.concatenate([ids, *(whole[i] for i in range(first, last) if i in whole), np.repeat(end, last - first)]))
                    rows += [pa.nulls(len(out), pa.list_(pa.int64()))] * 2
                yield pa.RecordBatch.from_arrays(rows, names)
        if counted and kind is not None:
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([met], pa.list_(pa.int64())), pa.array([total[met]], pa.list_(pa.int64()))], names)

    names = ["doc_id", "ids", "seen", "times"][: 4 if counted else 2]
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary" + ", seen array<long>, times array<long>" * counted)


def _added(total: np.ndarray, ids: np.ndarray) -> np.ndarray:
    got = np.bincount(ids, minlength=len(total))
    got[: len(total)] += total
    return got


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents, from the tasks' counts in ``encoded``: the ids themselves aren't read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token-counts")
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids, times in zip(batch["seen"], batch["times"], strict=True):
                ids = np.asarray(ids.values)
                total = np.pad(total, (0, max(0, int(ids[-1]) + 1 - len(total))))
                total[ids] += np.asarray(times.values)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    met = tokens.where("seen is not null").select("seen", "times").mapInArrow(run, "id long, n long")
    rows = met.groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; zero where an id doesn't occur."""
    if not counts:
        return np.zeros(1, np.uint8)
    ids = np.array(sorted(counts, key=lambda i: (counts[i], i)), np.int64)
    leaves = np.array([counts[i] for i in ids.tolist()], np.float64)
    n = len(ids)
    out = np.zeros(int(ids.max()) + 1, np.uint8)
    if n == 1:
        out[ids] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(n))))
    level, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        levels.append(order < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for leaf in reversed(levels):
        m = int(leaf[:take].sum())
        lengths[:m] += 1
        take = 2 * (take - m)
    out[ids] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every possible next ``width`` bits: the id they begin with and its length."""
    width = int(lengths.max())
    ids, sizes = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(1, width - lengths[order].astype(np.int64))
    total = int(spans.sum())
    ids[:total], sizes[:total] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, sizes, width


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids`` and the bit offset of every EVERY-th of them."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word = at >> 5
    shifted = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)  # at most 31 + LIMIT bits are in use
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    mine = word[first]
    out[mine] += np.add.reduceat(shifted >> np.uint64(32), first)
    out[mine + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), at[::EVERY]


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Decode ``n`` ids, all intervals between checkpoints side by side."""
    ids, sizes, width = table
    words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at, out = checkpoints.astype(np.int64).copy(), np.zeros((len(checkpoints), EVERY), np.uint32)
    mask, room = np.uint64((1 << width) - 1), 64 - width
    lanes = len(at)
    for k in range(min(EVERY, n)):
        if lanes == len(at) and (lanes - 1) * EVERY + k >= n:  # the last interval is shorter
            lanes -= 1
        own = at[:lanes]
        key = (pairs[own >> 5] >> (room - (own & 31)).astype(np.uint64)) & mask
        out[:lanes, k] = ids[key]
        at[:lanes] += sizes[key]
    return out.reshape(-1)[:n]


BLOCKS = "part int, segment string, block int, first_doc {kind}, n_tokens long, doc_ids array<{kind}>, doc_tokens array<long>, payload binary, checkpoints binary"


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> str:
    """Write the files to ``path``, or else to a scratch folder; returns the folder."""
    spark = docs.sparkSession
    docs = id_text(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = docs.repartitionByRange(parallelism(spark), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    tokens = staged(encoded(ranged, tokenizer_path, end_id, counted=True).withColumn("part", F.spark_partition_id()), "ids")
    lengths = code_lengths(id_counts(tokens), limit)
    tokens = tokens.where("seen is null").drop("seen", "times")
    codes = canonical_codes(lengths)
    arrow_id = tokens.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block ends when it has BLOCK ids or its range ends; a segment is what one task reads of one range."""
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        task, kind_of, state = TaskContext.get().partitionId(), to_arrow_type(arrow_id), {"part": None, "block": 0, "docs": [], "ids": [], "sizes": [], "n": 0}

        def flush() -> pa.RecordBatch:
            payload, marks = pack(np.concatenate(state["ids"]), codes, lengths)
            values = [state["part"], f"{state['part']}-{task}", state["block"], state["docs"][0], state["n"], state["docs"], state["sizes"], payload, marks.astype("<u4" if marks[-1] < 1 << 32 else "<u8").tobytes()]
            kinds = [pa.int32(), pa.string(), pa.int32(), kind_of, pa.int64(), pa.list_(kind_of), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            state.update(block=state["block"] + 1, docs=[], ids=[], sizes=[], n=0)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "segment", "block", "first_doc", "n_tokens", "doc_ids", "doc_tokens", "payload", "checkpoints"])

        for batch in slices(batches, column="ids"):
            for doc, raw, part in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), batch["part"].to_pylist(), strict=True):
                if state["docs"] and (part != state["part"] or state["n"] >= BLOCK):
                    yield flush()
                if part != state["part"]:
                    state.update(part=part, block=0)
                ids = np.frombuffer(raw, np.uint32)
                state["docs"].append(doc)
                state["ids"].append(ids)
                state["sizes"].append(len(ids))
                state["n"] += len(ids)
        if state["docs"]:
            yield flush()

    path = path or new_path(spark, "token-ids")
    used = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    tokens.mapInArrow(run, BLOCKS.format(kind=kind)).write.option("compression", "none").parquet(f"{path}/segments")
    return path


def stored_lengths(spark: SparkSession, path: str) -> np.ndarray:
    """Code lengths by id, as the folder has them: a row per id of the vocabulary at most."""
    rows = spark.read.parquet(f"{path}/code").collect()
    out = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        out[r["id"]] = r["length"]
    return out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from nothing but the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.parquet(f"{path}/segments")
    kind = blocks.schema["first_doc"].dataType
    table = decode_table(stored_lengths(spark, path))
    # A range's blocks are ordered by segment and block; ranges by part. One row per range reaches the driver.
    sums = blocks.groupBy("part", "segment").agg(F.min("first_doc").alias("first_doc"), F.sum("n_tokens").alias("n"))
    before, parts = 0, {}
    for r in sorted(sums.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        parts[r["part"]] = before
        before += r["n"]
    order = Window.partitionBy("part").orderBy(F.col("first_doc").asc_nulls_first(), F.length("segment"), "segment", "block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("part", "segment", "block", "first_doc", "n_tokens").withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).select("part", "segment", "block", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in slices(batches, column="payload"):
            docs, starts, sizes, crcs, home = [], [], [], [], []
            for r in batch.to_pylist():
                marks = np.frombuffer(r["checkpoints"], "<u4" if len(r["checkpoints"]) == 4 * (-(-r["n_tokens"] // EVERY)) else "<u8")
                ids, at = unpack(r["payload"], marks, r["n_tokens"], table), 0
                for doc, n in zip(r["doc_ids"], r["doc_tokens"], strict=True):
                    docs.append(doc)
                    starts.append(parts[r["part"]] + at)
                    sizes.append(n)
                    crcs.append(zlib.crc32(ids[at : at + n].astype("<u4").tobytes()))
                    at += n
                    home.append((r["part"], r["segment"], r["block"]))
            part, segment, block = zip(*home, strict=True) if home else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(segment, pa.string()), pa.array(block, pa.int32()), pa.array(docs, to_arrow_type(kind)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["part", "segment", "block", "doc_id", "start", "n_tokens", "ids_crc32"])

    own = blocks.select("part", "segment", "block", "n_tokens", "doc_ids", "doc_tokens", "payload", "checkpoints")
    decoded = own.mapInArrow(run, f"part int, segment string, block int, doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")
    return decoded.join(places, ["part", "segment", "block"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_id_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    return read_ids(docs.sparkSession, write_ids(docs, tokenizer_path, end_id))
