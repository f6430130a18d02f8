"""Ranked lexical search: an inverted index of compressed posting blocks, searched by Block-Max WAND.

``build_index`` cuts the documents into shards of SHARD bytes of text, as they lie in the partitions. A shard has a row per term: its
postings (document number, occurrences) in blocks of BLOCK, as variable-length gaps, and for each block its last document,
its greatest impact and where its bytes begin; and a row with the documents' ids and lengths under the term ''. What is not asked
for stays in the table, and no posting is shuffled to be indexed, so a frequent term has a short list in every shard.

``search`` takes the rows of the asked terms shard by shard. The blocks' last documents and maxima say, without a byte being
decompressed, what a document can score at most: between two block borders of an item's lists this bound stands still. The
pointers move shallowly from border to border to the next pivot, the first stretch whose bound reaches the threshold; only its
blocks are decompressed and its documents scored; then the threshold is the item's tenth best score so far, which a task carries
on to its next shard. Stretches below it are skipped. A bound equal to the threshold isn't skipped, as a smaller id may win a tie. Ten
rows per item and task are ranked at the end.

The items are a query set: their terms go to all tasks in blocks of QUERIES bytes of text, one search after the other. A task
holds one shard's text while indexing, and one shard's lists of the asked terms while searching, at most CACHE postings decompressed.

Contract: null text has no terms and isn't counted or found; a term counts once per item; rows of one item_id are one item
(those without an id too), and items without terms give no row. Rows that repeat a doc_id are documents of their own; equal scores go
by id, null ids last. Documents with score 0 are no result. Extra columns of any name are ignored. Sums are 64-bit integers:
90 * (a document's terms) * (documents) must stay below 2^63.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import claim, id_text, parallelism, slices, staged

BLOCK, SHARD, QUERIES, CACHE, K = 128, 8 << 20, 1 << 20, 2 << 20, 10
INDEX = "shard bigint, term string, df bigint, blocks binary, postings binary"
SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("blocks", pa.binary()), ("postings", pa.binary())])


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value's bytes begin and the last ones end): seven bits a byte, the highest bit set on all but the last."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= np.uint64(1) << np.uint64(7 * k)).astype(np.int64) for k in range(1, 10))
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begin[-1], np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        some = np.flatnonzero(size > k)
        out[begin[some] + k] = (v[some] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out, begin


def unpacked(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    end = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], end[:-1] + 1])
    shift = 7 * (np.arange(len(data)) - np.repeat(begin, end - begin + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, begin)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What one unit of a term's weight adds to a document's score."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // terms))


def _binary(data: bytes, begin: np.ndarray) -> pa.Array:
    """One value per stretch of ``data``."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data)])


def _shard(number: int, vocabulary: pa.Array, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, ids: pa.Array, n: np.ndarray, documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard; documents are numbered by their place in ``ids``."""
    own = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), n.astype(np.int64).tobytes() + ids.is_null().to_numpy(zero_copy_only=False).tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, "", len(n), *own), SCHEMA.types, strict=True)], schema=SCHEMA)
    if not len(term):
        return
    o = np.argsort(term.astype(np.int64) * len(n) + doc)
    term, doc, tf = term[o], doc[o], tf[o]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))  # of every term
    df = np.diff(np.concatenate([first, [len(term)]]))
    within = np.arange(len(term)) - np.repeat(first, df)
    head = np.flatnonzero(within % BLOCK == 0)  # of every block
    last = np.concatenate([head[1:], [len(term)]]) - 1
    before = np.concatenate([[-1], doc[:-1]])
    before[first] = -1
    both = np.empty(2 * len(term), np.int64)
    both[::2], both[1::2] = doc - before - 1, tf
    data, begin = packed(both)
    best = np.maximum.reduceat(impacts(tf, n[doc], documents, terms), head)
    of_term = np.searchsorted(head, first)  # every term's first block
    start = begin[2 * head]
    blocks = np.stack([doc[last], best, start - np.repeat(begin[2 * first], np.diff(np.concatenate([of_term, [len(head)]])))], axis=1).astype(np.int32)
    edges, cuts = np.concatenate([begin[2 * first], [len(data)]]), np.concatenate([of_term, [len(head)]]) * 12
    flat, names = blocks.reshape(-1).view(np.uint8), vocabulary.cast(pa.string())
    for k in range(0, len(first), 10_000):  # rows
        stop = min(k + 10_000, len(first))
        b, p = cuts[k : stop + 1], edges[k : stop + 1]
        columns = [pa.array(np.full(stop - k, number)), names.take(pa.array(term[first[k:stop]])), pa.array(df[k:stop]), _binary(flat[b[0] : b[-1]].tobytes(), b - b[0]), _binary(data[p[0] : p[-1]].tobytes(), p - p[0])]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, SCHEMA.types, strict=True)], schema=SCHEMA)


def _indexed(batches: Iterator[pa.RecordBatch], documents: int, terms: int, most: int) -> Iterator[pa.RecordBatch]:
    claim("ranked_search")
    number = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
    held: list[tuple] = []  # of the shard so far, by slice
    size = docs = vocabulary = 0

    def rows() -> Iterator[pa.RecordBatch]:
        vocabularies, term, doc, tf, ids, n = zip(*held, strict=True)
        joined = pa.concat_arrays(vocabularies).dictionary_encode()
        order = pc.sort_indices(joined.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        code = place[joined.indices.to_numpy()] if len(order) else np.zeros(0, np.int64)
        return _shard(number, joined.dictionary.take(order), code[np.concatenate(term)], np.concatenate(doc), np.concatenate(tf), pa.concat_arrays(ids), np.concatenate(n), documents, terms)

    for batch in batches:
        for part in slices(iter([batch])):
            w = W.words(part["text"])
            key, tf = np.unique(np.repeat(np.arange(len(part)), w.counts) * max(1, len(w.vocabulary)) + w.ids, return_counts=True)
            term, doc = key % max(1, len(w.vocabulary)), key // max(1, len(w.vocabulary))
            held.append((w.vocabulary.cast(pa.binary()), term + vocabulary, doc + docs, tf, part["doc_id"].cast(pa.int64()), w.counts))
            size, docs, vocabulary = size + part["text"].nbytes, docs + len(part), vocabulary + len(w.vocabulary)
            if size >= most:
                yield from rows()
                held, size, docs, vocabulary, number = [], 0, 0, 0, number + 1
    if held:
        yield from rows()


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    counted = docs.select(docs[text_col].alias("text")).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array(W.counted(part["text"]), pa.int64())], ["n"]) for b in bs for part in slices(iter([b]))), "n bigint")
    r = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return r.documents, r.terms


def build_index(docs: DataFrame, documents: int, terms: int, id_col: str = "doc_id", text_col: str = "text", most: int = SHARD) -> DataFrame:
    """INDEX rows; ``documents`` and ``terms`` are the totals that the impacts need. Write the rows before searching them."""
    return id_text(docs, id_col, text_col).mapInArrow(lambda batches: _indexed(batches, documents, terms, most), INDEX)


class Lists:
    """The lists of a shard's asked terms, decompressed block by block when they are needed."""

    def __init__(self, ids: bytes, lengths: bytes, documents: int, terms: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.n = np.frombuffer(lengths[: 8 * len(self.ids)], np.int64)
        self.null = np.frombuffer(lengths[8 * len(self.ids) :], bool)
        self.totals = documents, terms
        self.blocks: dict[str, np.ndarray] = {}
        self.data: dict[str, np.ndarray] = {}
        self.open: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        self.opened = self.kept = 0

    def add(self, term: str, blocks: bytes, postings: bytes) -> None:
        self.blocks[term] = np.frombuffer(blocks, np.int32).reshape(-1, 3).astype(np.int64)
        self.data[term] = np.frombuffer(postings, np.uint8)

    def block(self, term: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block."""
        if (term, k) not in self.open:
            b = self.blocks[term]
            both = unpacked(self.data[term][b[k, 2] : b[k + 1, 2] if k + 1 < len(b) else None])
            doc = np.cumsum(both[::2] + 1) + (b[k - 1, 0] if k else -1)
            self.opened += 1
            self.kept += len(doc)
            if self.kept > CACHE:
                self.open, self.kept = {}, len(doc)
            self.open[term, k] = doc, impacts(both[1::2], self.n[doc], *self.totals)
        return self.open[term, k]


class Top:
    """The K best (score, id) of an item; nulls are the largest ids."""

    def __init__(self, k: int = K):
        self.k, self.rows = k, []

    @property
    def threshold(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if len(scores) > self.k:  # all that may still be among the first
            some = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            scores, ids, null = scores[some], ids[some], null[some]
        rows = self.rows + list(zip(scores.tolist(), null.tolist(), ids.tolist(), strict=True))
        self.rows = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[: self.k]


def block_max_wand(lists: Lists, weights: dict[str, int], top: Top) -> None:
    """The documents of a shard against one item's terms and weights."""
    terms = [t for t in weights if t in lists.blocks and weights[t] > 0]
    if not terms:
        return
    size = [len(lists.blocks[t]) for t in terms]
    stop = np.concatenate([lists.blocks[t][:, 0] for t in terms]) + 1  # every block reaches from the end of the one before
    start = np.concatenate([[0], stop[:-1]])
    start[np.cumsum([0, *size[:-1]])] = 0
    best = np.concatenate([lists.blocks[t][:, 1] * weights[t] for t in terms])
    owner = np.repeat(np.arange(len(terms)), size)
    number = np.arange(len(owner)) - np.repeat(np.cumsum([0, *size[:-1]]), size)
    border = np.unique(np.concatenate([start, stop]))
    change = np.zeros(len(border), np.int64)
    np.add.at(change, np.searchsorted(border, start), best)
    np.subtract.at(change, np.searchsorted(border, stop), best)
    bound = np.cumsum(change)[:-1]  # of the documents from one border to the next
    k, reach = 0, BLOCK
    while k < len(bound):
        ahead = bound[k:] >= top.threshold
        pivot = k + int(ahead.argmax())
        if not bound[pivot] >= top.threshold:
            return  # nothing behind can get in
        below = np.flatnonzero(~ahead[pivot - k :])
        k = pivot + int(below[0]) if len(below) else len(bound)
        k = max(pivot + 1, min(k, int(np.searchsorted(border, border[pivot] + reach))))  # not too far: the threshold may rise
        reach = min(2 * reach, 8 * BLOCK)
        a, b = border[pivot], border[min(k, len(border) - 1)]
        score = np.zeros(b - a, np.int64)
        for x in np.flatnonzero((start < b) & (stop > a)):
            t = terms[owner[x]]
            doc, impact = lists.block(t, int(number[x]))
            i, j = np.searchsorted(doc, [a, b])
            score[doc[i:j] - a] += weights[t] * impact[i:j]
        good = np.flatnonzero(score >= top.threshold)
        if len(good):
            top.add(score[good], lists.ids[a + good], lists.null[a + good])


def _search(batches: Iterator[pa.RecordBatch], held, documents: int, terms: int, k: int) -> Iterator[pa.RecordBatch]:
    claim("ranked_search")
    items = held.value
    tops = [Top(k) for _ in items]
    lists, shard = None, None

    def run() -> None:
        for (_, weights), top in zip(items, tops, strict=True):
            block_max_wand(lists, weights, top)

    for batch in batches:
        for r in batch.to_pylist():
            if r["shard"] != shard:
                if lists:
                    run()
                lists, shard = Lists(r["blocks"], r["postings"], documents, terms), r["shard"]  # the documents' row comes first
            else:
                lists.add(r["term"], r["blocks"], r["postings"])
    if lists:
        run()
    rows = [(item, None if null else i, score) for (item, _), top in zip(items, tops, strict=True) for score, null, i in top.rows]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["item_id", "doc_id", "score"])


def item_blocks(items: DataFrame, most: int = QUERIES, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int | None, list[str]]]]:
    """(item_id, distinct terms), in blocks of about ``most`` bytes of text; the rows of an item stay together."""
    joined = items.groupBy(items[id_col].alias("i")).agg(F.array_join(F.array_distinct(F.collect_list(F.coalesce(items[text_col], F.lit("")))), "\n").alias("t"))
    block, size = [], 0
    for r in joined.toLocalIterator():
        w = W.words(pa.array([r.t], pa.string()))
        if block and size + len(r.t) > most:
            yield block
            block, size = [], 0
        block.append((r.i, [x.decode() for x in w.vocabulary.to_pylist()]))
        size += len(r.t)
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, documents: int, terms: int, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) of every item's ``k`` best documents; index: written INDEX rows."""
    spark, found = index.sparkSession, None
    for block in item_blocks(items):
        asked = sorted({t for _, ts in block for t in ts})
        # as many rows as a block has terms, whatever the number of documents
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in ["", *asked]], "asked string"))
        mine = index.join(wanted, F.col("term") == F.col("asked"), "left_semi")
        df = {r.term: r.df for r in mine.where("term <> ''").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
        held = spark.sparkContext.broadcast([(i, {t: weight[t] for t in ts if t in weight}) for i, ts in block])
        dealt = mine.repartition(parallelism(spark), "shard").sortWithinPartitions("shard", "term")
        rows = dealt.mapInArrow(lambda batches, held=held: _search(batches, held, documents, terms, k), "item_id bigint, doc_id bigint, score bigint")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Index and search in one go; the index lies in the shared folder until the scratch tables are released."""
    documents, terms = totals(docs)
    return search(staged(build_index(docs, documents, terms), "search-index"), items, documents, terms, k)
