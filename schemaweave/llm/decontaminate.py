"""Benchmark decontamination by suffix arrays over the training documents.

The documents' words are coded and put into shards of a few megabytes, a separator behind each document; every shard holds the
order of its suffixes (``suffix_shards``). It is made by sorting packed groups of words and then by prefix doubling, where only
suffixes that still tie go on. ``depth`` words decide the order, and the longest test item has no more, so that every match of a
test suffix is found. Every suffix of every test item is then searched in every shard by bisection, all of them at once: the
neighbours of the place where it belongs give its longest verbatim match and a location, and the interval of the suffixes
that begin with a window of it gives all places of that window (``search``). Affected documents go (``decontaminated``).

A window is WINDOW consecutive words of an item; an item with fewer words, but not none, is one window. Matches don't cross
documents. The test items are a query set: they are read in blocks of BLOCK bytes, each block one broadcast of that bounded size,
and every task holds its shards against one block after the other. Nothing is shuffled but the removal's join. A task holds one
shard (SHARD bytes of text, or the WORDS words of a piece of a longer document) and its arrays, some twenty times the text.

Contract: null text is empty text and has no words; such rows stay and are clean. Rows stay one for one; rows that repeat an
id or a text, and null ids, are rows like others. Items that repeat an id count as one item; what an item without an id says is
searched for like any other, but names no item. No items: nothing is contaminated. Extra columns of any name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import words as W
from .common import claim, id_text, slices

WINDOW, SHARD, WORDS, BLOCK = 10, 4 << 20, 1 << 20, 8 << 20


def suffix_order(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The positions of the words of ``ids`` (0 is a separator) by the ``depth`` words from there on; ``left``: words up to the separator."""
    sa = np.flatnonzero(ids).astype(np.int64)
    bits = 21 if not len(ids) or ids.max() < 1 << 21 else 31
    h = 63 // bits
    padded = np.concatenate([ids.astype(np.int64), np.zeros(h, np.int64)])
    key = padded[sa]
    for k in range(1, h):
        key = key << bits | padded[sa + k]
    o = np.argsort(key)
    sa, key = sa[o], key[o]
    new = np.ones(len(sa) + 1, bool)
    new[1:-1] = key[1:] != key[:-1]
    rank = np.full(len(ids) + 1, -1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new[:-1], np.arange(len(sa)), 0))
    tied = np.flatnonzero(~(new[:-1] & new[1:]))
    while h < depth and len(tied):
        tied = tied[left[sa[tied]] >= h]  # those that share their separator tie for good
        at = sa[tied]
        group = rank[at]
        key = group * (len(ids) + 1) + rank[np.minimum(at + h, len(ids))] + 1
        o = np.argsort(key)
        sa[tied], key, group = at[o], key[o], group[o]
        head = np.ones(len(tied) + 1, bool)
        head[1:-1] = key[1:] != key[:-1]
        rank[sa[tied]] = np.maximum.accumulate(np.where(head[:-1], tied, 0))
        tied = tied[~(head[:-1] & head[1:])]
        h *= 2
    return sa.astype(np.int32)


def _pieces(w: W.Words, depth: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(first text, last text + 1, first word, last word + 1, more): texts together up to WORDS words; a longer one in pieces that overlap by ``depth`` words."""
    starts, i = w.starts(), 0
    while i < len(w.counts):
        if w.counts[i] > WORDS:
            for at in range(0, int(w.counts[i]), WORDS):
                stop = min(at + WORDS + depth, int(w.counts[i]))
                more = at + WORDS < w.counts[i]
                yield i, i + 1, int(starts[i]) + at, int(starts[i]) + stop, more
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + WORDS, "right")) - 1)
        yield i, j, int(starts[i]), int(starts[j]), False
        i = j


def _shards(batches: Iterator[pa.RecordBatch], depth: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    claim("decontaminate")
    for batch in batches:
        for part in slices(iter([batch]), SHARD):
            w = W.words(part["text"])
            for i, j, a, b, more in _pieces(w, depth):
                counts = w.counts[i:j] if j - i > 1 else np.array([b - a])
                ends = np.cumsum(counts + 1) - 1  # of the separators
                ids = np.zeros(int(counts.sum()) + len(counts), np.int32)
                of_word = np.ones(len(ids), bool)
                of_word[ends] = False
                used, codes = np.unique(w.ids[a:b], return_inverse=True)
                ids[of_word] = codes + 1
                left = np.repeat(ends, counts + 1) - np.arange(len(ids))
                order = suffix_order(ids, left, depth)
                columns = [part["doc_id"].slice(i, j - i), counts, w.vocabulary.take(pa.array(used)).cast(pa.binary()), ids.tobytes(), order.tobytes(), more]
                rows = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) if k < 3 else pa.array([c]) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([r.cast(f.type) for r, f in zip(rows, schema, strict=True)], schema=schema)


def suffix_shards(docs: DataFrame, depth: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards (doc_ids, counts, vocabulary, ids, suffixes, more): a table that can be written and searched again."""
    d = id_text(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_ids array<{kind}>, counts array<bigint>, vocabulary array<binary>, ids binary, suffixes binary, more boolean"
    id_type = to_arrow_type(d.schema["doc_id"].dataType)
    schema = pa.schema([("doc_ids", pa.list_(id_type)), ("counts", pa.list_(pa.int64())), ("vocabulary", pa.list_(pa.binary())), ("ids", pa.binary()), ("suffixes", pa.binary()), ("more", pa.bool_())])
    return d.mapInArrow(lambda batches: _shards(batches, depth, schema), ddl)


class Tests:
    """A block of test items: their coded words, every suffix, and the windows with the items that hold them."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW):
        w = W.words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary, starts = w.vocabulary.cast(pa.binary()), w.starts()
        # a word that no shard has stands behind every item
        self.words = np.full(len(w.ids) + len(items), -1, np.int64)
        ends = np.cumsum(w.counts + 1) - 1
        of_word = np.ones(len(self.words), bool)
        of_word[ends] = False
        self.words[of_word] = w.ids
        self.suffixes = np.flatnonzero(of_word)
        self.item = np.repeat(np.arange(len(items)), w.counts)
        self.offset = np.arange(len(w.ids)) - starts[self.item]
        self.ids = [i for i, _ in items]
        windows: dict[tuple, int] = {}
        self.first, self.length, self.holders = [], [], []  # of every distinct window: a suffix, its words, its items
        for i, n in enumerate(w.counts):
            size = min(window, int(n))
            for p in range(int(n) - size + 1) if n else ():
                s = int(starts[i]) + p
                k = windows.setdefault(tuple(w.ids[s : s + size]), len(windows))
                if k == len(self.first):
                    self.first.append(s)
                    self.length.append(size)
                    self.holders.append(set())
                if self.ids[i] is not None:
                    self.holders[k].add(self.ids[i])


def longest_item(items: DataFrame, text_col: str = "text") -> int:
    """The words of the longest item: how deep the suffixes must be sorted."""
    counted = items.select(F.coalesce(items[text_col], F.lit("")).alias("text")).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array(W.counted(b["text"]), pa.int64())], ["n"]) for b in bs), "n bigint")
    return counted.agg(F.max("n")).first()[0] or 0


def test_blocks(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> list:
    """Broadcasts of ``Tests``, each of BLOCK bytes of text at most or one item; the driver holds one at a time."""
    sc, out, block, size = items.sparkSession.sparkContext, [], [], 0
    for r in items.select(items[id_col].alias("i"), F.coalesce(items[text_col], F.lit("")).alias("t")).toLocalIterator():
        if block and size + len(r.t) > BLOCK:
            out.append(sc.broadcast(Tests(block, window)))
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    return [*out, sc.broadcast(Tests(block, window))] if block else out


class Shard:
    """A row of ``suffix_shards`` ready to be searched."""

    def __init__(self, vocabulary: pa.Array, ids: bytes, suffixes: bytes):
        self.vocabulary = vocabulary
        self.ids = np.frombuffer(ids, np.int32)
        self.padded = np.concatenate([self.ids, np.zeros(8, np.int32)])
        self.sa = np.frombuffer(suffixes, np.int32)

    def common(self, at: np.ndarray, q: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Shared words of the suffixes ``at`` and the test suffixes ``j``, up to ``most``; q has eight words more than it needs."""
        out, go, step = np.zeros(len(at), np.int64), np.arange(len(at)), np.arange(8)
        while len(go):
            a, b = at[go] + out[go], j[go] + out[go]
            same = self.padded[np.minimum(a, len(self.ids))[:, None] + step] == q[b[:, None] + step]
            n = np.where(same.all(1), 8, same.argmin(1))
            out[go] += n
            go = go[(n == 8) & (out[go] < most[go])]
        return np.minimum(out, most)

    def bound(self, q: np.ndarray, j: np.ndarray, most: np.ndarray, upper: bool) -> np.ndarray:
        """Where the first ``most`` words of each test suffix belong: before (or behind) all suffixes that begin with them."""
        lo, hi = np.zeros(len(j), np.int64), np.full(len(j), len(self.sa), np.int64)
        while True:
            go = np.flatnonzero(lo < hi)
            if not len(go):
                return lo
            mid = (lo[go] + hi[go]) >> 1
            at = self.sa[mid].astype(np.int64)
            n = self.common(at, q, j[go], most[go])
            whole = n == most[go]
            below = np.where(whole, upper, self.padded[at + n] < q[j[go] + n])
            lo[go] = np.where(below, mid + 1, lo[go])
            hi[go] = np.where(below, hi[go], mid)

    def search(self, t: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(longest match of every test suffix, a place of it, window of every occurrence, its place)."""
        code = np.append(pc.index_in(t.vocabulary, value_set=self.vocabulary).fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64) + 1, -1)
        q = np.concatenate([code[t.words], np.full(8, -1, np.int64)])
        unknown = np.flatnonzero(q < 0)
        j = t.suffixes
        most = unknown[np.searchsorted(unknown, j)] - j  # words up to one that the shard hasn't
        length, place = np.zeros(len(j), np.int64), np.full(len(j), -1, np.int64)
        go = np.flatnonzero(most > 0)
        if len(go) and len(self.sa):
            here = self.bound(q, j[go], most[go], False)
            for beside in (here - 1, here):
                ok = np.flatnonzero((beside >= 0) & (beside < len(self.sa)))
                at = self.sa[beside[ok]].astype(np.int64)
                n = self.common(at, q, j[go[ok]], most[go[ok]])
                better = n > length[go[ok]]
                length[go[ok[better]]], place[go[ok[better]]] = n[better], at[better]
        first, size = np.array(t.first, np.int64), np.array(t.length, np.int64)
        hit = np.flatnonzero(length[first] >= size) if len(first) else first
        if not len(hit):
            return length, place, hit, hit
        lo, hi = (self.bound(q, j[first[hit]], size[hit], up) for up in (False, True))
        n = hi - lo
        where = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        return length, place, np.repeat(hit, n), self.sa[where].astype(np.int64)


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, Shard, bool]]:
    claim("decontaminate")
    for batch in batches:
        for k in range(len(batch)):
            x = {f: batch[f][k] for f in ("doc_ids", "counts", "vocabulary", "ids", "suffixes", "more")}
            yield x["doc_ids"].values, x["counts"].values.to_numpy(zero_copy_only=False), Shard(x["vocabulary"].values, x["ids"].as_py(), x["suffixes"].as_py()), x["more"].as_py()


def _found(batches: Iterator[pa.RecordBatch], blocks: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per document; the pieces of a long one come one after the other and are joined here."""
    mask, items, longest, base = np.zeros(0, bool), set(), 0, 0  # of a document that isn't complete yet
    for doc_ids, counts, shard, more in _loaded(batches):
        edge, hits, best, held = np.zeros(len(shard.ids) + 1, np.int64), [], np.zeros(len(counts), np.int64), {}
        starts = np.concatenate([[0], np.cumsum(counts + 1)])
        for block in blocks:
            t = block.value
            length, place, window, at = shard.search(t)
            some = np.flatnonzero(length)
            np.maximum.at(best, np.searchsorted(starts, place[some], "right") - 1, length[some])
            size = np.array(t.length, np.int64)[window] if len(window) else window
            np.add.at(edge, at, 1)
            np.subtract.at(edge, at + size, 1)
            hits.append((np.searchsorted(starts, at, "right") - 1) * len(t.first) + window if len(at) else at)
            for pair in np.unique(hits[-1]):
                held.setdefault(int(pair) // len(t.first), set()).update(t.holders[int(pair) % len(t.first)])
        covered = np.cumsum(edge[:-1]) > 0
        if more or len(mask):  # one document
            own = covered[: int(counts[0])]
            wide = np.zeros(base + len(own), bool)
            wide[: len(mask)] = mask
            wide[base:] |= own
            mask, items, longest = wide, items | held.get(0, set()), max(longest, int(best[0]))
            if more:
                base += WORDS
                continue
            rows = [(len(mask), _spans(mask), sorted(items), longest)]
            mask, items, longest, base = np.zeros(0, bool), set(), 0, 0
        else:
            before = np.concatenate([[0], np.cumsum(covered)])
            any_hit = before[starts[1:]] - before[starts[:-1]] > 0
            rows = [(int(n), _spans(covered[starts[i] : starts[i] + n]) if any_hit[i] else [], sorted(held.get(i, ())), int(best[i])) for i, n in enumerate(counts)]
        columns = [doc_ids, *map(list, zip(*rows, strict=True))]
        yield pa.RecordBatch.from_arrays([c if k == 0 else pa.array(c, schema.field(k).type) for k, c in enumerate(columns)], schema=schema)


def search(shards: DataFrame, blocks: list) -> DataFrame:
    """Per document: doc_id, n_words, spans of words under a window of some test item, those items' ids, and ``longest``: the greatest longest match of a test suffix that lies in it as far as this shard's places say."""
    kind = shards.schema["doc_ids"].dataType.elementType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("item_ids", pa.list_(pa.int64())), ("longest", pa.int64())])
    return shards.mapInArrow(lambda batches: _found(batches, blocks, schema), f"doc_id {kind.simpleString()}, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, item_ids array<bigint>, longest bigint")


def _longest(batches: Iterator[pa.RecordBatch], blocks: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    base = 0
    for doc_ids, counts, shard, more in _loaded(batches):
        starts = np.concatenate([[0], np.cumsum(counts + 1)])
        for block in blocks:
            t = block.value
            length, place, _, _ = shard.search(t)
            some = np.flatnonzero(length)
            doc = np.searchsorted(starts, place[some], "right") - 1
            columns = [pa.array([t.ids[i] for i in t.item[some]], pa.int64()), t.offset[some], length[some], doc_ids.take(pa.array(doc)), place[some] - starts[doc] + base]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        base = base + WORDS if more else 0


def longest_matches(shards: DataFrame, blocks: list) -> DataFrame:
    """(item_id, item_word, n_words, doc_id, doc_word): the longest verbatim match of every test suffix and one place of it."""
    kind = shards.schema["doc_ids"].dataType.elementType
    schema = pa.schema([("item_id", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64()), ("doc_id", to_arrow_type(kind)), ("doc_word", pa.int64())])
    rows = shards.mapInArrow(lambda batches: _longest(batches, blocks, schema), f"item_id bigint, item_word bigint, n_words bigint, doc_id {kind.simpleString()}, doc_word bigint")
    return rows.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_word")).alias("m")).select("item_id", "item_word", (-F.col("m.n")).alias("n_words"), "m.doc_id", "m.doc_word")


def searched(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``search`` of freshly made shards; nothing is written in between."""
    return search(suffix_shards(docs, max(longest_item(items), window)), test_blocks(items, window))



def contamination_digests(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    found = searched(docs, items, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents without those that hold a window of a test item. What is held against the items is the text, so ids may repeat or be null."""
    key = lambda df: F.sha2(F.coalesce(df[text_col], F.lit("")), 256)
    keyed = docs.select(key(docs).alias("doc_id"), docs[text_col].alias("text"))
    bad = searched(keyed, items, window).where(F.size("spans") > 0).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, key(docs) == F.col("__bad"), "left_anti")
