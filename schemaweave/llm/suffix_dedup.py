"""Removal of repeated passages: every byte covered by a LENGTH-byte string that also starts earlier in the corpus.

Sorting all suffixes of a corpus moves LENGTH bytes per byte of text; here only some suffixes meet, and none is missed:

1. Anchors. Of the K-byte strings in a window of LENGTH bytes the one with the least hash is the window's anchor. Equal
   windows have equal anchors, and neighbouring windows mostly share one, so an anchor stands for about 30 windows. A row
   (hash of the K bytes, hash of the bytes of all its windows, place) is shuffled by the first hash.
2. Classes. Anchors whose windows are equal throughout: all but the earliest are repeats. The earliest of each class need a
   closer look only where one K-byte string has several classes; they go back to their document and fetch their bytes.
3. Sorting. The bytes from the anchor on, and those before it read backwards, are sorted by deep-shallow sorting: multikey
   quicksort on 8-byte symbols to a shallow depth, then a blind trie for each group that is still equal there. The common
   prefixes of neighbours in both orders tell, for each of the windows, which of them are equal; the earliest stays. A window
   has SIDE bytes or more before its anchor or behind it, so anchors meet twice, by the bytes before and by those behind.
4. Intervals meet their documents and are merged.

Equal rows meet inside a batch before the shuffle, so a passage that a third of the corpus shares sends one row per batch.
Step 2 streams sorted rows with constant state; step 3 holds the distinct surroundings of one string of K + SIDE bytes at a time.

Contract: null text is empty text; documents are ordered by id (nulls first); rows that repeat an id with the same text are
one document and get the same result, with different texts they are documents in order of a hash of the text. Texts of
fewer than LENGTH bytes lose nothing and never match. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CLEAR, claim, id_text, parallelism, slices, staged

LENGTH, K = 100, 32
SIDE = (LENGTH - K) // 2  # a window has at least so many bytes before its anchor or behind it
BLOCK = 1 << 19
SHALLOW, SMALL = 72, 12
_BASE, _MIX, _POS, _ALL = 0x9E3779B97F4A7C15, np.uint64(0x94D049BB133111EB), np.uint64((1 << 21) - 1), (1 << 64) - 1


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse mod 2**64, and a random odd number per byte."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers, step = np.ones(1, np.uint64), base
        while len(powers) < 1 << 21:
            powers, step = np.concatenate([powers, powers * np.uint64(step)]), step * step % (1 << 64)
        out.append(powers)
    return out[0], out[1], np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


CLEAR["passages"] = _tables.cache_clear


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def anchors(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Of documents side by side in ``buf`` (``starts``: where each begins, and the end): anchor, first and last window, hash of the K bytes, hash of all the windows' bytes."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n, wide = len(buf), length - k + 1
    if n < length:
        return none
    powers, inverse, of_byte = _tables()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(of_byte[buf] * powers[:n], out=total[1:])
    h = _mix((total[k:] - total[:-k]) * inverse[: n - k + 1])
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost
    size = 1
    while size * 2 <= wide:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if wide > size:
        key = np.minimum(key[: len(key) - (wide - size)], key[wide - size :])
    end = np.repeat(starts[1:], np.diff(starts))[: len(key)]
    window = np.flatnonzero(np.arange(len(key)) + length <= end)
    if not len(window):
        return none
    at = (key[window] & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]))
    s0, s1, at = window[first], window[np.append(first[1:], len(window)) - 1], at[first]
    around = _mix((total[s1 + length] - total[s0]) * inverse[s0])
    around = _mix(around + (s1 - s0).astype(np.uint64) * np.uint64(1 << 21) + (at - s0).astype(np.uint64))
    return at, s0, s1, h[at], around


# ---- deep-shallow sorting


def _words(strings: list[bytes]) -> np.ndarray:
    """Strings as rows of 8-byte symbols, zeros behind the end."""
    width = -(-max(map(len, strings)) // 8)
    return np.frombuffer(b"".join([s.ljust(8 * width, b"\0") for s in strings]), ">u8").reshape(-1, width).astype(np.uint64)


def common(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class BlindTrie:
    """A trie that only knows the byte at which branches part; a string is compared with one other when it comes in."""

    def __init__(self):
        self.root = None  # a leaf [string, members] or a node (depth, {byte: child}), -1 where a string ends

    @staticmethod
    def _byte(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    def add(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = [s, [member]]
            return
        node = self.root
        while isinstance(node, tuple):
            children = node[1]
            node = children.get(self._byte(s, node[0])) or next(iter(children.values()))
        if node[0] == s:
            node[1].append(member)
            return
        depth = common(s, node[0])
        other = node[0]
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, node = node, node[1][self._byte(s, node[0])]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._byte(s, depth)] = [s, [member]]
            return
        fork = (depth, {self._byte(other, depth): node, self._byte(s, depth): [s, [member]]})
        if parent is None:
            self.root = fork
        else:
            parent[1][self._byte(s, parent[0])] = fork

    def members(self) -> Iterator[int]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield from node[1]


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> np.ndarray:
    """The order of the strings (an end sorts before every byte)."""
    n = len(strings)
    order = np.arange(n)
    if n < 2:
        return order
    words = _words(strings)
    deep = min(words.shape[1], shallow // 8)
    stack = [(0, n, 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2:
            continue
        part = order[low:high]
        if high - low <= SMALL:
            order[low:high] = sorted(part.tolist(), key=strings.__getitem__)
            continue
        if depth == deep:
            trie = BlindTrie()
            for i in part.tolist():
                trie.add(strings[i], i)
            order[low:high] = np.fromiter(trie.members(), np.int64, high - low)
            continue
        symbol = words[part, depth]
        pivot = np.sort(symbol[[0, len(symbol) // 2, -1]])[1]
        less, more = symbol < pivot, symbol > pivot
        same = ~(less | more)
        a, b = int(less.sum()), int(same.sum())
        order[low : low + a], order[low + a : low + a + b], order[low + a + b : high] = part[less], part[same], part[more]
        stack += [(low, low + a, depth), (low + a, low + a + b, depth + 1), (low + a + b, high, depth)]
    return order


def common_prefixes(strings: list[bytes], order: np.ndarray) -> np.ndarray:
    """Of each string in order with the one before it; 0 for the first."""
    words = _words(strings)[order]
    sizes = np.array([len(s) for s in strings])[order]
    out = np.zeros(len(order), np.int64)
    differ = words[1:] ^ words[:-1]
    some = differ != 0
    word = np.where(some.any(1), some.argmax(1), words.shape[1])
    x = differ[np.arange(len(differ)), np.minimum(word, words.shape[1] - 1)]
    zeros = np.zeros(len(x), np.int64)
    for bits in (32, 16, 8):  # leading zero bytes of the first symbols that differ
        clear = (x >> np.uint64(64 - bits)) == 0
        zeros += clear * (bits // 8)
        x = np.where(clear, x << np.uint64(bits), x)
    out[1:] = np.minimum(np.where(some.any(1), 8 * word + zeros, 8 * word), np.minimum(sizes[1:], sizes[:-1]))
    return out


def repeated_windows(group: np.ndarray, context: list[bytes], back: np.ndarray, count: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For anchors in order of their place, with ``context`` from their first window to the end of the last, ``back`` bytes of it before the anchor and ``count`` windows: which (row, bytes between window start and anchor) have an equal window in an earlier row of the same group."""
    n, wide = len(context), int(back.max()) + 1 if len(back) else 0
    tags = [int(g).to_bytes(4, "big") for g in group]
    out = np.zeros((n, wide), bool)
    runs = []
    for strings in ([t + c[b:] for t, c, b in zip(tags, context, back.tolist(), strict=True)], [t + c[:b][::-1] for t, c, b in zip(tags, context, back.tolist(), strict=True)]):
        order = deep_shallow(strings)
        runs.append((order, common_prefixes(strings, order) - 4))
    ids = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for d in range(wide):
        owner = np.flatnonzero((back >= d) & (back - count < d))
        if len(owner) < 2:
            continue
        for own, (order, prefix), least in zip(ids, runs, (length - d, d), strict=True):
            own[order] = np.cumsum(prefix < least)
        _, first = np.unique(ids[0][owner] * (n + 1) + ids[1][owner], return_index=True)
        hit = np.ones(len(owner), bool)
        hit[first] = False
        out[owner[hit], d] = True
    return out


# ---- the steps on Spark


def _hi(text: bytes) -> int:
    return zlib.crc32(text) & 0xFFFFF


def _ranks(docs: list, hi: list[int]) -> np.ndarray:
    """Places of the documents in their order; the same for rows that are one document."""
    keys = [(d is not None, d if d is not None else 0, x) for d, x in zip(docs, hi, strict=True)]
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    return np.array([place[k] for k in keys], np.int64)


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Equal, or both null."""
    import pyarrow.compute as pc

    return np.asarray(pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))))


_ANCHORS = ["h", "c", "doc_id", "place", "back", "count", "repeat"]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place: 20 bits of the text's hash over 40 bits of the first window's offset; repeat: an equal row was met earlier in this batch."""
    claim("passages")
    for batch in slices(batches, 16 * BLOCK):
        texts = [t.encode() for t in batch["text"].to_pylist()]
        hi = [_hi(t) for t in texts]
        found = []  # document, offset of the first window, back, count, h, c
        first, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > BLOCK:
                found += _blocks(texts, first, i)
                first, size = i, 0
            size += len(t)
        if size:
            found += _blocks(texts, first, len(texts))
        if not found:
            continue
        doc, offset, back, count, h, c = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(doc):  # no text is as long as a window
            continue
        place = np.array(hi, np.int64)[doc] << 40 | offset
        rank = _ranks(batch["doc_id"].to_pylist(), hi)[doc]
        order = np.lexsort((offset, rank, c, h))
        doc, place, back, count, h, c = (x[order] for x in (doc, place, back, count, h, c))
        rank, offset = rank[order], offset[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        twice = ~new & (rank == rank[first]) & (offset == offset[first])  # the same document once more
        again = ~new & ~twice
        dealt = np.where(again, _mix(h + place.view(np.uint64) * _MIX), h)  # repeats have met their like: they can go anywhere
        kinds = [pa.array(dealt.view(np.int64)), pa.array(c.view(np.int64)), batch["doc_id"].take(pa.array(doc)), pa.array(place), pa.array(back.astype(np.int16)), pa.array(count.astype(np.int16)), pa.array(again)]
        rows = pa.RecordBatch.from_arrays(kinds, _ANCHORS)
        yield rows.filter(pa.array(~twice)) if twice.any() else rows


def _blocks(texts: list[bytes], first: int, last: int) -> Iterator[tuple]:
    """Anchors of some documents; a document longer than a block goes through in blocks that overlap by a window less one byte."""
    if last - first > 1 or len(texts[first]) <= BLOCK:
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts[first:last]])])
        at, s0, s1, h, c = anchors(np.frombuffer(b"".join(texts[first:last]), np.uint8), starts)
        doc = np.searchsorted(starts, s0, "right") - 1
        yield doc + first, s0 - starts[doc], at - s0, s1 - s0 + 1, h, c
        return
    text = np.frombuffer(texts[first], np.uint8)
    for begin in range(0, max(1, len(text) - LENGTH + 1), BLOCK - LENGTH + 1):
        part = text[begin : begin + BLOCK]
        at, s0, s1, h, c = anchors(part, np.array([0, len(part)]))
        yield np.full(len(s0), first), s0 + begin, at - s0, s1 - s0 + 1, h, c


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by h, c and place, but for rows that are known as repeats. Rows that are not their class's first are repeats (wanted false); firsts are wanted if their h has several classes."""
    last_h = last_c = held = earliest = None
    names = ["h", "doc_id", "place", "back", "count"]
    for batch in batches:
        repeat = np.asarray(batch["repeat"])
        if repeat.any():
            known = batch.filter(pa.array(repeat))
            yield pa.RecordBatch.from_arrays([*(known[x] for x in names), pa.array(np.zeros(len(known), bool))], [*names, "wanted"])
            batch = batch.filter(pa.array(~repeat))
        if not len(batch):
            continue
        h, c = np.asarray(batch["h"]), np.asarray(batch["c"])
        new_h = np.concatenate([[h[0] != last_h], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[c[0] != last_c], c[1:] != c[:-1]])
        first = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), 0))
        docs, place = batch["doc_id"], np.asarray(batch["place"])
        leaders, led = docs.take(pa.array(first)), place[first]
        if not new_c[0]:  # the first class goes on: its earliest row lies in a batch before
            n = int(new_c.argmax()) if new_c.any() else len(h)
            leaders = pa.concat_arrays([pa.concat_arrays([earliest[0]] * n), leaders.slice(n)])
            led = np.concatenate([np.full(n, earliest[1]), led[n:]])
        again = ~new_c & ~((place == led) & _same(docs, leaders))  # the same place once more is no repeat
        earliest = leaders.slice(len(h) - 1, 1), led[-1]
        run = np.cumsum(new_h)  # 0: goes on from the batch before
        classes = np.bincount(run, new_c, run[-1] + 1)
        if held is not None:  # the only first of its h so far
            if classes[0]:
                yield held
                held = None
            elif len(classes) > 1:
                held = None
        goes_on = classes[0] > 0
        several = classes > 1
        several[0] = goes_on  # a new class of an h that already had one
        wanted = new_c & several[run]
        out = again | wanted
        if out.any():
            rows = pa.RecordBatch.from_arrays([*(batch[x] for x in names), pa.array(wanted)], [*names, "wanted"])
            yield rows.filter(pa.array(out))
        if run[-1] and classes[-1] == 1:
            at = len(h) - 1 - int(new_c[::-1].argmax())
            held = pa.RecordBatch.from_arrays([*(batch[x].slice(at, 1) for x in ("h", "doc_id", "place", "back", "count")), pa.array([True])], ["h", "doc_id", "place", "back", "count", "wanted"])
        elif run[-1]:
            held = None
        last_h, last_c = h[-1], c[-1]


def _squeezed(docs: DataFrame) -> DataFrame:
    """doc_id, hi and the text's bytes, compressed: they cross the network."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [t.encode() for t in batch["text"].to_pylist()]
            rest = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([_hi(t) for t in texts], pa.int64()), pa.array([squeeze(t) for t in texts], pa.binary()), *rest], ["doc_id", "hi", "bytes", *names])

    names = docs.columns[2:]
    rest = "".join(f", {c} {k}" for c, k in docs.dtypes[2:])
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, hi long, bytes binary{rest}")


def _bytes(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for x in column.to_pylist():
        yield expand(x) if x else b""


def _sides(back: int, count: int) -> Iterator[tuple[bool, int, int]]:
    """An anchor's windows in two parts, those with SIDE bytes or more before the anchor (True) and the others, as first window and number."""
    left = min(max(back - SIDE + 1, 0), count)
    if left:
        yield True, 0, left
    if left < count:
        yield False, left, count - left


def _fetch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h becomes a hash of the K bytes and of the SIDE bytes that all windows of the part have before or behind them."""
    import xxhash

    for batch in batches:
        at, keys, parts = [], [], []
        for i, (text, wanted) in enumerate(zip(_bytes(batch["bytes"]), batch["wanted"].to_pylist(), strict=True)):
            for w in wanted:
                offset = w["place"] & (1 << 40) - 1
                anchor = offset + w["back"]
                for left, first, count in _sides(w["back"], w["count"]):
                    side = text[anchor - SIDE : anchor] if left else text[anchor + K : anchor + K + SIDE]
                    at.append(i)
                    keys.append(xxhash.xxh3_64_intdigest(side, (~w["h"] if left else w["h"]) & _ALL))
                    parts.append((w["place"] + first, w["back"] - first, count, text[offset + first : offset + first + count - 1 + LENGTH]))
        place, back, count, context = zip(*parts, strict=True) if parts else [()] * 4
        h = pa.array(np.array(keys, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([h, batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(place, pa.int64()), pa.array(back, pa.int16()), pa.array(count, pa.int16()), pa.array(context, pa.binary())], ["h", "doc_id", "place", "back", "count", "context"])


CHUNK = 20_000


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by h and place: the windows that are equal to an earlier one, as (place, count) runs."""

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        twice = [(rows[x].slice(1).combine_chunks(), rows[x].slice(0, len(rows) - 1).combine_chunks()) for x in ("h", "place", "doc_id")]
        twice = np.concatenate([[False], np.logical_and.reduce([_same(a, b) for a, b in twice])])
        rows = rows.filter(pa.array(~twice)) if twice.any() else rows
        new = np.diff(rows["h"].to_numpy()) != 0
        rows = rows.filter(pa.array(~(np.append(True, new) & np.append(new, True))))  # a row alone in its group has no equal
        if not len(rows):
            return None
        h, place = rows["h"].to_numpy(), rows["place"].to_numpy()
        back, count = rows["back"].to_numpy().astype(np.int64), rows["count"].to_numpy().astype(np.int64)
        group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        hits = repeated_windows(group, rows["context"].to_pylist(), back, count)[:, ::-1]  # by window start
        wide = hits.shape[1]
        edge = np.zeros((len(h), wide + 2), np.int8)
        edge[:, 1:-1] = hits
        step = np.diff(edge, axis=1)
        row, begin = np.nonzero(step == 1)
        stop = np.nonzero(step == -1)[1]
        first = place[row] + begin - (wide - 1 - back[row])  # the column of a row's first window is wide - 1 - back
        doc = rows["doc_id"].combine_chunks().take(pa.array(row))
        return pa.RecordBatch.from_arrays([doc, pa.array(first), pa.array((stop - begin).astype(np.int16))], ["doc_id", "place", "count"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size >= CHUNK:
            rows = pa.Table.from_batches(held)
            h = rows["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if cut and (hits := compare(rows.slice(0, cut))):
                yield hits
            held, size = rows.slice(cut).to_batches(), len(rows) - cut
    if size and (hits := compare(pa.Table.from_batches(held))):
        yield hits


def intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, place, count): runs of windows that also start earlier, of ``docs`` (doc_id, text)."""
    kind, n = docs.dtypes[0][1], parallelism(docs.sparkSession)
    row = f"doc_id {kind}, place long, back short, count short"
    found = docs.mapInArrow(_anchor_rows, f"h long, c long, {row}, repeat boolean")
    found = found.repartition(n, "h").sortWithinPartitions("h", "c", "doc_id", "place").mapInArrow(_class_rows, f"h long, {row}, wanted boolean")
    found = staged(found, "anchor-classes")
    hi = F.shiftright("place", 40)
    wanted = found.where("wanted").groupBy(F.col("doc_id").alias("d"), hi.alias("x")).agg(F.collect_list(F.struct("h", "place", "back", "count")).alias("wanted"))
    texts = _squeezed(docs)
    fetched = texts.join(wanted.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(wanted["d"]) & (texts["hi"] == wanted["x"])).select("doc_id", "bytes", "wanted").mapInArrow(_fetch_rows, f"h long, {row}, context binary")
    compared = fetched.repartition(n, "h").sortWithinPartitions("h", "doc_id", "place").mapInArrow(_sorted_rows, f"doc_id {kind}, place long, count short")
    return found.where("not wanted").select("doc_id", "place", "count").unionByName(compared)


def spans(starts: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that windows cover: begin and end of each."""
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    ends = np.maximum.accumulate(starts + counts[order] - 1 + length)
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(ends)) - 1]


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, bytes, windows of every row of ``docs`` (doc_id, text and perhaps a column rest)."""
    found = intervals(docs.select("doc_id", "text"))
    windows = found.groupBy(F.col("doc_id").alias("d"), F.shiftright("place", 40).alias("x")).agg(F.collect_list(F.col("place").bitwiseAND((1 << 40) - 1)).alias("starts"), F.collect_list("count").alias("counts"))
    texts = _squeezed(docs)
    return texts.join(windows.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(windows["d"]) & (texts["hi"] == windows["x"]), "left").select("doc_id", "bytes", *docs.columns[2:], "starts", "counts")


def _each(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """A document's bytes and the spans to remove."""
    for text, starts, counts in zip(_bytes(batch["bytes"]), batch["starts"].to_pylist(), batch["counts"].to_pylist(), strict=True):
        yield text, list(zip(*(x.tolist() for x in spans(np.array(starts), np.array(counts))), strict=True)) if starts else []


def passage_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, gone in _each(batch):
                sha, at = hashlib.sha256(), 0
                for a, b in gone:
                    sha.update(text[at:a])
                    at = b
                sha.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), sha.hexdigest()))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = id_text(docs, id_col, text_col)
    return _marked(docs).mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text(text: bytes, gone: list[tuple[int, int]]) -> str:
    """What is left, whole characters: one that is removed in part stays."""
    out, at = [], 0
    for a, b in gone:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = max(a, b)
    return b"".join([*out, text[at:]]).decode()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with their repeated passages taken out of the text; ``length_col`` gets the new number of characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["rest"], pa.array([kept_text(t, gone) for t, gone in _each(batch)], pa.string())], ["rest", "text"])

    others = [c for c in docs.columns if c != text_col]
    own = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.struct(*(docs[c] for c in others)).alias("rest"))
    kept = _marked(own).mapInArrow(run, f"rest {own.dtypes[2][1]}, text string")
    value = {c: F.col("rest")[c] for c in others} | {text_col: F.col("text")}
    if length_col in docs.columns:
        value[length_col] = F.length("text").cast(dict(docs.dtypes)[length_col])
    return kept.select(*(value[c].alias(c) for c in docs.columns))
