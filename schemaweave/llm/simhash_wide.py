"""SimHash near-dedup at a similarity: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

The operator of ``simhash`` with wider fingerprints, as 64 bits are too few here: sets just similar enough differ in 15 % of
their bits. A fingerprint has GROUPS groups of SIZE bytes and a sketch of 4 bytes. The byte-position index's keys are sets of
``width`` positional bytes of one group (pairs, up to some million distinct sets; each further byte serves 256 times as many),
so that a key holds few unrelated fingerprints. Pairs under a key are kept if the group's other bytes and the sketch are near
enough, then the positional bytes that their whole fingerprints share are tallied, pairs with MINIMUM or more are retained,
and retained pairs are verified exactly, by their whole shingle sets. So no pair is ever linked below the similarity.

No radius is certain to hold all pairs of a similarity. A pair of similarity 0.8 exactly shares a byte with a chance of 0.27 and
is missed if no group has ``width`` shared bytes: 8 of 10,000 such pairs (fewer the more similar they are; texts of under ten
words have coarser bits). The README gives measured recall.

Words are what ASCII white space divides, ASCII letters lowered; a text of fewer than five words is one shingle. Shingles are
64-bit hashes; sets are equal where a 128-bit digest is. Equal sets are one node before any comparison (within a partition at
once, so a hot text has a node a partition). Of the near fingerprints under a key each meets its least partner at once; where
more than two belong together, their postings wait until these pairs are verified and components are joined. Then only nodes of
different components meet under a key: those outside its largest component with all, and only if sizes and the parities of
their shingles (every odd bit of two parity maps together is a shingle of one set only) leave the similarity possible. Of the
retained pairs each node's nearest and least partner are verified first, then those that still lie in different components. So
a large group of near copies takes few pairs. The members of a large group that share most of their words, but less than the
similarity, are compared with each other under their keys.

Null text is empty text; texts without words equal each other. Rows that repeat one id are one document; rows without an id
are kept and link others. An empty table gives an empty table; extra columns of any name stay as they are.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, id_text, parallelism, slices, small_batches, staged
from .components import components

WORDS = 5
#: (bytes a key, bytes a group, groups) by number of nodes.
SHAPES = [(1 << 21, (2, 6, 10)), (1 << 30, (3, 8, 15)), (1 << 62, (4, 12, 14))]
SKETCH = 4
#: Bits in which the rest of a group and the sketch, and a whole fingerprint, may differ: the mean at similarity 0.8 and over four deviations more.
NEAR, APART = lambda bits: int(0.1514 * bits + 4.3 * (0.1285 * bits) ** 0.5), 0.24
MINIMUM = 5
#: Neighbours in a key's order that a fingerprint is compared with; in larger keys all postings wait.
CAP = 256
PARTNERS = 8
#: Bytes of one bucket's postings, on average at most, and those that a task holds before it lets go of keys beyond CAP.
BUCKET, HELD = 4 << 20, 16 << 20
#: Bytes of postings that a task packs at once (it holds some copies of them), and pairs under a key that are weighed at once.
FLUSH, WEIGHED = 8 << 20, 1 << 16
#: Nodes whose pairs are tallied together, and the kinds of what has been found.
RANGE, ALONE, COMPANY, WAITS = 8_000, 0, 1, 2
#: Nodes up to which the ids of candidates are broadcast (8 bytes each); beyond, the join is shuffled.
BROADCAST = 1 << 20
#: Bits of a parity map.
PARITY = 512
_POSTING = np.dtype([("set", "<u2"), ("size", "<u2"), ("sketch", "<u4"), ("group", "V12"), ("node", "<i8")])
_WAITING = np.dtype([("key", "<u8"), ("node", "<i8"), ("root", "<i8"), ("n", "<u4"), ("parity", "<u8", PARITY // 64)])


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    import xxhash

    tokens = text.encode().lower().split()  # bytes.lower() is A-Z, bytes.split() the six ASCII white spaces
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[-n:] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[i:j], 42) for i, j in zip(starts, stops, strict=True)), np.uint64, n))


def wide_fingerprint(own: np.ndarray, size: int) -> bytes:
    """Of a set's hashes, ``size`` bytes: each bit is set in over half of its elements' bits, which are mixed from their hashes."""
    factors = np.arange(1, -(-size // 8) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    ones = np.zeros(size * 8, np.int64)
    with np.errstate(over="ignore"):
        for k in range(0, len(own), 255):
            x = own[k : k + 255, None] * factors
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            ones += np.unpackbits(x.view(np.uint8)[:, :size], axis=1).sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(own)).tobytes()


def sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, node, digest, n, shingles): digest and shingles only in the first row of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        claim("simhash")
        texts: dict[bytes, int] = {}
        seen: dict[bytes, int] = {}
        first = TaskContext.get().partitionId() << 36
        for batch in slices(batches, 2 << 20):
            nodes, digests, sizes, found = [], [], [], []
            for text in batch["text"].to_pylist():
                same = xxhash.xxh3_128_digest(text)
                own = digest = None
                if same not in texts:
                    own = shingles(text, words)
                    digest = xxhash.xxh3_128_digest(own.tobytes())
                    new = digest not in seen
                    texts[same] = seen.setdefault(digest, first + len(seen))
                    own, digest = (own, digest) if new else (None, None)
                nodes.append(texts[same])
                digests.append(digest)
                sizes.append(None if own is None else len(own))
                found.append(None if own is None else own.tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(nodes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "node", "digest", "n", "shingles"])

    docs = id_text(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, node long, digest binary, n long, shingles binary")


def _prints(found: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(node, n, fp, parity) of the nodes with words."""
    size = shape[1] * shape[2] + SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in slices(batches, column="shingles"):
            own = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch["shingles"]]
            odd = [np.packbits((np.bincount((x % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64) for x in own]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], pa.array([wide_fingerprint(x, size) for x in own], pa.binary()), pa.array(odd, pa.list_(pa.int64()))], ["node", "n", "fp", "parity"])

    return found.where("n > 0").select("node", "n", "shingles").mapInArrow(run, "node long, n long, fp binary, parity array<long>")


def _postings(prints: DataFrame, shape: tuple[int, int, int], buckets: int) -> DataFrame:
    """(bucket, postings): packed postings of every key; a key lies in one bucket."""
    width, size, groups = shape
    chosen = list(itertools.combinations(range(size), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        dealt: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            to, rows = np.concatenate(dealt), np.concatenate(held)
            order = np.argsort(to, kind="stable")
            to, rows = to[order], rows[order]
            at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            blobs = [rows[i:j].tobytes() for i, j in itertools.pairwise([*at.tolist(), len(rows)])]
            held.clear(), dealt.clear()
            return pa.RecordBatch.from_arrays([pa.array(to[at], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "postings"])

        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                n = len(part)
                if not n:
                    continue
                fps = np.frombuffer(b"".join(part["fp"].to_pylist()), np.uint8).reshape(n, -1)
                rows = np.zeros((groups * len(chosen), n), _POSTING)
                rows["node"] = np.asarray(part["node"])
                rows["sketch"] = np.ascontiguousarray(fps[:, -SKETCH:]).view("<u4")[:, 0]
                rows["size"] = _scaled(np.asarray(part["n"]))
                keys = np.zeros((groups * len(chosen), n), np.uint64)
                for g in range(groups):
                    own = np.zeros((n, 12), np.uint8)
                    own[:, :size] = fps[:, g * size : (g + 1) * size]
                    packed = own.view("V12")[:, 0]
                    for c, places in enumerate(chosen):
                        k = g * len(chosen) + c
                        rows["set"][k], rows["group"][k] = k, packed
                        keys[k] = k
                        for p in places:
                            keys[k] = keys[k] << np.uint64(8) | own[:, p]
                with np.errstate(over="ignore"):
                        mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                held.append(rows.ravel())
                dealt.append((mixed % np.uint64(buckets)).astype(np.int32).ravel())
                if sum(map(len, held)) * _POSTING.itemsize > FLUSH:
                    yield flush()
        if held:
            yield flush()

    return prints.mapInArrow(run, "bucket int, postings binary")


def _scaled(n: np.ndarray) -> np.ndarray:
    """Sizes on a scale whose steps are 0.1 %; similar sets are at most 224 steps apart."""
    return np.rint(np.log(n) * 1000).astype(np.uint16)


def _compare(postings: DataFrame, shape: tuple[int, int, int], ranges: int) -> DataFrame:
    """Packed rows (range, kind, rows): pairs that meet alone under a key; where more than two belong together, each with its least partner; and those nodes, which wait for the rest.

    A task packs what it finds by ranges of the first node, so that few rows are shuffled however large a group is."""
    width, size, groups = shape
    chosen = list(itertools.combinations(range(size), width))
    most = NEAR(8 * (size - width + SKETCH))

    def keyed(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """The postings sorted by key, with their groups' bytes and keys."""
        own = np.ascontiguousarray(rows["group"]).view(np.uint8).reshape(len(rows), 12)
        places = np.array(chosen)[rows["set"] % len(chosen)]
        key = rows["set"].astype(np.uint64)
        for i in range(width):
            key = key << np.uint64(8) | np.take_along_axis(own, places[:, i : i + 1], 1)[:, 0]
        order = np.lexsort((rows["node"], rows["sketch"], key))
        return rows[order], own[order], key[order]

    def joined(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Labels (the first row of what belongs together) after ``left`` and ``right`` have met."""
        while True:
            low, high = np.minimum(label[left], label[right]), np.maximum(label[left], label[right])
            apart = low < high
            if not apart.any():
                return label
            parent = np.arange(len(label))
            np.minimum.at(parent, high[apart], low[apart])
            while (parent != parent[parent]).any():
                parent = parent[parent]
            label = parent[label]

    def links(rows: np.ndarray, own: np.ndarray, key: np.ndarray, open_all: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        node = np.ascontiguousarray(rows["node"])
        run = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        here, label = np.arange(len(rows)), np.arange(len(rows))
        met, least = np.zeros(len(rows), bool), np.full(len(rows), np.iinfo(np.int64).max)
        for k in range(1, CAP):  # pairs go as soon as they are noted: a hot key has up to CAP for each of its rows
            here = here[here + k < len(rows)]
            here = here[run[here] == run[here + k]]
            if not len(here):
                break
            bits = np.bitwise_count(own[here] ^ own[here + k]).sum(1, dtype=np.int64) + np.bitwise_count(rows["sketch"][here] ^ rows["sketch"][here + k])
            left = here[(bits <= most) & (np.abs(rows["size"][here].astype(np.int32) - rows["size"][here + k]) <= 225)]
            right = left + k  # neither side holds a row twice
            met[left] = met[right] = True
            least[left] = np.minimum(least[left], node[right])
            least[right] = np.minimum(least[right], node[left])
            label = joined(label, left, right)
        some = np.flatnonzero(met)
        several = (np.bincount(label, minlength=len(rows)) > 2)[label]
        two, more = some[~several[some]], some[several[some]]
        yield ALONE, np.unique(np.stack([np.minimum(node[two], least[two]), np.maximum(node[two], least[two])], 1), axis=0)
        yield COMPANY, np.stack([node[more], least[more]], 1)
        wait = np.unique(node[several | open_all])
        yield WAITS, np.stack([wait, wait], 1)

    def packed(found: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, parts in found.items():
            rows = np.concatenate(parts)
            with np.errstate(over="ignore"):
                to = ((rows[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(ranges)
            order = np.argsort(to, kind="stable")
            to, rows = to[order].astype(np.int32), rows[order]
            at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            blobs = [rows[i:j].tobytes() for i, j in itertools.pairwise([*at.tolist(), len(rows)])]
            yield pa.RecordBatch.from_arrays([pa.array(to[at]), pa.array(np.full(len(at), kind), pa.int32()), pa.array(blobs, pa.binary())], ["range", "kind", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        state = {"bucket": None, "held": [], "bytes": 0, "limit": HELD, "beyond": np.zeros(0, np.uint64)}

        def work(last: bool) -> Iterator[tuple[int, np.ndarray]]:
            """Compare what is held; unless ``last``, only the keys beyond CAP, whose postings go, so that a hot key doesn't fill the memory."""
            if not state["held"]:
                return
            rows, own, key = keyed(np.concatenate(state["held"]))
            _, run, count = np.unique(key, return_inverse=True, return_counts=True)
            many = (count[run] > CAP) | np.isin(key, state["beyond"])
            if last:
                yield from links(rows, own, key, many)
                state.update(held=[], bytes=0, limit=HELD, beyond=np.zeros(0, np.uint64))
            else:
                if many.any():
                    yield from links(rows[many], own[many], key[many], np.ones(int(many.sum()), bool))
                rest = rows[~many]
                state.update(held=[rest], bytes=rest.nbytes, limit=max(HELD, 2 * rest.nbytes), beyond=np.union1d(state["beyond"], key[many]))

        found: dict[int, list[np.ndarray]] = {}
        held = 0

        def note(things: Iterator[tuple[int, np.ndarray]]) -> None:
            nonlocal held
            for kind, rows in things:
                if len(rows):
                    found.setdefault(kind, []).append(rows)
                    held += rows.nbytes

        for batch in batches:
            for to, blob in zip(batch["bucket"].to_pylist(), batch["postings"], strict=True):
                if to != state["bucket"]:
                    note(work(True))
                    state["bucket"] = to
                state["held"].append(np.frombuffer(blob.as_buffer(), _POSTING).copy())
                state["bytes"] += state["held"][-1].nbytes
                if state["bytes"] > state["limit"]:
                    note(work(False))
            if held > HELD:
                yield from packed(found)
                found, held = {}, 0
        note(work(True))
        yield from packed(found)

    return postings.repartition(parallelism(postings.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "range int, kind int, rows binary")


def _met(compared: DataFrame) -> DataFrame:
    """(a, b): the pairs that meet alone under a key, and of the partners that a node has in larger company the least and the PARTNERS met under most keys; b is null for the nodes that wait."""

    def chosen(rows: np.ndarray) -> np.ndarray:
        pairs, tally = np.unique(rows, axis=0, return_counts=True)
        order = np.lexsort((pairs[:, 1], -tally, pairs[:, 0]))
        node = pairs[order, 0]
        new = np.concatenate([[True], node[1:] != node[:-1]])
        place = np.arange(len(node)) - np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))
        first = np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])
        return np.concatenate([pairs[order][place < PARTNERS], pairs[first]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                rows = np.concatenate(held)
                if now[1] == WAITS:
                    node = np.unique(rows[:, 0])
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64())], ["a", "b"])
                else:
                    pairs = np.unique(np.sort(chosen(rows) if now[1] == COMPANY else rows, axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
                held.clear()

        for batch in batches:
            for to, kind, blob in zip(batch["range"].to_pylist(), batch["kind"].to_pylist(), batch["rows"], strict=True):
                if (to, kind) != now:
                    yield from settle()
                    now = to, kind
                held.append(np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, 2).copy())
        yield from settle()

    return compared.repartition(parallelism(compared.sparkSession), "range").sortWithinPartitions("range", "kind").mapInArrow(run, "a long, b long")


def _retained(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b, apart) of the pairs whose fingerprints share MINIMUM positional bytes and differ in few enough bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("fa", "fb"))
                x = a ^ b
                apart = np.bitwise_count(x).sum(1, dtype=np.int64)
                keep = ((x[:, :-SKETCH] == 0).sum(1) >= MINIMUM) & (apart <= APART * 8 * x.shape[1])
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(apart)], ["a", "b", "apart"]).filter(pa.array(keep))

    one = lambda node: prints.select(F.col("node").alias(node), F.col("fp").alias(f"f{node}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long, apart long")


def _similar(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) whose whole sets are similar enough; only the sets of these nodes are moved."""
    nodes = staged(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "candidate-nodes")
    own = found.select("node", "shingles").join(F.broadcast(nodes) if nodes.count() <= BROADCAST else nodes, "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(len(batch), bool)
            for i, (a, b) in enumerate(zip(batch["sa"], batch["sb"], strict=True)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                hit[i] = both * (1 + similarity) >= similarity * (len(a) + len(b)) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(hit))

    one = lambda node: own.select(F.col("node").alias(node), F.col("shingles").alias(f"s{node}"))
    return pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs with the components of both ends so far, where these differ."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    return pairs.where("ra <> rb").drop("ra", "rb")


def _verified(pairs: DataFrame, edges: DataFrame, prints: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """``edges`` and those that the candidate pairs add to connect what is similar."""
    likely = staged(_retained(pairs, prints), "retained")
    ends = likely.select("a", "b", "apart").union(likely.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    sure = F.col("apart") <= F.lit(int(0.11 * 8 * _length(prints)))
    best = ends.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("near"), F.min(F.when(sure, F.col("b"))).alias("least"))
    some = best.select("a", F.explode(F.array_compact(F.array("near", "least"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = edges.union(staged(_similar(staged(some, "first-pairs"), found, similarity), "first-links"))
    rest = staged(_rooted(likely.select("a", "b"), components(edges, "near-components")), "other-pairs")
    return edges.union(staged(_similar(rest, found, similarity), "other-links"))


def _length(prints: DataFrame) -> int:
    first = prints.select(F.length("fp")).first()
    return first[0] if first else 0


def _across(nodes: DataFrame, edges: DataFrame, prints: DataFrame, shape: tuple[int, int, int], similarity: float) -> DataFrame:
    """Candidate pairs of different components among ``nodes``: all that a key, sizes and parities leave possible.

    Under a key the nodes outside the largest component of all are held, and that one's pass by."""
    spark = nodes.sparkSession
    width, size, groups = shape
    chosen = list(itertools.combinations(range(size), width))
    rooted = staged(nodes.join(components(edges, "waiting-components"), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "waiting")
    largest = rooted.groupBy("root").count().orderBy(F.desc("count"), "root").first()
    if largest is None:
        return edges.where("false")
    rows = rooted.join(prints, "node").select("node", "root", (F.col("root") == largest["root"]).alias("main"), "n", "fp", "parity")
    buckets = max(4 * parallelism(spark), rooted.count() * groups * len(chosen) * _WAITING.itemsize // BUCKET)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                n = len(part)
                fps = np.frombuffer(b"".join(part["fp"].to_pylist()), np.uint8).reshape(n, -1)
                own = np.zeros((groups * len(chosen), n), _WAITING)
                own["node"], own["root"], own["n"] = (np.asarray(part[c]) for c in ("node", "root", "n"))
                own["parity"] = np.asarray(part["parity"].flatten()).reshape(n, -1)
                for g in range(groups):
                    for c, places in enumerate(chosen):
                        key = np.full(n, g * len(chosen) + c, np.uint64)
                        for p in places:
                            key = key << np.uint64(8) | fps[:, g * size + p]
                        own["key"][g * len(chosen) + c] = key
                rows, main = own.ravel(), np.tile(np.asarray(part["main"]), groups * len(chosen))
                with np.errstate(over="ignore"):
                    to = ((rows["key"] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
                to = to.astype(np.int64) * 2 + main
                order = np.argsort(to, kind="stable")
                to, rows = to[order], rows[order]
                at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if n else np.zeros(0, np.int64)
                blobs = [rows[i:j].tobytes() for i, j in itertools.pairwise([*at.tolist(), len(rows)])] if n else []
                yield pa.RecordBatch.from_arrays([pa.array((to[at] // 2).astype(np.int32)), pa.array((to[at] % 2).astype(bool)), pa.array(blobs, pa.binary())], ["bucket", "main", "postings"])

    def possible(a: np.ndarray, held: np.ndarray) -> Iterator[np.ndarray]:
        """(node, node) of the ``a`` and the ``held``, which are sorted by key, that could be similar."""
        low, high = np.searchsorted(held["key"], a["key"]), np.searchsorted(held["key"], a["key"], "right")
        total = np.concatenate([[0], np.cumsum(high - low)])
        start = 0
        while start < len(a):
            stop = max(start + 1, int(np.searchsorted(total, total[start] + WEIGHED, "right")) - 1)
            count = (high - low)[start:stop]
            i = np.repeat(np.arange(start, stop), count)
            j = np.arange(len(i)) - np.repeat(total[start:stop] - total[start], count) + np.repeat(low[start:stop], count)
            n, m = a["n"][i].astype(np.int64), held["n"][j].astype(np.int64)
            ok = (a["root"][i] != held["root"][j]) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
            i, j, n = i[ok], j[ok], (n + m)[ok]
            odd = np.bitwise_count(a["parity"][i] ^ held["parity"][j]).sum(1, dtype=np.int64)
            ok = odd * (1 + similarity) <= (1 - similarity) * n + 1e-9
            yield np.stack([a["node"][i[ok]], held["node"][j[ok]]], 1)
            start = stop

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        bucket, held, waiting = None, np.zeros(0, _WAITING), []

        def settle() -> Iterator[np.ndarray]:
            nonlocal held, waiting
            if waiting:
                held, waiting = np.concatenate(waiting), []
                held = held[np.argsort(held["key"], kind="stable")]
                yield from possible(held, held)

        for batch in batches:
            out = []
            for to, main, blob in zip(batch["bucket"].to_pylist(), batch["main"].to_pylist(), batch["postings"], strict=True):
                if to != bucket:
                    out += settle()
                    bucket, held = to, np.zeros(0, _WAITING)
                rows = np.frombuffer(blob.as_buffer(), _WAITING)
                if main:
                    out += settle()
                    out += possible(rows, held)
                else:
                    waiting.append(rows.copy())
            pairs = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        pairs = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *settle()]), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = rows.mapInArrow(post, "bucket int, main boolean, postings binary").repartition(parallelism(spark), "bucket").sortWithinPartitions("bucket", "main")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def links(rows: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(a, b) pairs of nodes of ``sets`` that connect all nodes of the same component."""
    firsts = rows.where("digest is not null").select("node", "digest")
    least = firsts.groupBy("digest").agg(F.min("node").alias("m"))
    equal = staged(firsts.join(least, "digest").where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")), "equal")
    found = rows.where("digest is not null").join(equal, rows["node"] == equal["a"], "left_anti")
    nodes = found.count()
    shape = next(s for most, s in SHAPES if nodes <= most)
    prints = staged(_prints(found, shape), "prints")
    postings = nodes * shape[2] * math.comb(shape[1], shape[0]) * _POSTING.itemsize
    buckets = max(4 * parallelism(rows.sparkSession), postings // BUCKET)
    found_pairs = staged(_met(staged(_compare(_postings(prints, shape, buckets), shape, max(16, nodes // RANGE)), "compared")), "met")
    candidates = found_pairs.where("b is not null").distinct()
    edges = _verified(staged(candidates, "candidates"), equal, prints, found, similarity)
    waiting = found_pairs.where("b is null").select(F.col("a").alias("node"))
    return _verified(staged(_across(waiting, edges, prints, shape, similarity), "open-candidates"), edges, prints, found, similarity)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = 0.8) -> DataFrame:
    """Per document: doc_id, component_id (the smallest doc_id of its component; null if no row of it has an id)."""
    with small_batches(docs.sparkSession):  # all that is staged runs here
        rows = staged(sets(docs, id_col, text_col, words), "sets")
        roots = components(links(rows, similarity), "set-components")
        least = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
        least = staged(least.select("node", F.coalesce("root", "node").alias("root"), "least"), "node-roots")
        of = staged(least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id"), "set-roots")
    return rows.select("doc_id", "node").join(of, "node").select("doc_id", "component_id")
